"""Column expressions for the text comparisons used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a blank: every Unicode space plus zero-width space and byte-order mark.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trim_blanks(c: Column) -> Column:
    """Without outer blanks of any kind, in time linear in the text."""
    return F.btrim(c, F.lit(BLANKS))


def canonical_type(c: Column) -> Column:
    """A data type without letter case and blanks; null stays null."""
    return F.lower(F.translate(c, BLANKS, ""))


def canonical_comment(c: Column) -> Column:
    """A comment without outer blanks; null counts as empty."""
    return F.coalesce(trim_blanks(c), F.lit(""))


def hashed(*cols: Column, seed: int = 0) -> Column:
    """64 bits over columns, null being a value of its own; the same columns of the same types every time."""
    return F.xxhash64(F.lit(seed), *[x for c in cols for x in (c.isNull(), c)])


def digest(*cols: Column) -> list[Column]:
    """128 bits over columns as two numbers, for keys of which there may be very many."""
    return [hashed(*cols, seed=1), hashed(*cols, seed=2)]


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 UTC; a zoneless time is read as UTC whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_seconds(c)
    day = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
