"""Joins against a table with one row per key where single keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys can hold more than 1 / HOT_KEYS of the rows, which bounds what is broadcast.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of many ``rows`` with ``keyed``, one row per key that knows its number of rows.

    Keys with more than ``total / HOT_KEYS`` rows, of which there are fewer than HOT_KEYS, are joined by
    broadcast and never shuffled; the rest is joined by shuffle in even partitions.
    """
    limit = max(total // HOT_KEYS, 1)
    hot = keyed.where(F.col(count) > limit)
    names = F.broadcast(hot.select(key))
    heavy = rows.join(F.broadcast(hot), key)
    light = rows.join(names, key, "left_anti").join(keyed.where(F.col(count) <= limit), key)
    return heavy.unionByName(light)


def join_salted(many: DataFrame, few: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """Inner join of ``many`` with ``few`` on ``key`` where both may have several rows per key.

    ``counts`` has ``key, n``: the rows of ``many`` per key, of ``total`` in all.  Keys with more than
    ``total / HOT_KEYS`` rows, of which there are fewer than HOT_KEYS, are spread over salts: rows of
    ``many`` by chance of their content, rows of ``few`` copied to each.
    """
    limit = max(total // HOT_KEYS, 1)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    spread = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), salts).cast("int")).drop("_salts")
    copied = few.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return spread.join(copied, [key, "_salt"]).drop("_salt")
