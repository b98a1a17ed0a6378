"""Places of rows in the order of their group, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.workspace import materialise

ROWS_PER_SLICE = 250_000


def range_slices(df: DataFrame, group: str, order: Sequence[str], name: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Cut rows into ordered slices, written once; ``_slice`` numbers them.

    Slices follow (group, order), so a group that holds a third of all rows spans many slices, and
    their number follows from the number of rows, so a slice doesn't grow with the data.  Rows are
    written first because drawing the bounds reads them as well, and again once cut because two
    evaluations may draw unequal bounds.
    """
    whole = materialise(df, name)
    parts = max(1, -(-whole.count() // rows_per_slice))
    if parts == 1:
        return whole.withColumn("_slice", F.lit(0))
    return materialise(whole.repartitionByRange(parts, group, *order).withColumn("_slice", F.spark_partition_id()), name)


def with_rank(df: DataFrame, group: str, order: Sequence[str], name: str, rank: str = "rank") -> DataFrame:
    """Add the place from 0 of every row within its non-null group by the order columns, which tell rows apart."""
    cut = range_slices(df, group, order, name)
    inside = Window.partitionBy("_slice", group).orderBy(*order)
    sizes = cut.groupBy("_slice", group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # rows: slices of one group
    sizes = sizes.select("_slice", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = cut.withColumn(rank, (F.row_number().over(inside) - 1).cast("long")).join(sizes, ["_slice", group])
    return placed.withColumn(rank, F.col(rank) + F.col("_base")).drop("_slice", "_base")
