"""History of changing entity attributes: every state with the period in which it was valid.

Method: the states of an entity are gathered into a sorted array, which a higher-order function folds:
a version is appended only where the state differs from the last one appended; versions are exploded with
end times.  An append copies what it appends to, so long arrays are folded in pieces of ``PIECE`` states,
each against the state before it, which keeps the cost linear.

Scale: ties of one instant are settled by a map-side-combined aggregate first.  The rest is cut into
slices ordered by (entity, time), so that an entity holding a third of all rows spans many slices
and no array grows beyond its slice.  Only entities that cross slice borders, at most two per slice,
are stitched together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.ordered import ROWS_PER_SLICE, range_slices

PIECE = 256


def folded(steps: Column, kind: str) -> Column:
    """Of an array of ``at, v`` in order those steps whose ``v`` differs from that of the step before.

    ``kind`` is the type of the array.
    """

    def piece(first: Column) -> Column:
        before = F.get(steps, first - 1)["v"]
        start = F.struct(F.array().cast(kind).alias("kept"), before.alias("last"), (first > 0).alias("any"))
        repeats = lambda acc, x: acc["any"] & x["v"].eqNullSafe(acc["last"])
        step = lambda acc, x: F.struct(F.when(repeats(acc, x), acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"), x["v"].alias("last"), F.lit(True).alias("any"))
        return F.aggregate(F.slice(steps, first + 1, PIECE), start, step, lambda acc: acc["kept"])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(steps) - 1, F.lit(PIECE)), piece))


def attribute_history(
    rows: DataFrame, entity: str, at: str, state: dict[str, Column], gone: Column, latest: list[str], name: str = "history", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """One row per period: ``entity, <state columns>, valid_from, valid_to`` (null while it is open).

    ``state`` maps output columns to the form in which states compare, null being a value of its own;
    ``gone`` is true on rows that end a period.  Of several rows of one instant the one with the
    greatest ``latest`` holds.  Equal neighbouring states are one period; a state that returns after a
    gap starts a new one.  Rows with a null time are left out, a null entity is an entity of its own,
    repeated rows change nothing and an empty table gives no rows.
    """
    names = list(state)
    value = F.when(F.coalesce(gone, F.lit(False)), F.lit(None)).otherwise(F.struct(*[c.alias(n) for n, c in state.items()]))
    rows = rows.where(F.col(at).isNotNull()).select(F.col(entity).alias("entity"), F.col(at).alias("at"), F.struct(value.alias("s")).alias("v"), F.struct(*latest).alias("rank"))
    settled = rows.groupBy("entity", "at").agg(F.max_by("v", "rank").alias("v"))
    cut = range_slices(settled, "entity", ["at"], name, rows_per_slice)
    gathered = cut.groupBy("_slice", "entity").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("steps"))
    kept = gathered.select("_slice", "entity", folded(F.col("steps"), gathered.schema["steps"].dataType.simpleString()).alias("steps"))
    edge = kept.groupBy("_slice").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
    ends = kept.select("_slice", "entity", F.element_at("steps", 1).alias("head"), F.element_at("steps", -1).alias("tail"), F.try_element_at("steps", F.lit(2))["at"].alias("second"))
    border = F.col("entity").eqNullSafe(F.col("lo")) | F.col("entity").eqNullSafe(F.col("hi")) | F.col("entity").isNull()
    ends = ends.join(F.broadcast(edge), "_slice").where(border)
    w = Window.partitionBy("entity").orderBy("_slice")  # rows: slices that one entity spans
    ends = ends.withColumn("repeat", F.coalesce(F.lag("tail").over(w)["v"] == F.col("head")["v"], F.lit(False)))
    ends = ends.withColumn("starts", F.when(F.col("repeat"), F.col("second")).otherwise(F.col("head")["at"]))
    after = F.first("starts", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select("_slice", "entity", "repeat", after.alias("after"))
    joined = kept.alias("f").join(F.broadcast(ends).alias("b"), (F.col("f._slice") == F.col("b._slice")) & F.col("f.entity").eqNullSafe(F.col("b.entity")), "left")
    steps = F.when(F.coalesce("b.repeat", F.lit(False)), F.slice("f.steps", 2, F.size("f.steps"))).otherwise(F.col("f.steps"))
    joined = joined.select(F.col("f.entity").alias("entity"), steps.alias("steps"), F.col("b.after").alias("after"))
    stops = F.concat(F.slice(F.transform("steps", lambda x: x["at"]), 2, F.greatest(F.size("steps"), F.lit(1))), F.array("after"))
    periods = joined.where(F.size("steps") > 0).select("entity", F.explode(F.arrays_zip(F.col("steps").alias("x"), stops.alias("to"))).alias("p"))
    return periods.where(F.col("p.x.v.s").isNotNull()).select(
        F.col("entity").alias(entity), *[F.col("p.x.v.s")[n].alias(n) for n in names], F.col("p.x.at").alias("valid_from"), F.col("p.to").alias("valid_to")
    )
