"""Beyond parity: which columns every output field is made of, and column lineage rolled up to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mappings(facts: DataFrame) -> DataFrame:
    """``sql_id, pos, output, source_table, source_column, relation`` for every column an item mentions.

    ``relation`` is direct, aggregate or expression.  A qualifier is looked up as in name resolution; an
    unqualified column belongs to the only table, else ``source_table`` is null.  Windows count as
    expressions; columns of nested queries aren't the item's.
    """
    items = facts.where("parse_ok").select("sql_id", "tables", F.explode("items").alias("i")).where("i.kind <> 'star'")
    kind = F.when(F.col("i.kind") == "column", "direct").when(F.col("i.is_aggregate"), "aggregate").otherwise("expression")
    output = F.when(F.col("i.alias") != "", F.col("i.alias")).when(F.col("i.kind") == "column", F.col("i.column_name")).otherwise(F.col("i.expression"))
    rows = items.select("sql_id", "tables", F.col("i.pos").alias("pos"), output.alias("output"), kind.alias("relation"), F.explode("i.columns").alias("c"))
    q = F.col("c.qualifier")
    by_alias = F.try_element_at(F.filter("tables", lambda t: t["alias"] == q), F.lit(-1))["full_name"]
    by_name = F.when(F.exists("tables", lambda t: t["full_name"] == q), q)
    owner = F.when(q != "", F.coalesce(by_alias, by_name)).when(F.size("tables") == 1, F.get("tables", 0)["full_name"])
    return rows.select("sql_id", "pos", "output", owner.alias("source_table"), F.col("c.name").alias("source_column"), "relation")


def roll_up(lineage: DataFrame) -> DataFrame:
    """Column lineage contracted to tables: ``sql_id, source_table, output_column``, each pair once."""
    return lineage.select("sql_id", "source_table", "output_column").dropDuplicates()


def semantics(facts: DataFrame) -> DataFrame:
    """``sql_id`` and how many tables, joins, CTEs, items and aggregates each statement has."""
    size = lambda c: F.size(c).cast("long")
    return facts.where("parse_ok").select(
        "sql_id", size("tables").alias("n_tables"), F.col("joins").cast("long").alias("n_joins"), size("ctes").alias("n_ctes"), size("items").alias("n_items"),
        size(F.filter("items", lambda i: i["is_aggregate"])).alias("n_aggregates"), "has_subquery",
    )
