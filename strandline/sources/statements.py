"""Statements as rows, and the facts that parsing gets from their text.

Parsing runs on the executors in Arrow batches, one row per statement in and out; everything after it
is column expressions and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from strandline.functions.sql_parser import parse_facts

_ITEM = pa.struct(
    [
        ("pos", pa.int32()), ("kind", pa.string()), ("alias", pa.string()), ("qualifier", pa.string()), ("column_name", pa.string()),
        ("name", pa.string()), ("expression", pa.string()), ("source_type", pa.string()), ("is_aggregate", pa.bool_()),
        ("columns", pa.list_(pa.struct([("qualifier", pa.string()), ("name", pa.string())]))), ("start", pa.int32()), ("end", pa.int32()),
    ]
)
_TABLE = pa.struct(
    [("pos", pa.int32()), ("scope", pa.string()), ("scope_name", pa.string()), ("full_name", pa.string()), ("alias", pa.string()), ("is_top_level", pa.bool_())]
)
_FACTS = [
    ("parse_ok", pa.bool_()), ("error", pa.string()), ("has_with", pa.bool_()), ("has_subquery", pa.bool_()), ("joins", pa.int32()),
    ("items", pa.list_(_ITEM)), ("tables", pa.list_(_TABLE)), ("ctes", pa.list_(pa.string())),
]
FACTS_SCHEMA = pa.schema([("sql_id", pa.int64()), ("sql", pa.string()), ("dialect", pa.string()), ("include_graph", pa.bool_()), *_FACTS])

#: The dialects that clients may name; others count as the first.
DIALECTS = ("spark", "hive", "mysql", "starrocks", "doris")


def normalized_dialect(c: Column) -> Column:
    """Trimmed lower-case dialect name, ``spark`` for null and unknown ones."""
    name = F.lower(F.trim(c))
    return F.when(name.isin(*DIALECTS), name).otherwise(DIALECTS[0])


#: A request as clients send it, one JSON object a line.
REQUEST_SCHEMA = (
    "sql_id long, sql string, dialect string, analysis_level string, default_catalog string, default_schema string, metadata_version string, "
    "case_sensitive boolean, include_graph boolean, analysis_options struct<include_graph:boolean>"
)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON lines, or from Parquet where the path ends so.  Damaged lines have a null text."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    rows = spark.read.schema(REQUEST_SCHEMA).json(path)
    return rows.withColumn("include_graph", F.coalesce("include_graph", "analysis_options.include_graph")).drop("analysis_options")


def statements(requests: DataFrame, sql_id: str = "sql_id", sql: str = "sql") -> DataFrame:
    """``sql_id, sql, dialect, include_graph``; whole-row repeats count once, rows without id are left out.

    ``dialect`` and ``include_graph`` may be missing or null: spark and true.
    """
    dialect = F.col("dialect") if "dialect" in requests.columns else F.lit(None).cast("string")
    graph = F.col("include_graph") if "include_graph" in requests.columns else F.lit(True)
    slim = requests.where(F.col(sql_id).isNotNull()).select(
        F.col(sql_id).cast("long").alias("sql_id"), F.col(sql).alias("sql"), normalized_dialect(dialect).alias("dialect"), F.coalesce(graph, F.lit(True)).alias("include_graph")
    )
    return slim.dropDuplicates()


def _facts(sql: str | None, dialect: str) -> dict:
    facts, error = parse_facts(sql, dialect)
    if facts is None:
        return {"parse_ok": False, "error": error, "has_with": False, "has_subquery": False, "joins": 0, "items": [], "tables": [], "ctes": []}
    return {
        "parse_ok": True, "error": None, "has_with": facts.has_with, "has_subquery": facts.has_subquery, "joins": facts.joins,
        "items": facts.items, "tables": facts.tables, "ctes": facts.ctes,
    }


def parse_statements(rows: DataFrame) -> DataFrame:
    """One row of facts per statement of :func:`statements`; text that isn't one query has ``parse_ok`` false.

    ``sniffs_cte`` tells whether the text, blanks stripped, begins with ``with`` and a blank: the test by
    which a statement is treated as a CTE query, independent of what the parser finds.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_facts(sql, dialect) for sql, dialect in zip(batch.column("sql").to_pylist(), batch.column("dialect").to_pylist())]
            given = [batch.column(n).cast(t) for n, t in zip(FACTS_SCHEMA.names[:4], FACTS_SCHEMA.types[:4])]
            made = [pa.array([f[n] for f in found], t) for n, t in _FACTS]
            yield pa.RecordBatch.from_arrays([*given, *made], schema=FACTS_SCHEMA)

    # parsing costs far more than moving the text: spread it whatever the rows' size in bytes
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = rows.repartition(parts, "sql_id").mapInArrow(parse, from_arrow_schema(FACTS_SCHEMA))
    sniffs = F.lower(F.regexp_replace("sql", r"^[\s\x{85}\x{a0}\x{1c}-\x{1f}\x{2000}-\x{200a}\x{3000}]+", "")).startswith("with ")
    return facts.withColumn("sniffs_cte", F.coalesce(sniffs, F.lit(False)))


def output_fields(facts: DataFrame) -> DataFrame:
    """``sql_id, pos, name, display_name, expression, source_type`` of every select item."""
    items = facts.select("sql_id", F.explode("items").alias("i"))
    return items.select("sql_id", "i.pos", "i.name", F.col("i.name").alias("display_name"), "i.expression", "i.source_type")


def table_references(facts: DataFrame) -> DataFrame:
    """Every table reference in text order: ``sql_id, pos, scope, scope_name, full_name, alias, is_top_level``."""
    return facts.select("sql_id", F.explode("tables").alias("t")).select("sql_id", "t.*")


def source_tables(facts: DataFrame) -> DataFrame:
    """Distinct table names of a statement by first appearance: ``sql_id, ord, table_name``."""
    names = F.array_distinct(F.transform("tables", lambda t: t["full_name"]))
    return facts.select("sql_id", F.posexplode(names).alias("ord", "table_name"))


def source_locations(facts: DataFrame) -> DataFrame:
    """Line and column, from 1, place in the list and length of every select item in its statement."""
    items = facts.select("sql_id", "sql", F.explode("items").alias("i"))
    before = F.substring("sql", F.lit(1), F.col("i.start"))
    lines = F.split(before, "\r\n|\r|\n", -1)
    return items.select(
        "sql_id", F.col("i.pos").alias("pos"), F.concat(F.lit("output_column:"), F.col("i.name")).alias("entity_id"), F.size(lines).alias("line"),
        (F.length(F.element_at(lines, -1)) + 1).alias("col"), (F.col("i.end") - F.col("i.start")).alias("len"),
    )
