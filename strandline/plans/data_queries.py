"""Queries p1, p2, p3 and p5 over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import canonical_comment, canonical_type, epoch_seconds, hashed
from strandline.operators.attribute_history import attribute_history
from strandline.operators.hierarchy import descendants, hierarchies
from strandline.operators.snapshot_diff import SnapshotIndex, SnapshotSpec, order_snapshots
from strandline.sources.nested_json import flatten_payloads, named_columns
from strandline.workspace import read_table, scratch_path

DELIVERIES = 2  #: the snapshots of each source are fed to the index in so many passes
COLUMN_KEY = ("catalog", "schema_name", "table_name", "column_name")


def catalog_spec() -> SnapshotSpec:
    """How catalog columns are known and compared."""
    return SnapshotSpec(
        source="source_name",
        snapshot="import_id",
        key=COLUMN_KEY,
        compared={
            "data_type": canonical_type(F.col("data_type")),
            "comment": canonical_comment(F.col("comment")),
            "ordinal": F.col("ordinal"),
            "is_partition": F.col("is_partition"),
            "nullable": F.col("nullable"),
        },
        version=("loaded_at", "id"),
    )


def snapshot_rows(spark: SparkSession, sf_dir: str, values: bool) -> DataFrame:
    """Column rows with their table's key and import; rows without a table are left out.

    With ``values`` the compared columns come along, else only their hash, taken before the join.
    """
    tables = read_table(spark, sf_dir, "table_metadata").select(F.col("id").alias("table_id"), "catalog", "schema_name", "table_name", "import_id").dropDuplicates()
    held = ("data_type", "comment", "ordinal", "is_partition", "nullable") if values else (hashed(*catalog_spec().compared.values()).alias("_hash"),)
    columns = read_table(spark, sf_dir, "column_metadata").select("id", "table_id", F.col("name").alias("column_name"), *held, "loaded_at")
    return columns.join(tables, "table_id")


def catalog_changes(spark: SparkSession, sf_dir: str, values: bool) -> DataFrame:
    imports = read_table(spark, sf_dir, "metadata_imports").withColumnRenamed("id", "import_id")
    order = order_snapshots(imports, "import_id", "source_name", "imported_at")
    index = SnapshotIndex(spark, scratch_path(spark, "catalog-index"))
    return index.apply(snapshot_rows(spark, sf_dir, False), order, catalog_spec(), archive=snapshot_rows(spark, sf_dir, values), slices=DELIVERIES, values=values)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_changes(spark, sf_dir, False).select("import_id", *COLUMN_KEY, "change_type")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "structure_edges").select("sql_id", "source", "target")
    found = hierarchies(edges, "sql_id", "source", "target")
    return found.select(F.col("tree").alias("sql_id"), "node", "state", "root", "depth", "path", "n_descendants")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of each tree with each node below it."""
    edges = read_table(spark, sf_dir, "structure_edges").select("sql_id", "source", "target")
    return descendants(edges, "sql_id", "source", "target").select(F.col("tree").alias("sql_id"), "node", "below")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_columns(flatten_payloads(read_table(spark, sf_dir, "metadata_payloads"))).drop("body_id")


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type and comment before and after every changed column."""
    changed = catalog_changes(spark, sf_dir, True).where("change_type = 'changed'")
    return changed.select("import_id", *COLUMN_KEY, *[F.col(side)[c].alias(f"{side}_{c}") for side in ("old", "new") for c in ("data_type", "comment")])


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_payloads(read_table(spark, sf_dir, "metadata_payloads"))
    return flat["table"].select("payload_id", "table_pos", "catalog", "schema", "table_name", "name", "table_type")


def p3_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_payloads(read_table(spark, sf_dir, "metadata_payloads"))
    return flat["column"].select("payload_id", "table_pos", "column_pos", "name", "data_type", "comment")


def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = read_table(spark, sf_dir, "column_updates").select("update_id", "column_id", "change_type", "data_type", "comment", "changed_at", "received_at")
    state = {"data_type": canonical_type(F.col("data_type")), "comment": canonical_comment(F.col("comment"))}
    return attribute_history(updates, "column_id", "changed_at", state, F.col("change_type") == "removed", ["received_at", "update_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = p5_history(spark, sf_dir)
    until = F.coalesce(epoch_seconds(history, "valid_to"), F.lit(-1).cast("long"))
    return history.select("column_id", epoch_seconds(history, "valid_from").alias("valid_from_s"), until.alias("valid_to_s"))
