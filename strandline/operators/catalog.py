"""The metadata catalog: imports, previews, commits and look-ups as table operations.

Imports are append-only; the catalog in force is derived from them by ``latest``: a table that a later
import names again replaces the earlier one with all its columns, others stay.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.versions import Versions
from strandline.workspace import materialise

TABLE_KEY = ("catalog", "schema_name", "table_name")
BODY_KEY = ["payload_id", "body_id"]


def latest_tables(tables: DataFrame) -> DataFrame:
    """The rows of ``tables`` in force: per key that of the greatest import, then id.  Null keys are keys."""
    last = tables.groupBy(*TABLE_KEY).agg(F.max_by(F.struct("id", "comment", "table_type", "import_id"), F.struct("import_id", "id")).alias("t"))
    return last.select(*TABLE_KEY, F.col("t.id").alias("table_id"), "t.comment", "t.table_type", "t.import_id")


def latest_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns of the tables in force, one row per table and column name: the one loaded last, then id."""
    mine = latest_tables(tables).select("table_id", "catalog", "schema_name", "table_name")
    fields = ("data_type", "comment", "ordinal", "is_partition", "nullable")
    last = columns.groupBy("table_id", "name").agg(F.max_by(F.struct("id", *fields), F.struct("loaded_at", "id")).alias("c"))
    return last.join(mine, "table_id").select(*TABLE_KEY, "table_id", "name", *[F.col("c")[f].alias(f) for f in fields])


def list_tables(tables: DataFrame) -> DataFrame:
    """Tables in force by name."""
    return latest_tables(tables).select(*TABLE_KEY, "comment", "table_type").orderBy(F.col("table_name").asc_nulls_first(), "catalog", "schema_name")


def columns_of_table(latest: DataFrame, table_name: str) -> DataFrame:
    """Columns of all tables of a bare name, by ordinal (nulls first), then name.  No table of '' exists."""
    found = latest.where((F.col("table_name") == table_name) & (F.col("table_name") != ""))
    return with_int_flags(found).orderBy(F.col("ordinal").asc_nulls_first(), "name")


def with_int_flags(columns: DataFrame) -> DataFrame:
    """Booleans as 0 and 1, as the look-up surface shows them."""
    return columns.withColumns({"is_partition": F.col("is_partition").cast("int"), "nullable": F.col("nullable").cast("int")})


def columns_by_name(latest: DataFrame) -> DataFrame:
    """``table_name, columns``: column names by ordinal (nulls first), then name.

    The bare name is the key: tables of one name in several schemas are merged, columns kept twice.
    Superseded rows are gone before names are gathered, so an array is as wide as its tables.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("ordinal", F.lit(-(2**31))).alias("o"), "name")))
    return latest.where(F.col("table_name").isNotNull() & (F.col("name") != "")).groupBy("table_name").agg(ordered.alias("c")).select("table_name", F.transform("c", lambda x: x["name"]).alias("columns"))


def count_tables(tables: DataFrame) -> DataFrame:
    return latest_tables(tables).agg(F.count("*").alias("total"))


def version_exists(imports: DataFrame, version: str) -> bool:
    return not imports.where(F.col("metadata_version") == version).limit(1).isEmpty()


@dataclass
class ImportOutcome:
    """What previewing or committing one payload says."""

    status: str
    import_batch_id: str | None
    metadata_version: str
    changes: DataFrame
    diagnostics: list[dict]
    summary: DataFrame


def payload_tables(flat: dict[str, DataFrame]) -> DataFrame:
    """Table rows of flattened payloads with defaults applied: see ``sources.nested_json``.

    Catalog and schema fall back to the payload's default, then ``default``; the name is ``table_name``,
    else ``name``, else ''; comment '' and type ``table``.
    """
    outer = flat["payload"].select(*BODY_KEY, "default_catalog", "default_schema")
    rows = flat["table"].join(outer, BODY_KEY)
    other = F.lit("default")
    return rows.select(
        *BODY_KEY, "table_pos", F.coalesce("catalog", "default_catalog", other).alias("catalog"), F.coalesce("schema", "default_schema", other).alias("schema_name"),
        F.coalesce("table_name", "name", F.lit("")).alias("table_name"), F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce("table_type", F.lit("table")).alias("table_type"),
    )


def payload_columns(flat: dict[str, DataFrame]) -> DataFrame:
    """Column rows with defaults: type and comment '', not a partition, nullable; names are required."""
    rows = flat["column"].where(F.col("name").isNotNull())
    flag = lambda c, default: F.coalesce(F.lower(c).cast("boolean"), F.lit(default))
    return rows.select(
        *BODY_KEY, "table_pos", "column_pos", "name", F.coalesce("data_type", F.lit("")).alias("data_type"), F.coalesce("comment", F.lit("")).alias("comment"),
        F.expr("try_cast(ordinal AS int)").alias("ordinal"), flag(F.col("is_partition"), False).alias("is_partition"), flag(F.col("nullable"), True).alias("nullable"),
    )


def import_changes(tables: DataFrame, columns: DataFrame, change_type: str) -> DataFrame:
    """One row per table, followed by its columns: ``payload_id, body_id, table_pos, column_pos, ...``; -1 is the table."""
    kind = F.lit(change_type).alias("change_type")
    own = tables.select(*BODY_KEY, "table_pos", F.lit(-1).cast("long").alias("column_pos"), kind, F.lit("table").alias("object_type"), *TABLE_KEY, F.lit(None).cast("string").alias("column_name"))
    under = columns.join(tables.select(*BODY_KEY, "table_pos", *TABLE_KEY), [*BODY_KEY, "table_pos"])
    under = under.select(*BODY_KEY, "table_pos", "column_pos", kind, F.lit("column").alias("object_type"), *TABLE_KEY, F.col("name").alias("column_name"))
    return own.unionByName(under)


def import_summary(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``payload_id, body_id, table_count, column_count``."""
    counted = columns.groupBy(*BODY_KEY).agg(F.count("*").alias("column_count"))
    return tables.groupBy(*BODY_KEY).agg(F.count("*").alias("table_count")).join(counted, BODY_KEY, "left").select(*BODY_KEY, "table_count", F.coalesce("column_count", F.lit(0)).alias("column_count"))


def preview(flat: dict[str, DataFrame], version: str) -> ImportOutcome:
    """What an import would add, without writing: every object counts as added."""
    tables, columns = payload_tables(flat), payload_columns(flat)
    return ImportOutcome("preview_ready", None, version, import_changes(tables, columns, "added"), [], import_summary(tables, columns))


def with_known_versions(changes: DataFrame, payloads: DataFrame, imports: DataFrame) -> DataFrame:
    """Changes as commits tell them: those of a payload whose version was imported before are ``unchanged``.

    ``payloads`` has payload_id, body_id and metadata_version; a null version is never known.
    """
    known = imports.select("metadata_version").dropDuplicates()
    seen = payloads.join(known, "metadata_version", "left_semi").select(*BODY_KEY, F.lit("unchanged").alias("_seen"))
    kind = F.coalesce("_seen", "change_type").alias("change_type")
    return changes.join(seen, BODY_KEY, "left").select(*[kind if c == "change_type" else c for c in changes.columns])


def commit(flat: dict[str, DataFrame], version: str, store: CatalogStore, source_name: str | None = None) -> ImportOutcome:
    """Import one payload; a version that exists already is told and left alone."""
    tables, columns = payload_tables(flat), payload_columns(flat)
    summary = import_summary(tables, columns)
    payload = flat["payload"].withColumn("metadata_version", F.lit(version))
    changes = materialise(with_known_versions(import_changes(tables, columns, "added"), payload, store.imports()), "import-changes")
    if version_exists(store.imports(), version):
        told = {"code": "METADATA_VERSION_EXISTS", "level": "info", "message": f"Metadata version {version} already exists, skipped import."}
        return ImportOutcome("committed", None, version, changes, [told], summary)
    batch = store.append(tables, columns, version, source_name)
    return ImportOutcome("committed", str(batch), version, changes, [], summary)


IMPORTS = "id long, metadata_version string, source_name string, imported_at timestamp, table_count int, column_count int"
TABLES = "id long, catalog string, schema_name string, table_name string, comment string, table_type string, import_id long"
COLUMNS = "id long, table_id long, table_name string, name string, data_type string, comment string, ordinal int, is_partition boolean, nullable boolean, loaded_at timestamp"


class CatalogStore:
    """Append-only parquet tables under ``root``, for one writer.

    Every attempt writes a folder of its own; the state that names it is turned last.  An import that dies
    half-way is a folder that no state names, whatever id the next one gets, and is dropped then.
    """

    def __init__(self, spark, root: str) -> None:
        self.spark, self.root, self.versions = spark, root.rstrip("/"), Versions(spark, root)
        if self.versions.load() is None:
            self.versions.store({"last": 0, "batches": []})

    def _rows(self, name: str, schema: str) -> DataFrame:
        batches = self.versions.load()["batches"]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/batches/{b}/{name}" for b in batches]) if batches else self.spark.createDataFrame([], schema)

    def imports(self) -> DataFrame:
        return self._rows("imports", IMPORTS)

    def tables(self) -> DataFrame:
        return self._rows("tables", TABLES)

    def columns(self) -> DataFrame:
        return self._rows("columns", COLUMNS)

    def append(self, tables: DataFrame, columns: DataFrame, version: str, source_name: str | None) -> int:
        """Write one batch and return its id: one more than the greatest so far."""
        state = self.versions.load()
        batch, folder = state["last"] + 1, uuid.uuid4().hex[:12]
        path = f"{self.root}/batches/{folder}"
        # ids: the batch in the upper bits, the place in the payload in the lower ones
        table_id = F.lit(batch) * F.lit(1 << 32) + F.col("table_pos")
        now = F.current_timestamp()
        tables.select(table_id.alias("id"), *TABLE_KEY, "comment", "table_type", F.lit(batch).cast("long").alias("import_id")).write.parquet(f"{path}/tables")
        named = columns.join(tables.select(*BODY_KEY, "table_pos", "table_name"), [*BODY_KEY, "table_pos"])
        named.select(
            F.xxhash64(F.lit(batch), "table_pos", "column_pos").alias("id"), table_id.alias("table_id"),
            "table_name", "name", "data_type", "comment", "ordinal", "is_partition", "nullable", (now + F.make_dt_interval(secs=F.col("column_pos") / 1_000_000)).alias("loaded_at"),
        ).write.parquet(f"{path}/columns")
        counts = [tables.count(), columns.count()]
        row = self.spark.range(1).select(F.lit(batch).cast("long").alias("id"), F.lit(version).alias("metadata_version"), F.lit(source_name).cast("string").alias("source_name"), now.alias("imported_at"), F.lit(counts[0]).alias("table_count"), F.lit(counts[1]).alias("column_count"))
        row.write.parquet(f"{path}/imports")
        batches = [*state["batches"], folder]
        self.versions.store({"last": batch, "batches": batches})
        self.versions.sweep("batches", batches)
        return batch
