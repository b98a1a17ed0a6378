"""Nested JSON bodies to flat related tables.

Method: one pass over each body; a depth-first visitor emits rows of (tag, key, parent key, payload).
They are written once, partitioned by tag, and each tag is read back under its own schema.  Which arrays
of objects become tables of their own, at any depth, is a parameter; other arrays that hold objects are
emitted under the tag ``other`` with their path, so nothing is lost.

Scale: bodies are read where they lie and never shuffled; only flat rows move.  A row's key is its
body's id and digest with the positions on the way to it, so bodies that share an id don't mix, and
repeated bodies collapse in a map-side-combined aggregate over flat rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import hashed
from strandline.workspace import scratch_path

EMITTED = "tag string, payload_id long, body_id long, pos array<long>, parent array<long>, path string, payload string"
OTHER = "other"
#: Tables by tag: the way of array fields from the body, and the scalar fields.
SHAPE = {
    "payload": ((), "metadata_version string, source_name string, default_catalog string, default_schema string, case_sensitive string"),
    "table": (("tables",), "catalog string, schema string, table_name string, name string, comment string, table_type string"),
    "column": (("tables", "columns"), "name string, data_type string, comment string, ordinal string, is_partition string, nullable string"),
}

_OUTER_BLANKS = " \t\r\n\f\v\x85\xa0​﻿　"


def _constant(text: str) -> Any:
    raise ValueError(text)


def decode_object(body: str | None) -> dict | None:
    """The JSON object that a text holds completely, else None."""
    try:
        value = json.loads(body.strip(_OUTER_BLANKS), parse_constant=_constant)
    except (ValueError, AttributeError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def unwrap(envelope: dict | None) -> dict | None:
    """The import body, bare or inside ``{"mode", "payload"}``, the payload maybe a JSON text itself."""
    if envelope is None or "tables" in envelope or "payload" not in envelope:
        return envelope
    inner = envelope["payload"]
    return inner if isinstance(inner, dict) else decode_object(inner) if isinstance(inner, str) else None


_flat = json.JSONEncoder(ensure_ascii=False).encode
_nested = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


class Visitor:
    """Depth-first over one object: ``(tag, positions, parent's positions, path, payload)`` of each object met.

    A field on a declared way is a table: an array, or one object, which is an array of one.  Any other
    array that holds an object is told under ``other``.  What isn't a table stays a field, nested values as text.
    """

    def __init__(self, shape: Mapping[str, tuple[tuple[str, ...], str]]) -> None:
        self.tags = {way: tag for tag, (way, _) in shape.items()}

    def visit(self, node: dict, way: tuple[str, ...] = (), at: tuple[int, ...] = ()) -> Iterator[tuple]:
        todo = [(node, way, at)]  # a stack of its own: depth is that of the decoder, not of Python calls
        while todo:
            node, way, at = todo.pop()
            below, flat = [], {}
            for name, value in node.items():
                if value is None or value.__class__ is str:
                    flat[name] = value
                elif not isinstance(value, (list, dict)):
                    flat[name] = _flat(value)
                else:
                    deeper = (*way, name)
                    declared = deeper in self.tags
                    inner = value if isinstance(value, list) else [value] if declared else ()
                    objects = [(x, deeper, (*at, k)) for k, x in enumerate(inner) if isinstance(x, dict)]
                    below += objects
                    if not declared and not objects:
                        flat[name] = _nested(value)
            yield self.tags.get(way, OTHER), at, at[:-1] if at else None, ".".join(way), _flat(flat)
            below.reverse()
            todo += below


def flatten_payloads(payloads: DataFrame, key: str = "payload_id", body: str = "body", shape: Mapping[str, tuple[tuple[str, ...], str]] = SHAPE) -> dict[str, DataFrame]:
    """One flat table per tag of ``shape``, and ``other``.

    A table has ``payload_id, body_id``, one ``<tag>_pos`` per array on the way to it (for ``payload`` none) and
    its fields; a child's parent has the same leading columns without the last position.  ``other`` has the
    positions as an array, ``path`` and the object's fields as JSON text.

    Positions count from 0 in the arrays as sent; null and non-object elements keep their place and
    yield nothing.  Bodies that are null, empty, cut off or not one JSON object yield no rows at all; so do
    rows without a key.  Fields that are absent or null are null; nested extras stay JSON text.  Whole-row
    repeats count once; bodies of one key that differ are bodies of their own.
    """
    spark = payloads.sparkSession
    visitor = Visitor(shape)
    longs = pa.list_(pa.int64())
    kinds = [("tag", pa.string()), ("payload_id", pa.int64()), ("body_id", pa.int64()), ("pos", longs), ("parent", longs), ("path", pa.string()), ("payload", pa.string())]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for payload_id, body_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                root = unwrap(decode_object(text))
                if root is not None:
                    for tag, *rest in visitor.visit(root):
                        rows.append((tag, payload_id, body_id, *rest))
                        if len(rows) >= 20_000:
                            yield packed(rows)
                            rows = []
            yield packed(rows)

    row = hashed(*[F.col(f"`{c}`").cast("string") for c in payloads.columns])
    slim = payloads.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("payload_id"), row.alias("body_id"), F.col(body).alias("body"))
    path = scratch_path(spark, "flattened")
    slim.mapInArrow(emit, EMITTED).write.partitionBy("tag").parquet(path)
    wide = spark.read.schema(EMITTED).parquet(path)
    tag_of = {way: tag for tag, (way, _) in shape.items()}
    out = {}
    for tag, (way, schema) in shape.items():
        links = [f"{tag_of.get(way[: k + 1], way[k])}_pos" for k in range(len(way))]
        rows = wide.where(F.col("tag") == tag).select("payload_id", "body_id", *[F.col("pos")[k].alias(n) for k, n in enumerate(links)], F.from_json("payload", schema).alias("f"))
        out[tag] = rows.dropDuplicates(["payload_id", "body_id", *links]).select("payload_id", "body_id", *links, "f.*")
    out[OTHER] = wide.where(F.col("tag") == OTHER).select("payload_id", "body_id", "pos", "path", "payload").dropDuplicates(["payload_id", "body_id", "pos", "path"])
    return out


def named_columns(flat: dict[str, DataFrame]) -> DataFrame:
    """One row per named column object with its table's position and name; see ``flatten_payloads``.

    A table's name is ``table_name``, else ``name``, else ''; a table without any named column yields
    one row with column position -1 and column name ''.
    """
    on = ["payload_id", "body_id", "table_pos"]
    tables = flat["table"].select(*on, F.coalesce("table_name", "name", F.lit("")).alias("table_name"))
    columns = flat["column"].where(F.col("name").isNotNull()).select(*on, "column_pos", F.col("name").alias("column_name"))
    return tables.join(columns, on, "left").select(
        *on, "table_name", F.coalesce("column_pos", F.lit(-1)).cast("long").alias("column_pos"), F.coalesce("column_name", F.lit("")).alias("column_name")
    )
