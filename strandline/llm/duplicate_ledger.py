"""Duplicates hidden by formatting differences: a ledger of canonical keys with their counts.

Method: an incremental ledger.  It is one bucketed table, a partition per bucket.  Each new batch is
aggregated into the same buckets, full-outer-joined with those that it touches, counts are added and the
earliest representative is kept.  Only touched buckets are read and written again; the state in force,
turned last, names the folder of each bucket and the batches that are in, so a run that dies leaves the
old ledger in force and a batch merged twice counts once.

Scale: a batch is aggregated before its shuffle, so a statement that makes up a third of all rows is
one partial row per task; the ledger itself is never shuffled.  It has one row of four numbers per distinct
statement; texts stay where they are and are fetched for representatives only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.canonical_sql import canonical_key
from strandline.plans.skew import join_counted
from strandline.plans.versions import Versions

KEY = ["k1", "k2"]
LEDGER_SCHEMA = "k1 long, k2 long, n long, first_id long, first_source string"
MEMO_CHARS = 8192  #: texts up to this length are canonicalised once per task while they keep coming

_remembered = lru_cache(maxsize=2048)(canonical_key)


def _key(text: str | None) -> tuple[int, int] | None:
    if not isinstance(text, str):
        return None
    return _remembered(text) if len(text) <= MEMO_CHARS else canonical_key(text)


def with_keys(rows: DataFrame, id_column: str, text_column: str, source: str = "", arrived: str | None = None, with_text: bool = False) -> DataFrame:
    """``id, source, k1, k2`` of every distinct (id, canonical form); text without a word or id is left out.

    ``arrived`` names a column of which the earliest value comes along, ``with_text`` adds the smallest text
    of that form.
    """
    more = (["arrived"] if arrived else []) + (["text"] if with_text else [])

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_key(t) for t in batch["text"]]
            good = [k is not None for k in found]
            out = batch[good]
            pairs = [k for k in found if k is not None]
            yield out[["id", *more]].assign(k1=[k[0] for k in pairs], k2=[k[1] for k in pairs])[["id", "k1", "k2", *more]]

    slim = rows.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
    slim = slim.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), *([F.col(arrived).alias("arrived")] if arrived else []))
    kinds = {"arrived": dict(slim.dtypes).get("arrived"), "text": "string"}
    keyed = slim.mapInPandas(keys, ", ".join(["id long, k1 long, k2 long", *(f"{c} {kinds[c]}" for c in more)]))
    return keyed.groupBy("id", *KEY).agg(F.lit(source).alias("source"), *[F.min(c).alias(c) for c in more])


class DuplicateLedger:
    """Counts and earliest representative of every canonical key, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None) -> None:
        self.spark, self.root, self.versions = spark, root.rstrip("/"), Versions(spark, root)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _state(self) -> dict:
        state = self.versions.load()
        if state is None:
            state = {"buckets": self.buckets, "at": {}, "batches": []}
            self.versions.store(state)
        return state

    def _attach(self, state: dict, buckets: list[str]) -> str:
        """A table over the folders of some buckets."""
        table = f"strandline_ledger_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({LEDGER_SCHEMA}, bucket int) USING parquet PARTITIONED BY (bucket) CLUSTERED BY (k1, k2) INTO {state['buckets']} BUCKETS LOCATION '{self.root}/none'")
        held = [b for b in buckets if b in state["at"]]
        for k in range(0, len(held), 200):
            parts = " ".join(f"PARTITION (bucket={b}) LOCATION '{self.root}/data/{state['at'][b]}/bucket={b}'" for b in held[k : k + 200])
            self.spark.sql(f"ALTER TABLE {table} ADD {parts}")
        return table

    def rows(self) -> DataFrame:
        """The ledger in force: see ``LEDGER_SCHEMA``; readable until the merge after the next."""
        at = self._state()["at"]
        if not at:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*[f"{self.root}/data/{folder}/bucket={b}" for b, folder in at.items()])

    def merge(self, batch: DataFrame, name: str) -> None:
        """Add rows of :func:`with_keys`, read twice; ids new to the ledger.

        ``name`` tells the batch: one that is in already is left out.  An empty batch changes nothing else.
        """
        state = self._state()
        if name in state["batches"]:
            return
        bucket = F.pmod(F.hash(*KEY), F.lit(state["buckets"]))  # as tables are bucketed
        touched = [str(r[0]) for r in batch.select(bucket.alias("b")).distinct().collect()]  # one row per bucket
        fresh = batch.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("id", "source")).alias("first"))
        old, new = self._attach(state, touched), f"strandline_ledger_{uuid.uuid4().hex}"
        folder = uuid.uuid4().hex[:12]
        try:
            held = self.spark.table(old).where(F.col("bucket").isin([int(b) for b in touched]))
            held = held.select(*KEY, F.col("n").alias("old_n"), F.struct(F.col("first_id").alias("id"), F.col("first_source").alias("source")).alias("old_first"))
            both = fresh.join(held, KEY, "full")
            first = F.least(F.coalesce("first", "old_first"), F.coalesce("old_first", "first"))
            merged = both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("old_n", F.lit(0))).alias("n"), first.alias("f"))
            merged = merged.select(*KEY, "n", F.col("f.id").alias("first_id"), F.col("f.source").alias("first_source"), bucket.alias("bucket"))
            if touched:
                merged.write.format("parquet").partitionBy("bucket").bucketBy(state["buckets"], *KEY).option("path", f"{self.root}/data/{folder}").saveAsTable(new)
        finally:
            for table in (old, new):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        before = set(state["at"].values())
        state["at"].update({b: folder for b in touched})
        state["batches"].append(name)
        self.versions.store(state)
        self.versions.sweep("data", before | set(state["at"].values()))  # the folders of the state before stay for readers

    def further_copies(self, rows: DataFrame) -> DataFrame:
        """``first_id, id``: every row of ``rows`` that isn't the earliest of its group."""
        groups = self.rows().where("n > 1").select(F.struct(*KEY).alias("key"), "n", "first_id")
        total = groups.agg(F.sum("n")).first()[0] or 0
        found = join_counted(rows.select(F.struct(*KEY).alias("key"), "id"), groups, "key", "n", total)
        return found.where("id <> first_id").select("first_id", "id")

    def records(self, rows: DataFrame) -> DataFrame:
        """The ledger with the text of each representative, taken from ``rows`` of :func:`with_keys` with text."""
        texts = rows.select(*KEY, F.col("id").alias("first_id"), F.col("source").alias("first_source"), "text")
        return self.rows().join(texts, [*KEY, "first_id", "first_source"], "left")
