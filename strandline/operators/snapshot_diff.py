"""What changed between consecutive full snapshots.

Method: a bucketed key-to-hash index of the last snapshot of every source is kept.  The rows of a new
batch probe it bucket by bucket; only for keys that differ are values fetched, from the rows at rest;
then the batch's own key-to-hash rows take the place of the old ones of its sources.

A batch may hold several consecutive snapshots of one source: its rows are pivoted into one row per
key with the hash in each of them, so every snapshot is compared with its predecessor in the same pass.

Scale: hashes are taken before anything moves; what is shuffled is one slim row per key, combined on
the map side, into the buckets of the index, which isn't moved.  Only the index rows of the batch's
sources are written again.  Digests spread evenly, so neither a source nor a table that holds a third
of all rows makes a hot bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import digest, hashed
from strandline.plans.ordered import with_rank
from strandline.plans.versions import Versions
from strandline.workspace import materialise, scratch_path

_KEY = ["_k1", "_k2"]
WIDTH = 16  #: snapshots of one source in one pass; more take more passes
FETCH_BY_BROADCAST = 500_000  #: up to so many differing keys are sent to the rows at rest; more are joined by shuffle


@dataclass(frozen=True)
class SnapshotSpec:
    """Names of the columns; ``compared`` maps each value column to the form in which it is compared."""

    source: str
    snapshot: str
    key: Sequence[str]
    compared: dict[str, Column]
    version: Sequence[str]  #: of several rows for one key in one snapshot the greatest holds


def order_snapshots(imports: DataFrame, snapshot: str, source: str, at: str) -> DataFrame:
    """``<snapshot>, _src, rank``: the place of every snapshot among those of its source by ``at``, then id.

    Whole-row repeats count once.  A null time sorts first; a null source is a source of its own.
    """
    slim = imports.select(snapshot, hashed(F.col(source).cast("string")).alias("_src"), at).dropDuplicates()
    return materialise(with_rank(slim, "_src", [at, snapshot], "snapshots").select(snapshot, "_src", "rank"), "snapshots")


class SnapshotIndex:
    """The index under ``root``: key-to-hash rows in one bucketed table, a partition per pass.

    The state in force names the partition that holds the last snapshot of each source; rows of other
    partitions are dead and dropped once no source needs them.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None) -> None:
        self.spark, self.root, self.versions = spark, root.rstrip("/"), Versions(spark, root)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    _SOURCES = "_src long, done long, last long, gen string"

    def _sources(self, state: dict) -> DataFrame:
        """How many snapshots of each source are indexed, the last of them, and where it lies."""
        if not state["sources"]:
            return self.spark.createDataFrame([], self._SOURCES)
        return self.spark.read.schema(self._SOURCES).parquet(f"{self.root}/sources/{state['sources']}")

    def _attach(self, table: str, state: dict) -> None:
        self.spark.sql(
            f"CREATE TABLE {table} (_k1 long, _k2 long, _src long, _hash long, _diffs array<struct<r:int,kind:string>>, gen string) USING parquet "
            f"PARTITIONED BY (gen) CLUSTERED BY (_k1, _k2) INTO {state['buckets']} BUCKETS LOCATION '{self.root}/index'"
        )
        if state["gens"]:
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")

    def apply(self, rows: DataFrame, order: DataFrame, spec: SnapshotSpec, archive: DataFrame | None = None, slices: int = 1, values: bool = True) -> DataFrame:
        """Changes of the snapshots not yet indexed, one row per key that differs from the predecessor.

        ``rows`` holds the rows of the new snapshots; ``archive`` all rows at rest, from which those of
        differing keys are fetched (default: ``rows``).  ``order`` comes from :func:`order_snapshots` over all
        snapshots so far.  ``slices`` is the least number of passes; each probes what the one before left.

        Result: the snapshot, the key columns, ``change_type`` and, with ``values``, the structs ``old`` and
        ``new`` (null where there is none).  A source's first snapshot yields nothing; a snapshot without
        rows removes all keys; rows of unknown and of indexed snapshots don't count, so a batch told twice
        is told once.  A snapshot that sorts before an indexed one raises ValueError.  Changes are written
        before the state is turned: a run that dies is simply repeated.
        """
        state = self.versions.load()
        if state is None:
            state = {"buckets": self.buckets, "gens": [], "sources": ""}
            self.versions.store(state)
        sources = self._sources(state)
        known = order.join(sources, "_src", "left").withColumn("done", F.coalesce("done", F.lit(0)))
        late = (F.col("rank") == F.col("done") - 1) & (F.col(spec.snapshot) != F.col("last"))
        newest, out_of_order = known.agg(F.max(F.col("rank") - F.col("done")), F.max(late)).first()
        if out_of_order:
            raise ValueError("a snapshot sorts before one that is indexed")
        fresh = known.withColumn("new", F.col("rank") - F.col("done")).where("new >= 0")
        most = max(0 if newest is None else newest, 0) + 1
        passes = max(1, min(slices, most), -(-most // WIDTH))
        width = -(-most // passes)
        fresh = fresh.withColumns({"_pass": F.floor(F.col("new") / width).cast("int"), "_r": (F.col("new") % width).cast("int")})
        sizes = fresh.groupBy("_src", "_pass").agg(F.count("*").alias("_n"), F.max(F.col("rank")).alias("top"), F.max_by(spec.snapshot, "rank").alias("last_of_pass"), F.max("done").alias("done"))
        sizes = sizes.withColumn("_prior", (F.col("done") > 0) | (F.col("_pass") > 0))
        line = materialise(fresh.select(spec.snapshot, "_src", "_pass", "_r").join(sizes, ["_src", "_pass"]), "line")
        staged = scratch_path(self.spark, "staged")
        slim = rows.join(line.select(spec.snapshot, "_src", "_pass", "_r", "_n", "_prior"), spec.snapshot)
        slim = slim.select(*self._digest(spec), self._hash(spec, rows), "_src", "_pass", "_r", "_n", "_prior", F.struct(*spec.version).alias("_ver"))
        slim.write.partitionBy("_pass").parquet(staged)
        table = f"strandline_index_{uuid.uuid4().hex}"
        self._attach(table, state)
        try:
            new_gens = [uuid.uuid4().hex[:16] for _ in range(passes)]
            for k, gen in enumerate(new_gens):
                touched = line.where(F.col("_pass") == k).select("_src", "_n", "_prior").dropDuplicates()
                batch = self.spark.read.schema(slim.schema).parquet(staged).where(F.col("_pass") == k)
                self._probe(table, state["buckets"], batch, touched, self._moved(sources, line, new_gens[:k]), width, state["gens"] + new_gens[:k], gen)
            told = self.spark.table(table).where(F.col("gen").isin(new_gens) & (F.size("_diffs") > 0)).select(*_KEY, "_src", "gen", F.explode("_diffs").alias("d"))
            told = told.join(line.select("_src", self._gen_of(new_gens).alias("gen"), "_n", "top").dropDuplicates(), ["_src", "gen"])
            told = told.select(*_KEY, "_src", (F.col("top") - F.col("_n") + 1 + F.col("d.r")).alias("rank"), F.col("d.kind").alias("change_type"))
            differences = materialise(told, "differences")
            changes = materialise(self._fetch(differences, order, rows if archive is None else archive, spec, values), "changes")
            where = f"s-{uuid.uuid4().hex[:12]}"
            self._moved(sources, line, new_gens).coalesce(1).write.parquet(f"{self.root}/sources/{where}")
            state = {**state, "sources": where}
            live = [r[0] for r in self._sources(state).select("gen").distinct().collect()]  # at most one per pass since the oldest live one
            self.versions.store({**state, "gens": live})
            self.versions.sweep("index", [f"gen={g}" for g in live])
            self.versions.sweep("sources", [where])
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        return changes

    @staticmethod
    def _gen_of(gens: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, gens)), F.col("_pass") + 1)

    def _moved(self, sources: DataFrame, line: DataFrame, gens: list[str]) -> DataFrame:
        """Where each source's last snapshot lies after the passes that wrote ``gens``."""
        if not gens:
            return sources
        newest = line.where(F.col("_pass") < len(gens)).groupBy("_src").agg(F.max_by(F.struct((F.col("top") + 1).alias("done"), F.col("last_of_pass").alias("last"), self._gen_of(gens).alias("gen")), "_pass").alias("s"))
        return sources.join(newest, "_src", "left_anti").unionByName(newest.select("_src", "s.*"))

    @staticmethod
    def _digest(spec: SnapshotSpec) -> list[Column]:
        return [c.alias(n) for n, c in zip(_KEY, digest(F.col("_src"), *[F.col(k).cast("string") for k in spec.key]))]

    @staticmethod
    def _hash(spec: SnapshotSpec, rows: DataFrame) -> Column:
        """``_hash`` where the caller took it already, before joining; else over the compared forms."""
        return F.col("_hash") if "_hash" in rows.columns else hashed(*spec.compared.values()).alias("_hash")

    def _probe(self, table: str, buckets: int, batch: DataFrame, touched: DataFrame, sources: DataFrame, width: int, gens: list[str], gen: str) -> None:
        """Join the batch with the index rows of its sources and write what takes their place, with the differences."""
        at = [F.max_by("_hash", F.when(F.col("_r") == r, F.col("_ver"))).alias(f"_h{r}") for r in range(width)]
        wide = batch.groupBy(*_KEY).agg(*at, F.min("_src").alias("_src"), F.min("_n").alias("_n"), F.max("_prior").alias("_prior"))
        mine = touched.select("_src", "_n", "_prior").join(sources.select("_src", "gen"), "_src")
        old = self.spark.table(table).where(F.col("gen").isin(gens or [""]) & F.col("_hash").isNotNull()).join(mine, ["_src", "gen"])
        old = old.select(*_KEY, F.col("_hash").alias("_old"), F.col("_src").alias("_os"), F.col("_n").alias("_on"))
        both = wide.join(old, _KEY, "full") if gens else wide.withColumns({c: F.lit(None).cast("long") for c in ("_old", "_os", "_on")})
        both = both.withColumns({"_n": F.coalesce("_n", "_on"), "_src": F.coalesce("_src", "_os"), "_prior": F.coalesce("_prior", F.lit(True))})
        both = both.withColumn("_s", F.array("_old", *[F.col(f"_h{r}") for r in range(width)]))
        told = []
        for r in range(width):
            before, now = F.col("_s")[r], F.col("_s")[r + 1]
            counts = (F.col("_n") > r) & (F.lit(r > 0) | F.col("_prior")) & ~before.eqNullSafe(now)
            kind = F.when(before.isNull(), "added").when(now.isNull(), "removed").otherwise("changed")
            told.append(F.when(counts, F.struct(F.lit(r).alias("r"), kind.alias("kind"))))
        diffs = F.filter(F.array(*told), lambda x: x.isNotNull()).alias("_diffs")
        out = both.select(*_KEY, "_src", F.get("_s", F.col("_n").cast("int")).alias("_hash"), diffs, F.lit(gen).alias("gen"))
        (out.write.format("parquet").partitionBy("gen").bucketBy(buckets, *_KEY).mode("append").option("path", f"{self.root}/index").saveAsTable(table))

    def _fetch(self, differences: DataFrame, order: DataFrame, archive: DataFrame, spec: SnapshotSpec, values: bool) -> DataFrame:
        """Key columns and values of the differing keys, from the rows at rest."""
        s = spec.snapshot
        place = order.select("_src", "rank", s)
        asked = differences.join(place, ["_src", "rank"]).withColumnRenamed(s, "_at")
        asked = asked.join(place.select("_src", (F.col("rank") + 1).alias("rank"), F.col(s).alias("_before")), ["_src", "rank"])
        new = asked.where("change_type <> 'removed'").select(*_KEY, "_src", "_at", "change_type", F.col("_at").alias(s), F.lit(True).alias("_is_new"))
        old = asked.where(F.lit(values) | (F.col("change_type") == "removed")).where("change_type <> 'added'").select(*_KEY, "_src", "_at", "change_type", F.col("_before").alias(s), F.lit(False).alias("_is_new"))
        wanted = new.unionByName(old)
        if differences.count() <= FETCH_BY_BROADCAST:
            wanted = F.broadcast(wanted)
        kept = [c for c in dict.fromkeys([s, *spec.key, *(spec.compared if values else ()), *spec.version])]
        rows = archive.select(*kept).join(order.select(s, "_src"), s).withColumns(dict(zip(_KEY, digest(F.col("_src"), *[F.col(k).cast("string") for k in spec.key]))))
        got = rows.join(wanted, [*_KEY, "_src", s])
        side = lambda new: F.max_by(F.struct(*spec.compared), F.when(F.col("_is_new") == new, F.struct(*spec.version)))
        told = [side(False).alias("old"), side(True).alias("new")] if values else []
        one = got.groupBy(*_KEY, "_at").agg(F.first(F.struct(*spec.key)).alias("_k"), F.first("change_type").alias("change_type"), *told)
        return one.select(F.col("_at").alias(s), *[F.col("_k")[k].alias(k) for k in spec.key], "change_type", *(["old", "new"] if values else []))
