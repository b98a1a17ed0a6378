"""Queries p4, p6, p7 and p8 over the project's tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.contamination import leaked_items
from strandline.llm.duplicate_ledger import DuplicateLedger, with_keys
from strandline.llm.language_id import calibration, language_segments, relabelled
from strandline.llm.packing import Limits, fill_containers
from strandline.workspace import materialise, read_table, scratch_path


DELIVERIES = 2  #: requests reach the ledger in so many batches by time


def _deliver(ledger: DuplicateLedger, keyed: DataFrame, name: str) -> None:
    """Merge rows as they came in: equal spans of time, rows without a time first."""
    low, high = keyed.agg(F.min("arrived"), F.max("arrived")).first()
    span = F.lit(0) if low is None or low == high else F.coalesce(F.floor((F.unix_micros("at") - F.unix_micros(F.lit(low))) * DELIVERIES / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)))), F.lit(0))
    placed = keyed.withColumn("at", F.col("arrived").cast("timestamp")).withColumn("span", F.least(span, F.lit(DELIVERIES - 1)).cast("int"))
    for k in range(DELIVERIES):
        ledger.merge(placed.where(F.col("span") == k), f"{name}-{k}")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = materialise(with_keys(read_table(spark, sf_dir, "analyze_requests"), "sql_id", "sql", "analyze_requests", "requested_at"), "statements")
    ledger = DuplicateLedger(spark, scratch_path(spark, "ledger"))
    _deliver(ledger, keyed, "requests")
    return ledger.further_copies(keyed).select(F.col("first_id").alias("first_sql_id"), F.col("id").alias("sql_id"))


def p4_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per statement over requests and normalised texts; a statement and its normalised text count each."""
    requests = materialise(with_keys(read_table(spark, sf_dir, "analyze_requests"), "sql_id", "sql", "analyze_requests", "requested_at", True), "statements")
    results = materialise(with_keys(read_table(spark, sf_dir, "analysis_results"), "sql_id", "normalized_sql", "analysis_results", "finished_at", True), "statements")
    ledger = DuplicateLedger(spark, scratch_path(spark, "ledger"))
    _deliver(ledger, requests, "requests")
    _deliver(ledger, results, "results")
    found = ledger.records(requests.unionByName(results))
    key = F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")).alias("key")
    return found.select(key, F.col("n").alias("n_copies"), F.col("first_id").alias("first_sql_id"), "first_source", F.col("text").alias("statement"))


def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "containers"))


def _fill(placed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind of container the number in use, the share of capacity in use, and the fullest by the other constraints."""
    one = placed.groupBy("container_id", "sequence_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("a"))
    used = one.groupBy("container_id").agg(F.count("*").alias("n_sequences"), F.sum("t").alias("n_tokens"), F.max("d").alias("most_documents"), F.max("a").alias("most_attention"))
    return used.join(kinds.select("container_id", "capacity_tokens").dropDuplicates(), "container_id").withColumn("fill", F.col("n_tokens") / (F.col("n_sequences") * F.col("capacity_tokens")))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fill(p6_sequences(spark, sf_dir), read_table(spark, sf_dir, "containers"))


#: A quarter of the attention cost of a full-length document, and one document per 128 tokens: both bind.
BUDGETED = Limits(tokens_per_document=128, attention_share=0.25)


def p6_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed under a tight budget of attention cost and a tight number of documents."""
    return fill_containers(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "containers"), limits=BUDGETED)


def p6_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each constraint of ``p6_budgeted`` costs: the same packing with all, without one, and without both."""
    documents, kinds = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "containers")
    sets = {"all": BUDGETED, "no documents": replace(BUDGETED, tokens_per_document=1), "no attention": replace(BUDGETED, attention_share=1.0), "tokens only": Limits(1, 1.0)}
    parts = [_fill(fill_containers(documents, kinds, limits=limits), kinds).withColumn("constraints", F.lit(name)) for name, limits in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return leaks.where("verbatim").select("doc_id", "item_id")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document with its confidence, and the document's own language."""
    return language_segments(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "lang_codes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = read_table(spark, sf_dir, "lang_codes")
    return relabelled(p8_segments(spark, sf_dir), codes).select("doc_id", "seg_no", "lang").dropDuplicates()


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item that align well, with the score."""
    return leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language and confidence per document with prose."""
    found = p8_segments(spark, sf_dir).where("seg_no = 1")
    return found.select("doc_id", F.col("doc_lang").alias("lang"), F.col("doc_confidence").alias("confidence")).dropDuplicates()


def p8_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "lang_codes"))
