"""The analysis of a corpus of statements: one nested result row per statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.lineage import DIAGNOSTICS, NAMES, PARSE_ERROR, attach_metadata, none, resolve
from strandline.operators.structure import EDGES, NODES, column_graph, cte_structure, merge_graphs, table_structure
from strandline.sources.statements import parse_statements

#: What every result says of itself, and the stages' messages.
SCHEMA_VERSION, ANALYSIS_ID = "0.3.0-c05", "analysis:c05"
STAGE_TEXTS = {
    "sql_parse": "SQL parsed successfully.",
    "cte_subquery_rollup": "CTE structure dependencies resolved.",
    "table_structure": "Physical table to Query Result structure resolved.",
    "join_alias_resolve": "Join aliases and selected column ownership resolved.",
    "cte_graph": "GraphViewModel built from CTE structure dependencies.",
    "graph": "GraphViewModel built from table structure and column lineage.",
}
STAGES = "array<struct<stage:string,status:string,diagnostic_codes:array<string>,message:string>>"


def _stage(name: str, status: Column, diagnostics: Column, text: Column | None = None) -> Column:
    codes = F.transform(diagnostics, lambda d: d["code"])
    return F.struct(F.lit(name).alias("stage"), status.alias("status"), codes.alias("diagnostic_codes"), (F.lit(STAGE_TEXTS[name]) if text is None else text).alias("message"))


def _graph_stage(key: str) -> Column:
    return F.struct(F.lit("graph_build").alias("stage"), F.lit("success").alias("status"), none(NAMES).alias("diagnostic_codes"), F.lit(STAGE_TEXTS[key]).alias("message"))


def analyze(statements: DataFrame, columns_by_name: DataFrame, with_metadata: bool = True) -> DataFrame:
    """One result per statement of ``sources.statements.statements``.

    Text that begins with ``with`` gets its CTE structure, other text its tables and column lineage, the
    graphs merged.  A statement that fails to parse, and one whose graph isn't asked for, has an empty
    graph.  What can't be determined is a diagnostic, in the order parse, structure, resolution, not
    deduplicated.  Elapsed times aren't part of the result.
    """
    facts = attach_metadata(parse_statements(statements), columns_by_name)
    return assemble(resolve(facts, with_metadata))


def assemble(facts: DataFrame) -> DataFrame:
    """Result rows from resolved facts."""
    ok, graph, cte = F.col("parse_ok"), F.col("include_graph"), F.col("sniffs_cte")
    facts = facts.withColumns({"_structure": F.when(cte, cte_structure()).otherwise(table_structure()), "_columns": column_graph(F.col("resolved.lineages"))})
    full = ok & graph
    structure, resolved = F.col("_structure"), F.col("resolved")
    parse_told = F.when(ok, none(DIAGNOSTICS)).otherwise(F.array(F.struct(F.lit(PARSE_ERROR).alias("code"), F.lit("error").alias("level"), F.col("error").alias("message"))).cast(DIAGNOSTICS))
    told = F.concat(parse_told, F.when(full, structure["diagnostics"]).otherwise(none(DIAGNOSTICS)), F.when(full & ~cte, resolved["diagnostics"]).otherwise(none(DIAGNOSTICS)))
    features = F.concat(F.when(full, structure["features"]).otherwise(none(NAMES)), F.when(full & ~cte, resolved["features"]).otherwise(none(NAMES)))
    merged = merge_graphs((structure["nodes"], structure["edges"]), (F.col("_columns")["nodes"], F.col("_columns")["edges"]))
    nodes = F.when(full & cte, structure["nodes"]).when(full, merged[0]).otherwise(none(NODES))
    edges = F.when(full & cte, structure["edges"]).when(full, merged[1]).otherwise(none(EDGES))
    both = F.when((structure["status"] == "partial") | (resolved["status"] == "partial"), "partial").otherwise(resolved["status"])
    status = F.when(~ok, "failed").when(~graph, "success").when(cte, structure["status"]).otherwise(both)
    facts = facts.withColumns({"nodes": nodes, "edges": edges, "diagnostics": told, "unsupported_features": features, "status": status})
    confidence = F.when(~ok, "unknown").when(full & cte, structure["confidence_level"]).when(F.col("status") == "success", "high").otherwise("unknown")
    has_graph = F.size("nodes") > 0
    stages = F.concat(
        F.array(_stage("sql_parse", F.when(ok, "success").otherwise("failed"), parse_told, F.when(ok, STAGE_TEXTS["sql_parse"]).otherwise(F.col("error")))).cast(STAGES),
        F.when(full & cte, F.array(_stage("cte_subquery_rollup", structure["status"], structure["diagnostics"])))
        .when(full, F.array(_stage("table_structure", structure["status"], structure["diagnostics"]), _stage("join_alias_resolve", resolved["status"], resolved["diagnostics"])))
        .otherwise(none(STAGES)).cast(STAGES),
        F.when(has_graph & cte, F.array(_graph_stage("cte_graph"))).when(has_graph, F.array(_graph_stage("graph"))).otherwise(none(STAGES)).cast(STAGES),
    )
    level = lambda name: F.size(F.filter("diagnostics", lambda d: d["level"] == name))
    fields = F.transform("items", lambda i: F.struct(i["name"].alias("name"), i["name"].alias("display_name"), i["expression"].alias("expression"), i["source_type"].alias("source_type")))
    return facts.select(
        "sql_id", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(ANALYSIS_ID).alias("analysis_id"), "status", confidence.alias("confidence_level"), "dialect",
        stages.alias("stage_statuses"), "unsupported_features", "diagnostics", level("error").alias("error_count"), level("warning").alias("warning_count"), level("info").alias("info_count"),
        F.when(~has_graph, "column").when(cte, "subquery_dependency").otherwise("table").alias("view_mode"), "nodes", "edges", fields.alias("output_fields"),
        F.size("nodes").alias("node_count"), F.size("edges").alias("edge_count"), F.size("items").alias("output_field_count"),
    )


def result_json(results: DataFrame) -> DataFrame:
    """``sql_id, body``: each result as one JSON text."""
    return results.select("sql_id", F.to_json(F.struct(*[c for c in results.columns if c != "sql_id"])).alias("body"))


def diagnostics_of(results: DataFrame) -> DataFrame:
    rows = results.select("sql_id", F.posexplode("diagnostics").alias("ord", "d"))
    return rows.select("sql_id", "ord", "d.*")


def nodes_of(results: DataFrame) -> DataFrame:
    rows = results.select("sql_id", F.posexplode("nodes").alias("ord", "n"))
    return rows.select("sql_id", "ord", "n.*")


def edges_of(results: DataFrame) -> DataFrame:
    rows = results.select("sql_id", F.posexplode("edges").alias("ord", "e"))
    return rows.select("sql_id", "ord", "e.*")


def health(spark) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit("strandline").alias("service"), F.lit("0.1.0").alias("version"))
