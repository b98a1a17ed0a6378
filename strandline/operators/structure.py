"""Table and CTE structure of statements, and the graphs made of it, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.lineage import DIAGNOSTICS, LINEAGE, NAMES, UNSUPPORTED, none

#: Ids, types and texts of the graphs.
RESULT_ID, RESULT_LABEL = "query_result:final", "Query Result"
TABLE_ID, CTE_ID, COLUMN_ID, OUTPUT_ID = "physical_table:", "cte:", "physical_column:", "output_column:"
WITH_TEXT = "Table structure analysis for WITH queries is handled by CTE structure analysis."
NO_TABLE_TEXT = "No physical source table can be resolved for table structure graph."
NO_WITH_TEXT = "C05 structure analysis requires a WITH/CTE query."

NODES = "array<struct<id:string,node_type:string,label:string>>"
EDGES = "array<struct<id:string,source:string,target:string,edge_type:string>>"


def node(prefix: str, kind: str, label: Column) -> Column:
    return F.struct(F.concat(F.lit(prefix), label).alias("id"), F.lit(kind).alias("node_type"), label.alias("label"))


def edge(source: Column, target: Column, kind: Column) -> Column:
    return F.struct(F.concat(F.lit("edge:"), source, F.lit("->"), target).alias("id"), source.alias("source"), target.alias("target"), kind.alias("edge_type"))


def result_node() -> Column:
    return F.struct(F.lit(RESULT_ID).alias("id"), F.lit("output").alias("node_type"), F.lit(RESULT_LABEL).alias("label"))


def first_by_id(elements: Column) -> Column:
    """Elements without those whose id came before; place and value are those of the first."""
    return F.filter(elements, lambda x, k: F.array_position(F.transform(elements, lambda y: y["id"]), x["id"]) == k + 1)


def _refused(text: str, tag: str) -> Column:
    told = F.array(F.struct(F.lit(UNSUPPORTED).alias("code"), F.lit("warning").alias("level"), F.lit(text).alias("message"))).cast(DIAGNOSTICS)
    return _outcome("partial", "unknown", none(NODES), none(EDGES), told, F.array(F.lit(tag)))


def _outcome(status: str, confidence: str, nodes: Column, edges: Column, diagnostics: Column | None = None, features: Column | None = None) -> Column:
    return F.struct(
        F.lit(status).alias("status"), F.lit(confidence).alias("confidence_level"), nodes.alias("nodes"), edges.alias("edges"),
        (none(DIAGNOSTICS) if diagnostics is None else diagnostics).alias("diagnostics"), (none(NAMES) if features is None else features).alias("features"),
    )


def table_structure() -> Column:
    """The FROM and JOIN tables of the outer query, each once, with an edge to the result."""
    tables = F.array_distinct(F.transform(F.filter("tables", lambda t: t["is_top_level"]), lambda t: t["full_name"]))
    nodes = F.concat(F.array(result_node()), F.transform(tables, lambda n: node(TABLE_ID, "table", n)))
    edges = F.transform(tables, lambda n: edge(F.concat(F.lit(TABLE_ID), n), F.lit(RESULT_ID), F.lit("table_to_result")))
    return (
        F.when(F.col("has_with"), _refused(WITH_TEXT, "cte_query"))
        .when(F.size(tables) == 0, _refused(NO_TABLE_TEXT, "missing_source_table"))
        .otherwise(_outcome("success", "medium", nodes.cast(NODES), edges.cast(EDGES)))
    )


def cte_structure() -> Column:
    """CTEs, the tables that feed them at any depth, and what the outer query reads directly.

    A CTE's reference to itself gives no edge; a name is a CTE wherever the outer WITH defines it.
    """
    names = F.array_distinct("ctes")
    is_cte = lambda t: F.array_contains(names, t["full_name"])
    ident = lambda t: F.concat(F.when(is_cte(t), F.lit(CTE_ID)).otherwise(F.lit(TABLE_ID)), t["full_name"])
    inner = F.filter("tables", lambda t: (t["scope"] == "cte") & (t["full_name"] != t["scope_name"]))
    outer = F.filter("tables", lambda t: t["is_top_level"])
    as_table = lambda tables: F.transform(F.filter(tables, lambda t: ~is_cte(t)), lambda t: node(TABLE_ID, "table", t["full_name"]))
    nodes = F.concat(F.transform(names, lambda n: node(CTE_ID, "cte", n)), as_table(inner), F.array(result_node()), as_table(outer))
    feeds = F.transform(inner, lambda t: edge(ident(t), F.concat(F.lit(CTE_ID), t["scope_name"]), F.when(is_cte(t), "cte_dependency").otherwise("table_to_cte")))
    ends = F.transform(outer, lambda t: edge(ident(t), F.lit(RESULT_ID), F.when(is_cte(t), "cte_to_result").otherwise("table_to_result")))
    found = _outcome("success", "medium", F.array_distinct(nodes).cast(NODES), F.array_distinct(F.concat(feeds, ends)).cast(EDGES))
    return F.when(F.col("has_with"), found).otherwise(_refused(NO_WITH_TEXT, "non_cte_query"))


def column_graph(lineages: Column) -> Column:
    """Nodes and edges of column lineage, each id once; equal output names share a node."""
    label = lambda l: F.concat(l["source_table"], F.lit("."), l["source_column"])
    pairs = F.flatten(F.transform(lineages, lambda l: F.array(node(COLUMN_ID, "physical_column", label(l)), node(OUTPUT_ID, "output_column", l["output_column"]))))
    edges = F.transform(lineages, lambda l: edge(F.concat(F.lit(COLUMN_ID), label(l)), F.concat(F.lit(OUTPUT_ID), l["output_column"]), F.lit("column_lineage")))
    return F.struct(F.array_distinct(pairs).cast(NODES).alias("nodes"), F.array_distinct(edges).cast(EDGES).alias("edges"))


def merge_graphs(*graphs: tuple[Column, Column]) -> tuple[Column, Column]:
    """Nodes and edges of several graphs in order; the first of an id stays."""
    return F.array_distinct(F.concat(*[g[0] for g in graphs])), F.array_distinct(F.concat(*[g[1] for g in graphs]))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an empty end or one that is no node of their statement; a valid graph has none."""
    ids = nodes.select("sql_id", F.col("id").alias("end")).dropDuplicates()
    ends = edges.select("sql_id", F.col("id").alias("edge_id"), F.explode(F.array("source", "target")).alias("end"))
    bad = ends.where(F.col("end").isNull() | (F.col("end") == "")).unionByName(ends.where(F.col("end") != "").join(ids, ["sql_id", "end"], "left_anti").select(*ends.columns))
    return bad.select("sql_id", "edge_id").dropDuplicates()


def check_graph(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise ValueError if an edge has no end."""
    bad = dangling_edges(nodes, edges).limit(1).collect()
    if bad:
        raise ValueError(f"Graph edge {bad[0]['edge_id']} of statement {bad[0]['sql_id']} has a missing end.")


__all__ = ["EDGES", "LINEAGE", "NODES", "check_graph", "column_graph", "cte_structure", "dangling_edges", "first_by_id", "merge_graphs", "table_structure"]
