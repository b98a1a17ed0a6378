"""Queries for the lineage operators over the project's tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sql_format import formatted
from strandline.operators import analysis, catalog, expression_lineage, structure, views
from strandline.operators.lineage import attach_metadata, column_lineage, resolve
from strandline.plans import corpora, lineage_oracle
from strandline.plans.data_oracles import BLANK
from strandline.sources import statements as st
from strandline.sources.nested_json import flatten_payloads
from strandline.workspace import materialise, read_table


# --- catalog --------------------------------------------------------------------------------------


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_columns(read_table(spark, sf_dir, "table_metadata"), read_table(spark, sf_dir, "column_metadata"))


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_tables(read_table(spark, sf_dir, "table_metadata"))


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_int_flags(_latest(spark, sf_dir))


def catalog_columns_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.columns_of_table(_latest(spark, sf_dir), "dwd_trade_event_wide_di").drop("table_id")


def catalog_columns_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.columns_by_name(_latest(spark, sf_dir)).select("table_name", F.array_join("columns", ",").alias("columns"))


def catalog_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_tables(read_table(spark, sf_dir, "table_metadata"))


def _flat(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return flatten_payloads(read_table(spark, sf_dir, "metadata_payloads"))


def import_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    return catalog.import_changes(catalog.payload_tables(flat), catalog.payload_columns(flat), "added").drop("body_id")


def import_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a commit tells it: payloads whose version exists change nothing."""
    flat = _flat(spark, sf_dir)
    changes = catalog.import_changes(catalog.payload_tables(flat), catalog.payload_columns(flat), "added")
    return catalog.with_known_versions(changes, flat["payload"], read_table(spark, sf_dir, "metadata_imports")).drop("body_id")


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    return catalog.import_summary(catalog.payload_tables(flat), catalog.payload_columns(flat)).drop("body_id")


def import_change_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.change_groups(import_preview(spark, sf_dir))


def import_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importer's own log by type, whole-row repeats once."""
    log = read_table(spark, sf_dir, "import_changes").dropDuplicates()
    return log.groupBy("change_type", "object_type").agg(F.count("*").alias("n"))


# --- statements -----------------------------------------------------------------------------------


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.parse_statements(st.statements(read_table(spark, sf_dir, "analyze_requests")))


def output_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.output_fields(_facts(spark, sf_dir))


def source_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.source_tables(_facts(spark, sf_dir))


def source_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.source_locations(_facts(spark, sf_dir))


def column_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, column and length of the items that are plain columns."""
    plain = _facts(spark, sf_dir).withColumn("items", F.filter("items", lambda i: i["kind"] == "column"))
    return st.source_locations(plain).select("sql_id", "pos", "line", "col", "len")


def structure_edges_of_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of table structure, or of CTE structure where the text begins with WITH."""
    found = F.when(F.col("sniffs_cte"), structure.cte_structure()).otherwise(structure.table_structure())
    edges = _facts(spark, sf_dir).where("parse_ok").select("sql_id", F.explode(found["edges"]).alias("e"))
    return edges.select("sql_id", "e.source", "e.target", "e.edge_type")


class Analysis:
    """The queries of the analysis over statements and known columns."""

    def __init__(self, requests, columns) -> None:
        self.requests, self.columns = requests, columns

    def _facts(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return st.parse_statements(st.statements(self.requests(spark, sf_dir)))

    def _results(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return analysis.analyze(st.statements(self.requests(spark, sf_dir)), catalog.columns_by_name(self.columns(spark, sf_dir)))

    def parse_status(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self._facts(spark, sf_dir).select("sql_id", "parse_ok", "sniffs_cte", "dialect")

    def output_field_names(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """What the select items are, their text aside."""
        items = self._facts(spark, sf_dir).select("sql_id", F.explode("items").alias("i"))
        none = lambda c: F.coalesce(c, F.lit(""))
        named = F.when(F.col("i.kind") == "column", none(F.col("i.column_name"))).otherwise("")
        return items.select("sql_id", "i.pos", "i.kind", none(F.col("i.alias")).alias("alias"), none(F.col("i.qualifier")).alias("qualifier"), named.alias("column_name"), "i.source_type")

    def table_references(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return st.table_references(self._facts(spark, sf_dir)).select("sql_id", "pos", "full_name", "alias", "is_top_level")

    def lineage_columns(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lineage of the statements whose graph is asked for; the others aren't resolved."""
        facts = self._facts(spark, sf_dir)
        resolved = resolve(attach_metadata(facts, catalog.columns_by_name(self.columns(spark, sf_dir))))
        return column_lineage(resolved.where("include_graph and not sniffs_cte and parse_ok"))

    def analysis_summary(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        drop = ("stage_statuses", "unsupported_features", "diagnostics", "nodes", "edges", "output_fields")
        return self._results(spark, sf_dir).drop(*drop)

    def analysis_diagnostics(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Diagnostics in order; what a parser says of text it can't read is its own, only its kind is told."""
        return analysis.diagnostics_of(self._results(spark, sf_dir)).withColumn("message", _parser_text(F.col("message")))

    def diagnostic_counts(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return analysis.diagnostics_of(self._results(spark, sf_dir)).groupBy("code", "level").agg(F.count("*").alias("n"))

    def analysis_features(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self._results(spark, sf_dir).select("sql_id", F.posexplode("unsupported_features").alias("ord", "feature"))

    def analysis_stages(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = self._results(spark, sf_dir).select("sql_id", F.posexplode("stage_statuses").alias("ord", "s"))
        return rows.select("sql_id", "ord", "s.stage", "s.status", F.array_join("s.diagnostic_codes", ",").alias("codes"), _parser_text(F.col("s.message")).alias("message"))

    def analysis_nodes(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return analysis.nodes_of(self._results(spark, sf_dir))

    def analysis_edges(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return analysis.edges_of(self._results(spark, sf_dir))


def _parser_text(c):
    return F.when(c.startswith("SQL parse error"), "SQL parse error").otherwise(c)


OVER_DATA = Analysis(lambda spark, sf_dir: read_table(spark, sf_dir, "analyze_requests"), _latest)
OVER_CORPUS = Analysis(lambda spark, sf_dir: corpora.requests(spark), lambda spark, sf_dir: corpora.catalog(spark))
lineage_columns, _results = OVER_DATA.lineage_columns, OVER_DATA._results


def corpus_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised text of expressions."""
    return st.output_fields(st.parse_statements(st.statements(corpora.expressions(spark)))).select("sql_id", "expression")


def corpus_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the engine's own graphs without an end: none."""
    results = OVER_CORPUS._results(spark, sf_dir)
    return structure.dangling_edges(analysis.nodes_of(results), analysis.edges_of(results))


def analysis_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.result_json(_results(spark, sf_dir))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.health(spark)


def expression_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression_lineage.mappings(_facts(spark, sf_dir))


def expression_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that every select item is made of, and how."""
    return expression_mappings(spark, sf_dir).select("sql_id", "pos", "source_table", "source_column", "relation")


def lineage_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression_lineage.roll_up(lineage_columns(spark, sf_dir))


def statement_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression_lineage.semantics(_facts(spark, sf_dir))


# --- graphs ---------------------------------------------------------------------------------------


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``structure_edges``, without rows of no statement; a node's type is that of its id's prefix."""
    rows = read_table(spark, sf_dir, "structure_edges").where("sql_id is not null").select("sql_id", "source", "target", F.lower("edge_type").alias("edge_type"))
    edge_id = F.concat(F.lit("edge:"), F.coalesce("source", F.lit("")), F.lit("->"), F.coalesce("target", F.lit("")))
    edges = rows.groupBy("sql_id", "source", "target").agg(F.max("edge_type").alias("edge_type")).withColumn("id", edge_id)
    prefix = F.element_at(F.split("id", ":"), 1)
    kind = F.when(prefix == "physical_table", "table").when(prefix == "cte", "cte").otherwise("output")
    ids = edges.select("sql_id", F.explode(F.array("source", "target")).alias("id")).where("id is not null").dropDuplicates()
    nodes = ids.select("sql_id", "id", kind.alias("node_type"), F.regexp_replace("id", "^[^:]*:", "").alias("label"), F.col("id").alias("ord"))
    return nodes, edges  # rows come in no order: nodes are ordered by id


def graph_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.dangling_edges(*graph_tables(spark, sf_dir))


def graph_view_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    return views.view(nodes, edges, "subquery")[0].select("sql_id", "id", views.shown_node_type(F.col("node_type")).alias("type"), views.short_label(F.col("label")).alias("label"), views.node_tag(F.col("node_type")).alias("tag"))


def graph_view_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    return views.view(nodes, edges, "subquery")[1].select("sql_id", "source", "target", views.shown_edge_type(F.col("edge_type")).alias("type"))


def graph_table_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the table view, synthesised ones included."""
    return views.table_view(*graph_tables(spark, sf_dir))[1].select("sql_id", "source", "target", "type")


def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.levels(*graph_tables(spark, sf_dir))


def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    return views.layout(nodes, edges, views.levels(nodes, edges)).withColumn("y", F.round("y", 6))


def graph_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = views.bounds(graph_layout(spark, sf_dir), graph_tables(spark, sf_dir)[0])
    return box.withColumns({c: F.round(c, 6) for c in ("min_y", "max_y")})


def graph_table_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the table view with their places."""
    return views.table_view(*graph_tables(spark, sf_dir))[0].select("sql_id", "id", "type", "x", F.round("y", 6).alias("y"))


def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be selected in the table view."""
    return views.entity_set(graph_tables(spark, sf_dir)[0], "table")


def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything beside each statement's result."""
    nodes, edges = graph_tables(spark, sf_dir)
    return views.neighbourhood(edges.where("source is not null"), nodes.where("node_type = 'output'"))


def graph_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that feeds each statement's result."""
    nodes, edges = graph_tables(spark, sf_dir)
    return views.upstream(edges, nodes.where("node_type = 'output'"))


def formatted_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.statements(read_table(spark, sf_dir, "analyze_requests"))
    return rows.select("sql_id", formatted(F.col("sql")).alias("formatted"))


def _corpus_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results of the corpus, and the nodes and edges of their graphs."""
    results = materialise(OVER_CORPUS._results(spark, sf_dir), "results")
    return results, analysis.nodes_of(results), analysis.edges_of(results)


def _spots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return views.place_all(nodes, edges, views.levels(nodes, edges)).select("sql_id", "id", "type", "label", "x", F.round("y", 6).alias("y"))


def corpus_column_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and output fields below the structure of each statement."""
    _, nodes, edges = _corpus_graph(spark, sf_dir)
    return _spots(nodes, edges).where("type in ('column', 'output_field')")


def corpus_columns_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graphs without their structure: sources and outputs in two rows, no result."""
    _, nodes, edges = _corpus_graph(spark, sf_dir)
    return _spots(nodes.where("node_type like '%column'"), edges.where("edge_type = 'column_lineage'"))


def corpus_made_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result that each graph of tables and columns gets when it has none."""
    _, nodes, edges = _corpus_graph(spark, sf_dir)
    with_ctes = nodes.where("node_type = 'cte'").select("sql_id").dropDuplicates()
    plain = nodes.where("node_type <> 'output'").join(with_ctes, "sql_id", "left_anti")
    return _spots(plain, edges).where(F.col("id") == views.RESULT_ID)


def corpus_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where selecting each output field leads, from the table view and from the column view."""
    _, nodes, edges = _corpus_graph(spark, sf_dir)
    picks = nodes.where("node_type = 'output_column'").select("sql_id", F.col("id").alias("entity_id"), F.lit("output").alias("type"), F.lit("m").alias("mode"), F.explode(F.array(F.lit("table"), F.lit("column"))).alias("view_mode"))
    picks = picks.withColumn("selection_id", F.concat_ws("/", "sql_id", "entity_id", "view_mode"))
    return views.select_results(picks, nodes, edges).select("sql_id", "entity_id", "view_mode", "selected_entity", "selected_output", "next_mode")


def corpus_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each view marks."""
    results, nodes, edges = _corpus_graph(spark, sf_dir)
    told = views.entity_diagnostics(analysis.diagnostics_of(results))
    parts = [views.highlights(nodes, edges, told, mode).withColumn("mode", F.lit(mode)) for mode in views.VIEW_MODES]
    return reduce(DataFrame.unionByName, parts)


def corpus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search entries of the results themselves."""
    results, nodes, edges = _corpus_graph(spark, sf_dir)
    found = views.search_index(nodes, edges, results.select("sql_id", "status"))
    return found.where("reason = 'sql analyze'").select("sql_id", "entity_id", "display_name", "sub", "confidence")


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that mention ``order``."""
    nodes, edges = graph_tables(spark, sf_dir)
    return views.search(views.search_index(nodes, edges), " Order ").select("sql_id", "entity_id", "display_name", "type")


def column_table_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.column_tables(*graph_tables(spark, sf_dir))


def cursor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a cursor in the middle of every select item, the item it is on."""
    places = source_locations(spark, sf_dir)
    cursors = places.select(F.concat_ws("/", "sql_id", "line", "col").alias("cursor_id"), "sql_id", "line", (F.col("col") + (F.col("len") / 2).cast("int")).alias("col"))
    return views.cursor_match(cursors, places)


def completion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns in force and the keywords of queries, as completion lists them."""
    latest = _latest(spark, sf_dir)
    words = spark.createDataFrame([(w, "keyword") for w in ("SELECT", "FROM", "WHERE", "JOIN", "GROUP BY", "ORDER BY", "WITH")], "text string, type string")
    tables = latest.select(F.col("table_name").alias("text"), F.lit("table").alias("type")).dropDuplicates()
    columns = latest.select(F.col("name").alias("text"), F.lit("column").alias("type")).dropDuplicates()
    return views.completion(words.unionByName(tables).unionByName(columns))


def hover_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hovering over the columns that all statements select shows."""
    fields = OVER_DATA.output_field_names(spark, sf_dir).where("kind = 'column'")
    return views.hover(fields.select(F.col("column_name").alias("word")).dropDuplicates(), _latest(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        catalog_tables, catalog_columns, catalog_columns_of_table, catalog_columns_by_name, catalog_count, import_preview, import_commit, import_summary,
        import_change_groups, import_log_counts, output_fields, source_tables, source_locations, column_locations, structure_edges_of_statements,
        analysis_json, health, corpus_expressions, corpus_dangling, expression_mappings, expression_sources, lineage_roll_up,
        statement_semantics, graph_dangling, graph_view_nodes, graph_view_edges, graph_table_view, graph_levels, graph_layout, graph_bounds, graph_table_positions, graph_entities,
        graph_neighbourhood, graph_upstream, formatted_statements, graph_search, corpus_column_places, corpus_columns_only, corpus_made_results, corpus_selected, corpus_highlights, corpus_search, column_table_links, cursor_matches, completion_order, hover_columns,
    )
}
QUERIES |= {name: getattr(OVER_DATA, name) for name in lineage_oracle.SELECTS} | {f"corpus_{name}": getattr(OVER_CORPUS, name) for name in lineage_oracle.SELECTS}

_LATEST = """latest_tables AS (
  SELECT * FROM table_metadata
  QUALIFY row_number() OVER (PARTITION BY catalog, schema_name, table_name ORDER BY import_id DESC, id DESC) = 1
), latest AS (
  SELECT t.catalog, t.schema_name, t.table_name, c.table_id, c.name, c.data_type, c.comment, c.ordinal, c.is_partition, c.nullable
  FROM (SELECT * FROM column_metadata
        QUALIFY row_number() OVER (PARTITION BY table_id, name ORDER BY loaded_at DESC NULLS LAST, id DESC) = 1) c
  JOIN latest_tables t ON t.id = c.table_id
)"""
_GRAPH = """edges AS (
  SELECT sql_id, source, target, max(lower(edge_type)) AS edge_type FROM structure_edges GROUP BY ALL
), nodes AS (
  SELECT sql_id, id, CASE split_part(id, ':', 1) WHEN 'physical_table' THEN 'table' WHEN 'cte' THEN 'cte' ELSE 'output' END AS kind,
         regexp_replace(id, '^[^:]*:', '') AS label
  FROM (SELECT sql_id, source AS id FROM edges UNION SELECT sql_id, target FROM edges) WHERE id IS NOT NULL
)"""
_SHOWN = """CASE edge_type WHEN 'column_lineage' THEN 'projection' WHEN 'cte_dependency' THEN 'cte' WHEN 'cte_to_result' THEN 'output' ELSE 'table' END"""
_TRIM = r"[\s\x{85}\x{a0}\x{3000}\x{feff}\x{200b}]"
_PAYLOADS = rf"""bodies AS (
  SELECT DISTINCT payload_id, regexp_replace(body, '^{_TRIM}+|{_TRIM}+$', '', 'g') AS body, source_name, received_at FROM metadata_payloads
), outer_objects AS (
  SELECT payload_id, CAST(body AS JSON) AS j FROM bodies WHERE CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' END
), inner_texts AS (
  SELECT payload_id, CASE WHEN json_type(j, '$.tables') IS NOT NULL OR json_type(j, '$.payload') IS NULL THEN CAST(j AS VARCHAR)
                          WHEN json_type(j, '$.payload') = 'VARCHAR' THEN regexp_replace(j ->> '$.payload', '^{_TRIM}+|{_TRIM}+$', '', 'g')
                          ELSE CAST(j -> '$.payload' AS VARCHAR) END AS body
  FROM outer_objects
), payloads AS (
  SELECT payload_id, CAST(body AS JSON) AS j FROM inner_texts WHERE CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' END
), table_lists AS (
  SELECT payload_id, j, CASE json_type(j, '$.tables') WHEN 'ARRAY' THEN CAST(j -> '$.tables' AS JSON[]) WHEN 'OBJECT' THEN [j -> '$.tables'] ELSE [] END AS ts FROM payloads
), table_rows AS (
  SELECT payload_id, j, CAST(unnest(range(len(ts))) AS BIGINT) AS table_pos, unnest(ts) AS t FROM table_lists
), named_tables AS (
  SELECT payload_id, table_pos, t, coalesce(t ->> '$.table_name', t ->> '$.name', '') AS table_name,
         coalesce(t ->> '$.catalog', j ->> '$.default_catalog', 'default') AS catalog, coalesce(t ->> '$.schema', j ->> '$.default_schema', 'default') AS schema_name
  FROM table_rows WHERE json_type(t) = 'OBJECT'
), column_lists AS (
  SELECT *, CASE json_type(t, '$.columns') WHEN 'ARRAY' THEN CAST(t -> '$.columns' AS JSON[]) WHEN 'OBJECT' THEN [t -> '$.columns'] ELSE [] END AS cs FROM named_tables
), column_rows AS (
  SELECT payload_id, table_pos, catalog, schema_name, table_name, CAST(unnest(range(len(cs))) AS BIGINT) AS column_pos, unnest(cs) AS c FROM column_lists
), named_columns AS (
  SELECT *, c ->> '$.name' AS column_name FROM column_rows WHERE json_type(c) = 'OBJECT' AND (c ->> '$.name') IS NOT NULL
)"""
_CHANGES = """changes AS (
  SELECT payload_id, table_pos, CAST(-1 AS BIGINT) AS column_pos, 'added' AS change_type, 'table' AS object_type, catalog, schema_name, table_name, CAST(NULL AS VARCHAR) AS column_name FROM named_tables
  UNION ALL
  SELECT payload_id, table_pos, column_pos, 'added', 'column', catalog, schema_name, table_name, column_name FROM named_columns
)"""
_NAME = r'[`"]?\w+[`"]?(?:\.[`"]?\w+[`"]?)*'
_STATEMENTS = rf"""texts AS (
  SELECT DISTINCT sql_id, sql, dialect, include_graph FROM analyze_requests
), refs AS (
  SELECT sql_id, sql, [regexp_replace(x, '[`"]', '', 'g') FOR x IN regexp_extract_all(regexp_replace(sql, '{BLANK}+', ' ', 'g'), '(?i)\b(?:from|join) ?({_NAME})', 1)] AS names,
         regexp_matches(sql, '(?i)^{BLANK}*with ') AS cte,
         regexp_replace(regexp_extract(regexp_replace(sql, '{BLANK}+', ' ', 'g'), '(?i)^ ?with ([`"]?\w+[`"]?)', 1), '[`"]', '', 'g') AS cte_name
  FROM texts WHERE regexp_matches(sql, '\w')
)"""

_LEVELS = f"""{_GRAPH}, links AS (
  SELECT e.sql_id, e.source, e.target FROM edges e JOIN nodes t ON t.sql_id = e.sql_id AND t.id = e.target AND t.kind = 'cte' WHERE e.source IS NOT NULL
), placed(sql_id, id, level) AS (
  SELECT sql_id, id, 0 FROM nodes WHERE kind = 'table'
  UNION ALL
  SELECT sql_id, id, 1 FROM nodes n WHERE kind = 'cte' AND NOT EXISTS (SELECT 1 FROM links l WHERE l.sql_id = n.sql_id AND l.target = n.id)
  UNION ALL
  SELECT l.sql_id, l.target, p.level + 1 FROM placed p JOIN links l ON l.sql_id = p.sql_id AND l.source = p.id
), inner_levels AS (
  SELECT n.sql_id, n.id, coalesce(p.level, 0) AS level FROM nodes n LEFT JOIN placed p ON p.sql_id = n.sql_id AND p.id = n.id WHERE n.kind <> 'output'
), levels AS (
  SELECT * FROM inner_levels UNION ALL
  SELECT n.sql_id, n.id, 1 + coalesce((SELECT max(level) FROM inner_levels i WHERE i.sql_id = n.sql_id), 0) FROM nodes n WHERE n.kind = 'output'
)"""
_LAYOUT = f"""{_LEVELS}, laid AS (
  SELECT l.sql_id, l.id, l.level, 72 + l.level * 170 AS x,
         CAST(72 + 56 * (row_number() OVER (PARTITION BY l.sql_id, l.level ORDER BY l.id) - 1) AS DOUBLE) AS y
  FROM inner_levels l
), outs AS (
  SELECT l.sql_id, l.id, l.level, 72 + l.level * 170 AS x,
         coalesce((SELECT avg(i.y) FROM edges e JOIN laid i ON i.sql_id = e.sql_id AND i.id = e.source WHERE e.sql_id = l.sql_id AND e.target = l.id),
                  (SELECT avg(i.y) FROM laid i WHERE i.sql_id = l.sql_id), 72.0) AS y
  FROM levels l JOIN nodes n ON n.sql_id = l.sql_id AND n.id = l.id AND n.kind = 'output'
), layout AS (SELECT * FROM laid UNION ALL SELECT * FROM outs)"""

ORACLES = {
    "lineage_roll_up": f"WITH {_LATEST}, {lineage_oracle.DATA}, {lineage_oracle.ENGINE} SELECT DISTINCT sql_id, source_table, output_column FROM lineage JOIN facts USING (sid)",
    "graph_levels": f"WITH RECURSIVE {_LEVELS} SELECT * FROM levels",
    "graph_layout": f"WITH RECURSIVE {_LAYOUT} SELECT * REPLACE (round(y, 6) AS y) FROM layout",
    "graph_bounds": f"""WITH RECURSIVE {_LAYOUT}, boxes AS (SELECT l.sql_id, x, y, CASE kind WHEN 'output' THEN 132 WHEN 'cte' THEN 125 ELSE 118 END AS w, CASE kind WHEN 'output' THEN 32 WHEN 'cte' THEN 30 ELSE 29 END AS h FROM layout l JOIN nodes n USING (sql_id, id))
        SELECT sql_id, min(x) AS min_x, round(min(y), 6) AS min_y, max(x + w) AS max_x, round(max(y + h), 6) AS max_y FROM boxes GROUP BY sql_id""",
    "graph_table_positions": f"""WITH {_GRAPH}, kept AS (SELECT sql_id, id, kind AS type, count(*) FILTER (kind = 'table') OVER (PARTITION BY sql_id) AS n, row_number() OVER (PARTITION BY sql_id ORDER BY id) - 1 AS place,
          row_number() OVER (PARTITION BY sql_id, kind ORDER BY id) - 1 AS own FROM nodes WHERE kind IN ('table', 'output'))
        SELECT sql_id, id, type, CASE type WHEN 'table' THEN 72 ELSE 292 END AS x, CAST(CASE WHEN type = 'table' THEN 72 + own * 58 WHEN n > 0 THEN 72 + (n - 1) * 29.0 ELSE 72 + place * 58 END AS DOUBLE) AS y FROM kept""",
    "graph_entities": f"WITH {_GRAPH} SELECT sql_id, id FROM nodes WHERE kind IN ('table', 'output')",
    "catalog_tables": f"WITH {_LATEST} SELECT catalog, schema_name, table_name, comment, table_type FROM latest_tables",
    "catalog_columns": f"WITH {_LATEST} SELECT * REPLACE (CAST(is_partition AS INTEGER) AS is_partition, CAST(nullable AS INTEGER) AS nullable) FROM latest",
    "catalog_columns_of_table": f"WITH {_LATEST} SELECT * EXCLUDE (table_id) REPLACE (CAST(is_partition AS INTEGER) AS is_partition, CAST(nullable AS INTEGER) AS nullable) FROM latest WHERE table_name = 'dwd_trade_event_wide_di'",
    "catalog_columns_by_name": f"WITH {_LATEST} SELECT table_name, string_agg(name, ',' ORDER BY ordinal NULLS FIRST, name) AS columns FROM latest GROUP BY table_name",
    "catalog_count": f"WITH {_LATEST} SELECT count(*) AS total FROM latest_tables",
    "import_preview": f"WITH {_PAYLOADS}, {_CHANGES} SELECT * FROM changes",
    "import_commit": f"""WITH {_PAYLOADS}, {_CHANGES}
        SELECT c.* REPLACE (CASE WHEN p.j ->> '$.metadata_version' IN (SELECT metadata_version FROM metadata_imports) THEN 'unchanged' ELSE 'added' END AS change_type)
        FROM changes c JOIN payloads p USING (payload_id)""",
    "import_summary": f"""WITH {_PAYLOADS} SELECT t.payload_id, t.n AS table_count, coalesce(c.n, 0) AS column_count
        FROM (SELECT payload_id, count(*) AS n FROM named_tables GROUP BY 1) t LEFT JOIN (SELECT payload_id, count(*) AS n FROM named_columns GROUP BY 1) c USING (payload_id)""",
    "import_change_groups": f"WITH {_PAYLOADS}, {_CHANGES} SELECT payload_id, table_name, 'added' AS change_type, count(*) FILTER (object_type = 'column') AS n_columns FROM changes GROUP BY 1, 2",
    "import_log_counts": "SELECT change_type, object_type, count(*) AS n FROM (SELECT DISTINCT * FROM import_changes) GROUP BY 1, 2",
    "source_tables": f"""WITH {_STATEMENTS}, flat AS (SELECT sql_id, unnest(range(len(names))) AS k, unnest(names) AS table_name FROM refs),
        firsts AS (SELECT sql_id, table_name, min(k) AS k FROM flat GROUP BY 1, 2)
        SELECT sql_id, CAST(row_number() OVER (PARTITION BY sql_id ORDER BY k) - 1 AS INTEGER) AS ord, table_name FROM firsts""",
    "structure_edges_of_statements": f"""WITH {_STATEMENTS}, flat AS (SELECT sql_id, cte, cte_name, unnest(range(len(names))) AS k, unnest(names) AS name FROM refs)
        SELECT DISTINCT sql_id,
               CASE WHEN cte AND k > 0 AND name = cte_name THEN 'cte:' ELSE 'physical_table:' END || name AS source,
               CASE WHEN cte AND k = 0 THEN 'cte:' || cte_name ELSE 'query_result:final' END AS target,
               CASE WHEN cte AND k = 0 THEN 'table_to_cte' WHEN cte AND name = cte_name THEN 'cte_to_result' ELSE 'table_to_result' END AS edge_type
        FROM flat WHERE cte OR cte_name = ''""",
    "graph_dangling": f"WITH {_GRAPH} SELECT DISTINCT sql_id, 'edge:' || coalesce(source, '') || '->' || coalesce(target, '') AS edge_id FROM edges WHERE source IS NULL OR target IS NULL",
    "graph_view_nodes": f"""WITH {_GRAPH} SELECT sql_id, id, kind AS type, split_part(label, '.', -1) AS label, CASE kind WHEN 'table' THEN 'TBL' END AS tag FROM nodes""",
    "graph_view_edges": f"WITH {_GRAPH} SELECT sql_id, source, target, {_SHOWN} AS type FROM edges WHERE source IS NOT NULL",
    "graph_table_view": f"""WITH {_GRAPH}, outs AS (SELECT sql_id, min(id) AS target FROM nodes WHERE kind = 'output' GROUP BY 1 HAVING count(*) = 1),
        held AS (SELECT e.sql_id, e.source, e.target, {_SHOWN} AS type FROM edges e JOIN nodes s ON s.sql_id = e.sql_id AND s.id = e.source AND s.kind IN ('table', 'output')
                 JOIN nodes t ON t.sql_id = e.sql_id AND t.id = e.target AND t.kind IN ('table', 'output'))
        SELECT * FROM held UNION ALL
        SELECT n.sql_id, n.id, o.target, 'table' FROM nodes n JOIN outs o USING (sql_id) WHERE n.kind = 'table'
          AND NOT EXISTS (SELECT 1 FROM held h WHERE h.sql_id = n.sql_id AND h.source = n.id AND h.target = o.target)""",
    "graph_neighbourhood": f"""WITH {_GRAPH}, touching AS (SELECT e.* FROM edges e WHERE e.source IS NOT NULL AND EXISTS (SELECT 1 FROM nodes n WHERE n.sql_id = e.sql_id AND n.kind = 'output' AND n.id IN (e.source, e.target)))
        SELECT sql_id, source AS id FROM touching UNION SELECT sql_id, target FROM touching""",
    "graph_upstream": f"""WITH RECURSIVE {_GRAPH}, walk(sql_id, start, id, distance) AS (
        SELECT e.sql_id, n.id, e.source, 1 FROM nodes n JOIN edges e ON e.sql_id = n.sql_id AND e.target = n.id WHERE n.kind = 'output' AND e.source IS NOT NULL
        UNION SELECT w.sql_id, w.start, e.source, w.distance + 1 FROM walk w JOIN edges e ON e.sql_id = w.sql_id AND e.target = w.id WHERE e.source IS NOT NULL AND w.distance < 500
      ) SELECT sql_id, start, id, min(distance) AS distance FROM walk GROUP BY 1, 2, 3""",
    "graph_search": f"""WITH {_GRAPH} SELECT sql_id, id AS entity_id, split_part(label, '.', -1) AS display_name, 'source' AS type FROM nodes
        WHERE kind <> 'output' AND contains(lower(split_part(label, '.', -1)), 'order')""",
    "column_table_links": f"""WITH {_GRAPH} SELECT DISTINCT e.sql_id, e.target AS id, n.id AS table_id FROM edges e JOIN nodes n ON n.sql_id = e.sql_id AND n.kind = 'table'
        WHERE e.source <> '' AND contains(e.source, split_part(n.id, ':', -1))""",
    "completion_order": f"""WITH {_LATEST} SELECT text, type, CASE type WHEN 'keyword' THEN '0_' WHEN 'table' THEN '2_' ELSE '3_' END || lower(text) AS sort_text FROM (
        SELECT unnest(['SELECT', 'FROM', 'WHERE', 'JOIN', 'GROUP BY', 'ORDER BY', 'WITH']) AS text, 'keyword' AS type
        UNION ALL SELECT DISTINCT table_name, 'table' FROM latest UNION ALL SELECT DISTINCT name, 'column' FROM latest)""",
    "hover_columns": f"WITH {_LATEST}, {lineage_oracle.DATA}, {lineage_oracle.ENGINE} SELECT name AS word, table_name, data_type, comment FROM latest WHERE name IN (SELECT col FROM fields WHERE kind = 'column')",
    "health": "SELECT 'ok' AS status, 'strandline' AS service, '0.1.0' AS version",
    "corpus_expressions": f"SELECT CAST(k AS BIGINT) AS sql_id, t AS expression FROM (VALUES {lineage_oracle.values([(k, text) for k, (_, text) in enumerate(corpora.EXPRESSIONS)])}) v(k, t)",
    "corpus_dangling": "SELECT CAST(0 AS BIGINT) AS sql_id, '' AS edge_id WHERE false",
}
_CORPUS = f"WITH {lineage_oracle.CORPUS}, {lineage_oracle.ENGINE}"
_RANKED = """, shown AS (SELECT s.sql_id, n.*, count(*) FILTER (node_type = 'physical_column') OVER w AS s, count(*) FILTER (node_type = 'output_column') OVER w AS f
  FROM nodes n JOIN facts s USING (sid) WINDOW w AS (PARTITION BY sid ORDER BY n.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_TYPED = "CASE node_type WHEN 'physical_column' THEN 'column' ELSE 'output_field' END AS type"
ORACLES |= {
    "corpus_column_places": f"""{_CORPUS}{_RANKED} SELECT sql_id, id, {_TYPED}, label, CASE node_type WHEN 'physical_column' THEN 70 ELSE 420 END AS x, CAST(280 + 76 * CASE node_type WHEN 'physical_column' THEN s ELSE greatest(s - 1, 0) END AS DOUBLE) AS y
        FROM shown h WHERE node_type LIKE '%column' AND EXISTS (SELECT 1 FROM nodes o WHERE o.sid = h.sid AND o.node_type = 'output')
        UNION ALL SELECT sql_id, id, {_TYPED}, label, CASE node_type WHEN 'physical_column' THEN 70 ELSE 380 END, CAST(70 + 76 * CASE node_type WHEN 'physical_column' THEN s ELSE f END AS DOUBLE)
        FROM shown h WHERE node_type LIKE '%column' AND NOT EXISTS (SELECT 1 FROM nodes o WHERE o.sid = h.sid AND o.node_type = 'output')""",
    "corpus_columns_only": f"""{_CORPUS}{_RANKED} SELECT sql_id, id, {_TYPED}, label, CASE node_type WHEN 'physical_column' THEN 70 ELSE 380 END AS x, CAST(70 + 76 * CASE node_type WHEN 'physical_column' THEN s ELSE f END AS DOUBLE) AS y
        FROM shown WHERE node_type LIKE '%column'""",
    "corpus_made_results": f"""{_CORPUS}, sums AS (SELECT sid, count(*) FILTER (node_type = 'table') AS t, count(*) FILTER (node_type = 'output_column') AS c FROM nodes GROUP BY sid HAVING count(*) FILTER (node_type = 'cte') = 0)
        SELECT sql_id, 'out:query_result' AS id, 'output' AS type, CASE WHEN c > 0 THEN 'Query Result (' || c || ' cols)' ELSE 'Query Result' END AS label, 242 AS x, 72 + 28.0 * (t - 1) AS y
        FROM sums JOIN facts USING (sid) WHERE t > 0""",
    "corpus_selected": f"""{_CORPUS}, outs AS (SELECT sid, id FROM nodes WHERE node_type = 'output_column'), tabs AS (SELECT sid, ord, id, split_part(id, ':', -1) AS tail FROM nodes WHERE node_type = 'table'),
        owners AS (SELECT o.sid, o.id, arg_min(n.id, n.ord) AS owner FROM outs o JOIN edges e ON e.sid = o.sid AND e.target = o.id JOIN tabs t ON t.sid = o.sid AND contains(e.source, t.tail) JOIN tabs n ON n.sid = o.sid AND contains(n.id, t.id) GROUP BY 1, 2)
        SELECT sql_id, o.id AS entity_id, view_mode, CASE view_mode WHEN 'table' THEN coalesce(w.owner, o.id) ELSE o.id END AS selected_entity, o.id AS selected_output, 'current_field_path' AS next_mode
        FROM outs o JOIN facts USING (sid) LEFT JOIN owners w ON w.sid = o.sid AND w.id = o.id, (VALUES ('table'), ('column')) v(view_mode)""",
    "corpus_highlights": f"""{_CORPUS} SELECT sql_id, 'node' AS kind, id, mode FROM nodes JOIN facts USING (sid), (VALUES ('subquery'), ('semantics')) v(mode) WHERE node_type = 'cte'
        UNION ALL SELECT DISTINCT sql_id, 'node', 'out:group', 'diagnostics' FROM told JOIN facts USING (sid)""",
    "corpus_search": f"""{_CORPUS}, sums AS (SELECT sid, count(*) FILTER (node_type IN ('table', 'cte')) AS t, count(*) FILTER (node_type = 'output_column') AS c, min(id) FILTER (node_type = 'output') AS r FROM nodes GROUP BY sid)
        SELECT sql_id, coalesce(r, 'out:query_result') AS entity_id, CASE WHEN c > 0 THEN 'Query Result (' || c || ' cols)' ELSE 'Query Result' END AS display_name, t || ' tables, ' || c || ' cols' AS sub,
               CASE status WHEN 'partial' THEN 'medium' ELSE 'high' END AS confidence FROM sums JOIN results USING (sid)""",
}
ORACLES |= {name: f"WITH {_LATEST}, {lineage_oracle.DATA}, {lineage_oracle.ENGINE} {select}" for name, select in lineage_oracle.SELECTS.items()}
ORACLES |= {name: f"WITH {_LATEST}, {lineage_oracle.DATA}, {lineage_oracle.ENGINE}{more}" for name, more in lineage_oracle.MORE.items()}
ORACLES |= {f"corpus_{name}": f"WITH {lineage_oracle.CORPUS}, {lineage_oracle.ENGINE} {select}" for name, select in lineage_oracle.SELECTS.items()}
P3_FOUND = f"""WITH {_PAYLOADS}
SELECT payload_id, table_pos, table_name, column_pos, column_name FROM named_columns
UNION ALL
SELECT payload_id, table_pos, table_name, CAST(-1 AS BIGINT), '' FROM named_tables n
WHERE NOT EXISTS (SELECT 1 FROM named_columns c WHERE c.payload_id = n.payload_id AND c.table_pos = n.table_pos)"""
P3_TABLES = f"""WITH {_PAYLOADS}
SELECT payload_id, table_pos, t ->> '$.catalog' AS catalog, t ->> '$.schema' AS schema, t ->> '$.table_name' AS table_name, t ->> '$.name' AS name, t ->> '$.table_type' AS table_type
FROM table_rows WHERE json_type(t) = 'OBJECT'"""
P3_COLUMNS = f"""WITH {_PAYLOADS}
SELECT payload_id, table_pos, column_pos, c ->> '$.name' AS name, c ->> '$.data_type' AS data_type, c ->> '$.comment' AS comment FROM column_rows WHERE json_type(c) = 'OBJECT'"""
