"""The analysis in SQL: the checking database's own parser, and the rules as joins.

Nothing is shared with the engine but the fixed texts: statements are parsed by
``json_serialize_sql``, and every rule is stated over its tree.
"""

from __future__ import annotations

from strandline.operators.lineage import TEXTS
from strandline.operators.structure import NO_TABLE_TEXT, WITH_TEXT
from strandline.plans import corpora
from strandline.plans.data_oracles import BLANK


def _quoted(value: object) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _text(key: str, *parts: str) -> str:
    """A fixed text as an SQL expression."""
    pieces = TEXTS[key].replace("{0}", "{}").split("{}")
    parts = parts * (len(pieces) - 1) if "{0}" in TEXTS[key] else parts
    return " || ".join(x for k, piece in enumerate(pieces) for x in ([parts[k - 1]] if k else []) + [_quoted(piece)])


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)


#: Statements and known columns: the project's own, and those of the corpus.
DATA = """texts AS (SELECT DISTINCT sql_id, sql, lower(trim(dialect)) AS dialect, include_graph FROM analyze_requests WHERE sql_id IS NOT NULL),
cols AS (SELECT table_name, name, ordinal FROM latest WHERE table_name IS NOT NULL AND name <> '')"""
CORPUS = f"""texts(sql_id, sql, dialect, include_graph) AS (SELECT * FROM (VALUES {values(corpora.REQUESTS)})),
cols(table_name, name, ordinal) AS (SELECT * FROM (VALUES {values(corpora.CATALOG)}))"""

_ROOT = r"\$\.statements\[0\]\.node"
_UNKNOWN = "SQL parse error"
ENGINE = rf"""clean AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sql_id, sql) AS sid, CAST(sql_id AS BIGINT) AS sql_id, sql, CASE WHEN dialect IN ('hive', 'mysql', 'starrocks', 'doris') THEN dialect ELSE 'spark' END AS dialect,
         coalesce(include_graph, true) AS graph, json_serialize_sql(regexp_replace(replace(coalesce(sql, ''), '`', '"'), '{BLANK}', ' ', 'g')) AS j,
         coalesce(regexp_matches(sql, '(?i)^{BLANK}*with '), false) AS sniff
  FROM texts
), stmts AS MATERIALIZED (
  SELECT *, j ->> '$.error' = 'false' AND json_array_length(j, '$.statements') = 1 AS ok, j -> '$.statements[0].node' AS node FROM clean
), tree AS MATERIALIZED (
  SELECT s.sid, t.fullkey, t.value AS v FROM stmts s, json_tree(s.j) t WHERE s.ok AND t.type = 'OBJECT' AND t.value ->> '$.type' IN ('BASE_TABLE', 'SUBQUERY')
), ctes AS MATERIALIZED (
  SELECT sid, unnest(range(len(m))) AS i, unnest(m) ->> '$.key' AS name FROM (SELECT sid, from_json(node -> '$.cte_map.map', '["json"]') AS m FROM stmts WHERE ok)
), refs AS MATERIALIZED (
  SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY CAST(v ->> '$.query_location' AS BIGINT)) AS k, array_to_string(from_json(v -> '$.qualified_name.path', '["varchar"]'), '.') AS name,
         coalesce(nullif(v ->> '$.alias', ''), v ->> '$.table_name') AS alias, regexp_full_match(fullkey, '{_ROOT}\.from_table(\.(left|right))*') AS top,
         nullif(regexp_extract(fullkey, '^{_ROOT}\.cte_map\.map\[(\d+)\]', 1), '') AS cte_at
  FROM tree WHERE v ->> '$.type' = 'BASE_TABLE'
), fields AS MATERIALIZED (
  -- a name in double quotes is a text in these dialects, whatever the checking database thinks
  SELECT sid, k, kind, alias, CASE kind WHEN 'star' THEN coalesce(x ->> '$.relation_name', '') WHEN 'column' THEN coalesce(path[-2], '') ELSE '' END AS qualifier, CASE kind WHEN 'column' THEN path[-1] ELSE '' END AS col,
         CAST(x ->> '$.query_location' AS BIGINT) AS loc, CAST(x ->> '$.query_location_length' AS BIGINT) AS size
  FROM (SELECT *, coalesce(x ->> '$.alias', '') AS alias, from_json(x -> '$.column_names', '["varchar"]') AS path,
               CASE WHEN x ->> '$.class' = 'STAR' THEN 'star' WHEN x ->> '$.class' = 'COLUMN_REF' AND NOT contains(substr(flat, CAST(x ->> '$.query_location' AS BIGINT) + 1, CAST(x ->> '$.query_location_length' AS BIGINT)), '"') THEN 'column' ELSE 'expr' END AS kind
        FROM (SELECT sid, flat, unnest(range(len(xs))) AS k, unnest(xs) AS x FROM
               (SELECT sid, regexp_replace(sql, '{BLANK}', ' ', 'g') AS flat, from_json(coalesce(node -> '$.children[0].select_list', node -> '$.select_list'), '["json"]') AS xs FROM stmts WHERE ok)))
), facts AS MATERIALIZED (
  SELECT s.sid, s.sql_id, s.sql, s.dialect, s.graph, s.ok, s.sniff, EXISTS (SELECT 1 FROM ctes c WHERE c.sid = s.sid) AS has_with,
         EXISTS (SELECT 1 FROM tree t WHERE t.sid = s.sid AND t.v ->> '$.type' = 'SUBQUERY' AND coalesce(t.v ->> '$.subquery_type', '') <> 'EXISTS') AS has_sub,
         (SELECT count(*) FROM refs r WHERE r.sid = s.sid) AS n_tables, (SELECT count(*) FROM refs r WHERE r.sid = s.sid AND r.top) AS n_top, (SELECT count(*) FROM fields f WHERE f.sid = s.sid) AS n_fields
  FROM stmts s
), live AS MATERIALIZED (
  SELECT sid, n_tables FROM facts WHERE ok AND graph AND NOT sniff AND NOT has_with AND NOT has_sub AND n_tables > 0
), known AS MATERIALIZED (
  SELECT table_name, list(name ORDER BY coalesce(ordinal, -2147483648), name) AS names FROM cols GROUP BY table_name
), owned AS MATERIALIZED (
  SELECT f.*, CASE WHEN f.qualifier <> '' THEN coalesce((SELECT arg_max(r.name, r.k) FROM refs r WHERE r.sid = f.sid AND r.alias = f.qualifier),
                                                         CASE WHEN f.kind = 'column' THEN (SELECT min(r.name) FROM refs r WHERE r.sid = f.sid AND r.name = f.qualifier) END)
                   WHEN f.kind = 'column' AND l.n_tables = 1 THEN (SELECT min(r.name) FROM refs r WHERE r.sid = f.sid) END AS owner
  FROM fields f JOIN live l USING (sid)
), spread AS (
  SELECT o.sid, o.k, coalesce(list(r.name ORDER BY r.k) FILTER (c.names IS NULL), []) AS missing, coalesce(list(r.name ORDER BY r.k) FILTER (list_contains(c.names, o.col)), []) AS holders, list(r.name ORDER BY r.k) AS every
  FROM owned o JOIN refs r USING (sid) LEFT JOIN known c ON c.table_name = r.name WHERE o.kind = 'column' AND o.qualifier = '' AND o.owner IS NULL GROUP BY o.sid, o.k
), columns AS MATERIALIZED (
  SELECT o.sid, o.k, o.col, CASE WHEN o.alias <> '' THEN o.alias ELSE o.col END AS output, coalesce(o.owner, s.holders[1]) AS tab,
         CASE WHEN o.owner IS NOT NULL THEN CASE WHEN c.names IS NOT NULL AND NOT list_contains(c.names, o.col) THEN 'UNKNOWN_COLUMN' END
              WHEN o.qualifier <> '' THEN 'UNKNOWN_TABLE_ALIAS' WHEN len(s.missing) > 0 OR len(s.holders) > 1 THEN 'AMBIGUOUS_COLUMN' WHEN len(s.holders) = 0 THEN 'UNKNOWN_COLUMN' END AS code,
         CASE WHEN o.owner IS NOT NULL THEN {_text("column", "o.col", "o.owner")} WHEN o.qualifier <> '' THEN {_text("alias", "o.qualifier")}
              WHEN len(s.missing) > 0 THEN {_text("unqualified", "o.col", "array_to_string(s.missing, ', ')")} WHEN len(s.holders) > 1 THEN {_text("several", "o.col", "array_to_string(s.holders, ', ')")}
              ELSE {_text("nowhere", "o.col", "array_to_string(s.every, ', ')")} END AS message
  FROM owned o LEFT JOIN spread s USING (sid, k) LEFT JOIN known c ON c.table_name = o.owner WHERE o.kind = 'column'
), firsts AS (
  SELECT sid, name, min(k) AS k FROM refs GROUP BY sid, name
), pools AS MATERIALIZED (
  SELECT f.sid, coalesce(list(f.name ORDER BY f.k) FILTER (c.names IS NULL), []) AS missing, count(c.names) AS n_known FROM firsts f LEFT JOIN known c ON c.table_name = f.name GROUP BY f.sid
), lineage AS MATERIALIZED (
  SELECT sid, 1 AS phase, k, 0 AS t, 0 AS c, tab AS source_table, col AS source_column, output AS output_column FROM columns WHERE code IS NULL
  UNION ALL
  SELECT o.sid, 0, o.k, f.k, unnest(range(len(c.names))), f.name, unnest(c.names), unnest(c.names)
  FROM owned o JOIN firsts f ON f.sid = o.sid AND (o.qualifier = '' OR f.name = o.owner) JOIN known c ON c.table_name = f.name WHERE o.kind = 'star'
), told AS MATERIALIZED (
  SELECT sid, 0 AS phase, 0 AS k, 0 AS n, 'SQL_PARSE_ERROR' AS code, 'error' AS level, '{_UNKNOWN}' AS message FROM facts WHERE NOT ok
  UNION ALL SELECT sid, 1, 0, 0, 'UNSUPPORTED_COMPLEX_QUERY', 'warning', CASE WHEN has_with THEN {_quoted(WITH_TEXT)} ELSE {_quoted(NO_TABLE_TEXT)} END FROM facts WHERE ok AND graph AND NOT sniff AND (has_with OR n_top = 0)
  UNION ALL SELECT sid, 2, 0, 0, 'UNSUPPORTED_COMPLEX_QUERY', 'warning', CASE WHEN has_with THEN {_text("cte")} WHEN has_sub THEN {_text("subquery")} ELSE {_text("no_table")} END
            FROM facts WHERE ok AND graph AND NOT sniff AND (has_with OR has_sub OR n_tables = 0)
  UNION ALL SELECT o.sid, 3, o.k, 0, CASE WHEN o.owner IS NULL THEN 'UNKNOWN_TABLE_ALIAS' ELSE 'METADATA_MISSING' END, 'warning',
                   CASE WHEN o.owner IS NULL THEN {_text("star_alias", "o.qualifier")} ELSE {_text("table_missing", "o.owner")} END
            FROM owned o LEFT JOIN known c ON c.table_name = o.owner WHERE o.kind = 'star' AND o.qualifier <> '' AND c.names IS NULL
  UNION ALL SELECT o.sid, 3, o.k, 0, 'METADATA_MISSING', 'warning', {_text("tables_missing", "array_to_string(p.missing, ', ')")} FROM owned o JOIN pools p USING (sid) WHERE o.kind = 'star' AND o.qualifier = '' AND len(p.missing) > 0
  UNION ALL SELECT o.sid, 3, o.k, 1, 'SELECT_STAR_METADATA_REQUIRED', 'warning', {_text("star_missing")} FROM owned o JOIN pools p USING (sid) WHERE o.kind = 'star' AND o.qualifier = '' AND len(p.missing) > 0 AND p.n_known = 0
  UNION ALL SELECT sid, 4, k, 0, code, 'warning', message FROM columns WHERE code IS NOT NULL
  UNION ALL SELECT sid, 4, k, 0, 'UNSUPPORTED_COMPLEX_QUERY', 'warning', {_text("expression")} FROM owned WHERE kind = 'expr'
), marks AS (
  SELECT sid, 1 AS a, 0 AS k, 0 AS n, CASE WHEN has_with THEN 'cte_query' ELSE 'missing_source_table' END AS feature FROM facts WHERE ok AND graph AND NOT sniff AND (has_with OR n_top = 0)
  UNION ALL SELECT sid, 2, 0, 0, CASE WHEN has_with THEN 'cte' WHEN has_sub THEN 'subquery' ELSE 'missing_source_table' END FROM facts WHERE ok AND graph AND NOT sniff AND (has_with OR has_sub OR n_tables = 0)
  UNION ALL SELECT o.sid, 3, o.k, n, feature FROM owned o JOIN pools p USING (sid), (VALUES (0, 'metadata_missing'), (1, 'select_star')) v(n, feature)
            WHERE o.kind = 'star' AND o.qualifier = '' AND len(p.missing) > 0 AND (n = 0 OR p.n_known = 0)
), drawn AS (
  SELECT * FROM facts WHERE ok AND graph
), parts AS MATERIALIZED (
  SELECT d.sid, 0 AS a, c.i AS k, 0 AS c, 0 AS n, 'cte:' || c.name AS id, 'cte' AS node_type, c.name AS label FROM drawn d JOIN ctes c USING (sid) WHERE d.sniff
  UNION ALL SELECT d.sid, 1, r.k, 0, 0, 'physical_table:' || r.name, 'table', r.name FROM drawn d JOIN refs r USING (sid) WHERE d.sniff AND r.cte_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ctes c WHERE c.sid = d.sid AND c.name = r.name)
  UNION ALL SELECT sid, 2, 0, 0, 0, 'query_result:final', 'output', 'Query Result' FROM drawn WHERE sniff OR n_top > 0 AND NOT has_with
  UNION ALL SELECT d.sid, 3, r.k, 0, 0, 'physical_table:' || r.name, 'table', r.name FROM drawn d JOIN refs r USING (sid) WHERE r.top AND (d.sniff OR NOT d.has_with) AND NOT EXISTS (SELECT 1 FROM ctes c WHERE c.sid = d.sid AND c.name = r.name)
  UNION ALL SELECT sid, 4 + phase, k * 1000 + t, c, 0, 'physical_column:' || source_table || '.' || source_column, 'physical_column', source_table || '.' || source_column FROM lineage
  UNION ALL SELECT sid, 4 + phase, k * 1000 + t, c, 1, 'output_column:' || output_column, 'output_column', output_column FROM lineage
), nodes AS MATERIALIZED (
  SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY place) - 1 AS INTEGER) AS ord, id, node_type, label FROM (SELECT sid, id, node_type, label, min((a, k, c, n)) AS place FROM parts GROUP BY ALL)
), links AS (
  SELECT d.sid, 0 AS a, r.k, 0 AS c, CASE WHEN c.name IS NULL THEN 'physical_table:' ELSE 'cte:' END || r.name AS source, 'cte:' || o.name AS target, CASE WHEN c.name IS NULL THEN 'table_to_cte' ELSE 'cte_dependency' END AS edge_type
  FROM drawn d JOIN refs r USING (sid) JOIN ctes o ON o.sid = d.sid AND o.i = CAST(r.cte_at AS BIGINT) LEFT JOIN ctes c ON c.sid = d.sid AND c.name = r.name WHERE d.sniff AND r.name <> o.name
  UNION ALL SELECT d.sid, 1, r.k, 0, CASE WHEN c.name IS NULL THEN 'physical_table:' ELSE 'cte:' END || r.name, 'query_result:final', CASE WHEN c.name IS NULL THEN 'table_to_result' ELSE 'cte_to_result' END
  FROM drawn d JOIN refs r USING (sid) LEFT JOIN ctes c ON c.sid = d.sid AND c.name = r.name WHERE r.top AND (d.sniff OR NOT d.has_with)
  UNION ALL SELECT sid, 2 + phase, k * 1000 + t, c, 'physical_column:' || source_table || '.' || source_column, 'output_column:' || output_column, 'column_lineage' FROM lineage
), edges AS MATERIALIZED (
  SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY place) - 1 AS INTEGER) AS ord, 'edge:' || source || '->' || target AS id, source, target, edge_type
  FROM (SELECT sid, source, target, edge_type, min((a, k, c)) AS place FROM links GROUP BY ALL)
), counts AS (
  SELECT f.*, (SELECT count(*) FROM told t WHERE t.sid = f.sid AND t.level = 'warning') AS n_warnings, (SELECT count(*) FROM told t WHERE t.sid = f.sid AND t.phase = 1) AS n_structure,
         (SELECT count(*) FROM told t WHERE t.sid = f.sid AND t.phase > 1) AS n_resolve, (SELECT count(*) FROM nodes n WHERE n.sid = f.sid) AS n_nodes, (SELECT count(*) FROM edges e WHERE e.sid = f.sid) AS n_edges
  FROM facts f
), results AS MATERIALIZED (
  SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN n_warnings > 0 THEN 'partial' ELSE 'success' END AS status FROM counts
), stages AS (
  SELECT sid, 0 AS n, 'sql_parse' AS stage, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN ok THEN '' ELSE 'SQL_PARSE_ERROR' END AS codes, CASE WHEN ok THEN 'SQL parsed successfully.' ELSE '{_UNKNOWN}' END AS message FROM results
  UNION ALL SELECT sid, 1, 'cte_subquery_rollup', 'success', '', 'CTE structure dependencies resolved.' FROM results WHERE ok AND graph AND sniff
  UNION ALL SELECT sid, 1, 'table_structure', CASE WHEN n_structure > 0 THEN 'partial' ELSE 'success' END, coalesce((SELECT string_agg(code, ',' ORDER BY k, n) FROM told t WHERE t.sid = r.sid AND phase = 1), ''), 'Physical table to Query Result structure resolved.' FROM results r WHERE ok AND graph AND NOT sniff
  UNION ALL SELECT sid, 2, 'join_alias_resolve', CASE WHEN n_resolve > 0 THEN 'partial' ELSE 'success' END, coalesce((SELECT string_agg(code, ',' ORDER BY phase, k, n) FROM told t WHERE t.sid = r.sid AND phase > 1), ''), 'Join aliases and selected column ownership resolved.' FROM results r WHERE ok AND graph AND NOT sniff
  UNION ALL SELECT sid, 3, 'graph_build', 'success', '', CASE WHEN sniff THEN 'GraphViewModel built from CTE structure dependencies.' ELSE 'GraphViewModel built from table structure and column lineage.' END FROM results WHERE n_nodes > 0
)"""

_ID = "(SELECT sid, sql_id FROM facts)"
_PARTS = """, objects AS MATERIALIZED (
  SELECT s.sid, t.fullkey, t.value AS v FROM stmts s, json_tree(s.j) t WHERE s.ok AND t.type = 'OBJECT' AND t.value ->> '$.type' IN ('JOIN', 'FUNCTION', 'COLUMN_REF')
)"""
_IN_LIST = "starts_with(o.fullkey, '$.statements[0].node.select_list[') AND NOT contains(o.fullkey, '.subquery')"
#: Selects that look at more of the tree than ENGINE keeps.
MORE = {
    "statement_semantics": _PARTS + """ SELECT sql_id, n_tables, (SELECT count(*) FROM objects o WHERE o.sid = f.sid AND o.v ->> '$.type' = 'JOIN' AND o.v ->> '$.is_implicit' = 'false') AS n_joins,
        (SELECT count(*) FROM ctes c WHERE c.sid = f.sid) AS n_ctes, n_fields AS n_items,
        (SELECT count(DISTINCT regexp_extract(o.fullkey, 'select_list\\[(\\d+)\\]', 1)) FROM objects o WHERE o.sid = f.sid AND starts_with(o.fullkey, '$.statements[0].node.select_list[') AND o.v ->> '$.function_name' IN ('count', 'count_star', 'sum', 'avg', 'min', 'max')) AS n_aggregates,
        has_sub AS has_subquery FROM facts f WHERE ok""",
    "column_locations": f""", spots AS (
          SELECT f.sid, f.k, s.sql_id, substr(s.sql, 1, f.loc) AS before, f.size AS len FROM fields f JOIN stmts s USING (sid) WHERE f.kind = 'column'
        ) SELECT sql_id, CAST(k AS INTEGER) AS pos, CAST(len(string_split_regex(before, '\\r\\n|\\r|\\n')) AS INTEGER) AS line, CAST(length(string_split_regex(before, '\\r\\n|\\r|\\n')[-1]) + 1 AS INTEGER) AS col, CAST(len AS INTEGER) AS len FROM spots""",
    "expression_sources": _PARTS + f""", mentioned AS (
          SELECT DISTINCT o.sid, CAST(regexp_extract(o.fullkey, 'select_list\\[(\\d+)\\]', 1) AS BIGINT) AS k, coalesce(path[-2], '') AS q, path[-1] AS col
          FROM (SELECT o.*, from_json(v -> '$.column_names', '["varchar"]') AS path FROM objects o WHERE v ->> '$.type' = 'COLUMN_REF') o JOIN stmts s USING (sid)
          WHERE {_IN_LIST} AND NOT contains(substr(regexp_replace(s.sql, '{BLANK}', ' ', 'g'), CAST(o.v ->> '$.query_location' AS BIGINT) + 1, CAST(o.v ->> '$.query_location_length' AS BIGINT)), '"')
        ), summed AS (SELECT DISTINCT sid, CAST(regexp_extract(fullkey, 'select_list\\[(\\d+)\\]', 1) AS BIGINT) AS k FROM objects o WHERE {_IN_LIST} AND v ->> '$.function_name' IN ('count', 'count_star', 'sum', 'avg', 'min', 'max'))
        SELECT f.sql_id, CAST(m.k AS INTEGER) AS pos, CASE WHEN m.q <> '' THEN coalesce((SELECT arg_max(r.name, r.k) FROM refs r WHERE r.sid = m.sid AND r.alias = m.q), (SELECT min(r.name) FROM refs r WHERE r.sid = m.sid AND r.name = m.q))
                    WHEN f.n_tables = 1 THEN (SELECT min(r.name) FROM refs r WHERE r.sid = m.sid) END AS source_table, m.col AS source_column,
               CASE WHEN x.kind = 'column' THEN 'direct' WHEN a.k IS NOT NULL THEN 'aggregate' ELSE 'expression' END AS relation
        FROM mentioned m JOIN facts f USING (sid) JOIN fields x ON x.sid = m.sid AND x.k = m.k LEFT JOIN summed a ON a.sid = m.sid AND a.k = m.k""",
}
SELECTS = {
    "parse_status": "SELECT sql_id, ok AS parse_ok, sniff AS sniffs_cte, dialect FROM facts",
    "output_field_names": f"""SELECT sql_id, CAST(k AS INTEGER) AS pos, kind, alias, qualifier, col AS column_name, CASE WHEN alias = '' AND (kind = 'column' OR kind = 'star' AND qualifier <> '') THEN 'unknown' ELSE 'expression' END AS source_type
        FROM fields JOIN {_ID} USING (sid)""",
    "table_references": f"""SELECT sql_id, CAST(k - 1 AS INTEGER) AS pos, name AS full_name, alias, top AS is_top_level FROM refs JOIN {_ID} USING (sid)""",
    "analysis_diagnostics": f"SELECT sql_id, CAST(row_number() OVER (PARTITION BY sid ORDER BY phase, k, n) - 1 AS INTEGER) AS ord, code, level, message FROM told JOIN {_ID} USING (sid)",
    "diagnostic_counts": "SELECT code, level, count(*) AS n FROM told GROUP BY ALL",
    "analysis_nodes": f"SELECT sql_id, ord, id, node_type, label FROM nodes JOIN {_ID} USING (sid)",
    "analysis_edges": f"SELECT sql_id, ord, id, source, target, edge_type FROM edges JOIN {_ID} USING (sid)",
    "analysis_features": f"SELECT sql_id, CAST(row_number() OVER (PARTITION BY sid ORDER BY a, k, n) - 1 AS INTEGER) AS ord, feature FROM marks JOIN {_ID} USING (sid)",
    "analysis_stages": f"SELECT sql_id, CAST(row_number() OVER (PARTITION BY sid ORDER BY n) - 1 AS INTEGER) AS ord, stage, status, codes, message FROM stages JOIN {_ID} USING (sid)",
    "lineage_columns": f"""SELECT sql_id, CAST(row_number() OVER (PARTITION BY sid ORDER BY phase, k, t, c) - 1 AS INTEGER) AS ord, source_table, source_column, output_column FROM lineage JOIN {_ID} USING (sid)""",
    "analysis_summary": """SELECT sql_id, '0.3.0-c05' AS schema_version, 'analysis:c05' AS analysis_id, status,
        CASE WHEN NOT ok THEN 'unknown' WHEN graph AND sniff THEN 'medium' WHEN status = 'success' THEN 'high' ELSE 'unknown' END AS confidence_level, dialect,
        CAST(CASE WHEN ok THEN 0 ELSE 1 END AS INTEGER) AS error_count, CAST(n_warnings AS INTEGER) AS warning_count, CAST(0 AS INTEGER) AS info_count,
        CASE WHEN n_nodes = 0 THEN 'column' WHEN sniff THEN 'subquery_dependency' ELSE 'table' END AS view_mode,
        CAST(n_nodes AS INTEGER) AS node_count, CAST(n_edges AS INTEGER) AS edge_count, CAST(n_fields AS INTEGER) AS output_field_count FROM results""",
}
