"""The same results in SQL, for the driver's side-by-side check."""

BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_TYPE = f"lower(regexp_replace(data_type, '{BLANK}+', '', 'g'))"
_COMMENT = f"coalesce(regexp_replace(comment, '^{BLANK}+|{BLANK}+$', '', 'g'), '')"

_SNAPS = f"""
WITH imports AS (
  SELECT id AS import_id, source_name,
         lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id
  FROM (SELECT DISTINCT id, source_name, imported_at FROM metadata_imports)
  WINDOW w AS (PARTITION BY source_name ORDER BY imported_at NULLS FIRST, id)
), tables AS (
  SELECT DISTINCT id AS table_id, catalog, schema_name, table_name, import_id FROM table_metadata
), ranked AS (
  SELECT t.import_id, t.catalog, t.schema_name, t.table_name, c.name AS column_name, c.data_type AS told_type, c.comment AS told_comment,
         {_TYPE.replace('data_type', 'c.data_type')} AS data_type, {_COMMENT.replace('comment', 'c.comment')} AS comment,
         c.ordinal, c.is_partition, c.nullable,
         row_number() OVER (PARTITION BY t.import_id, t.catalog, t.schema_name, t.table_name, c.name
                            ORDER BY c.loaded_at DESC NULLS LAST, c.id DESC) AS rn
  FROM column_metadata c JOIN tables t ON c.table_id = t.table_id
), snap AS (
  SELECT r.*, i.prev_id, i.next_id FROM ranked r JOIN imports i USING (import_id) WHERE rn = 1
), pairs AS (
  SELECT coalesce(n.import_id, o.next_id) AS import_id,
         coalesce(n.catalog, o.catalog) AS catalog, coalesce(n.schema_name, o.schema_name) AS schema_name,
         coalesce(n.table_name, o.table_name) AS table_name, coalesce(n.column_name, o.column_name) AS column_name,
         o.told_type AS old_data_type, o.told_comment AS old_comment, n.told_type AS new_data_type, n.told_comment AS new_comment,
         CASE WHEN o.import_id IS NULL THEN 'added' WHEN n.import_id IS NULL THEN 'removed'
              WHEN n.data_type IS DISTINCT FROM o.data_type OR n.comment IS DISTINCT FROM o.comment
                OR n.ordinal IS DISTINCT FROM o.ordinal OR n.is_partition IS DISTINCT FROM o.is_partition
                OR n.nullable IS DISTINCT FROM o.nullable THEN 'changed' END AS change_type
  FROM (SELECT * FROM snap WHERE prev_id IS NOT NULL) n
  FULL JOIN (SELECT * FROM snap WHERE next_id IS NOT NULL) o
    ON n.prev_id = o.import_id AND n.catalog IS NOT DISTINCT FROM o.catalog
   AND n.schema_name IS NOT DISTINCT FROM o.schema_name AND n.table_name IS NOT DISTINCT FROM o.table_name
   AND n.column_name IS NOT DISTINCT FROM o.column_name
)
"""
P1_FOUND = _SNAPS + "SELECT import_id, catalog, schema_name, table_name, column_name, change_type FROM pairs WHERE change_type IS NOT NULL"
P1_VALUES = _SNAPS + """SELECT import_id, catalog, schema_name, table_name, column_name, old_data_type, old_comment, new_data_type, new_comment
FROM pairs WHERE change_type = 'changed'"""

_FOREST = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT sql_id, source, target FROM structure_edges
  WHERE source IS NOT NULL AND target IS NOT NULL
), nodes AS (
  SELECT sql_id, source AS node FROM structure_edges WHERE source IS NOT NULL
  UNION SELECT sql_id, target FROM structure_edges WHERE target IS NOT NULL
), placed(sql_id, node, trail) AS (
  SELECT n.sql_id, n.node, [n.node] FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.sql_id = n.sql_id AND e.target = n.node)
  UNION ALL
  SELECT e.sql_id, e.target, list_append(p.trail, e.target)
  FROM placed p JOIN edges e ON e.sql_id = p.sql_id AND e.source = p.node
)"""
P2_DESCENDANTS = _FOREST + " SELECT sql_id, unnest(trail[:-2]) AS node, node AS below FROM placed"
P2_FOUND = _FOREST + """, rest AS (
  SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.sql_id = n.sql_id AND p.node = n.node)
), hung AS (
  SELECT e.* FROM edges e JOIN rest a ON a.sql_id = e.sql_id AND a.node = e.source
  JOIN rest b ON b.sql_id = e.sql_id AND b.node = e.target
), reach(sql_id, start, node) AS (
  SELECT sql_id, source, target FROM hung
  UNION
  SELECT r.sql_id, r.start, h.target FROM reach r JOIN hung h ON h.sql_id = r.sql_id AND h.source = r.node
), below AS (
  SELECT sql_id, node, count(*) AS n FROM (SELECT sql_id, unnest(trail[:-2]) AS node FROM placed) GROUP BY ALL
)
SELECT p.sql_id, p.node, 'tree' AS state, p.trail[1] AS root, CAST(len(p.trail) - 1 AS BIGINT) AS depth,
       array_to_string(p.trail, ' > ') AS path, CAST(coalesce(b.n, 0) AS BIGINT) AS n_descendants
FROM placed p LEFT JOIN below b ON b.sql_id = p.sql_id AND b.node = p.node
UNION ALL
SELECT sql_id, node,
       CASE WHEN EXISTS (SELECT 1 FROM reach c WHERE c.sql_id = r.sql_id AND c.start = r.node AND c.node = r.node)
            THEN 'cycle' ELSE 'below' END, '', CAST(-1 AS BIGINT), '', CAST(-1 AS BIGINT)
FROM rest r
"""

_PERIODS = f"""
WITH settled AS (
  SELECT column_id, changed_at,
         CASE WHEN coalesce(change_type = 'removed', false) THEN NULL
              ELSE {{'t': {_TYPE}, 'c': {_COMMENT}}} END AS state
  FROM column_updates WHERE changed_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY column_id, changed_at ORDER BY received_at DESC NULLS LAST, update_id DESC) = 1
), changes AS (
  SELECT * FROM settled
  QUALIFY row_number() OVER (PARTITION BY column_id ORDER BY changed_at) = 1
       OR state IS DISTINCT FROM lag(state) OVER (PARTITION BY column_id ORDER BY changed_at)
), periods AS (
  SELECT column_id, state, changed_at, lead(changed_at) OVER (PARTITION BY column_id ORDER BY changed_at) AS until FROM changes
)
"""
P5_FOUND = _PERIODS + """
SELECT column_id, CAST(floor(epoch(changed_at)) AS BIGINT) AS valid_from_s,
       CAST(coalesce(floor(epoch(until)), -1) AS BIGINT) AS valid_to_s
FROM periods WHERE state IS NOT NULL
"""

P5_HISTORY = _PERIODS + """
SELECT column_id, state.t AS data_type, state.c AS comment, changed_at AS valid_from, until AS valid_to FROM periods WHERE state IS NOT NULL
"""

ORACLES = {"p1_found": P1_FOUND, "p1_values": P1_VALUES, "p2_descendants": P2_DESCENDANTS, "p2_found": P2_FOUND, "p5_found": P5_FOUND, "p5_history": P5_HISTORY}
