"""What clients compute from graphs: views, levels, layout, search, look-ups, all set-at-a-time.

Graphs come as two tables, ``nodes(sql_id, ord, id, node_type, label)`` and
``edges(sql_id, ord, id, source, target, edge_type)``.  Ids are unique per statement; rows of unknown
statements or with null ids simply find no partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.hierarchy import frontier_paths
from strandline.workspace import materialise

#: How node and edge types are shown.
NODE_TYPES = {
    "table": "table", "column": "column", "physical_column": "column", "cte": "cte", "subquery": "subquery", "output": "output",
    "output_column": "output_field", "output_field": "output_field", "expression": "expression", "unknown": "unknown",
}
EDGE_TYPES = {
    "column_lineage": "projection", "table_to_result": "table", "table_to_cte": "table", "cte_dependency": "cte", "cte_to_result": "output",
    "projection": "projection", "alias": "alias", "unknown": "unknown", "cte": "cte", "subq": "subq", "subquery": "subq",
    "expr": "expr", "expression": "expr", "join": "join", "output": "output",
}
NODE_TAGS = {"output_column": "OUT", "output_field": "OUT", "column": "COL", "table": "TBL", "expression": "EXPR", "unknown": "?"}
#: Which node types a view keeps; other views keep all.
VIEW_TYPES = {
    "table": ("table", "output"),
    "subquery": ("table", "cte", "subquery", "output"),
    "column": ("column", "output_field", "expression", "unknown"),
}
VIEW_MODES = ("table", "subquery", "column", "semantics", "expression", "diagnostics")
#: The render modes that events lead to, whether the viewport stays, whether layout is redone.
RENDER_EVENTS = {
    "ANALYZE_SUCCESS": ("subquery_dependency", False, True), "SELECT_OUTPUT_FIELD": ("current_field_path", False, False),
    "FOCUS_FIELD": ("focus_field", True, False), "OPEN_SEMANTIC_MODE": ("semantic_mode", True, False),
    "ENTER_LARGE_GRAPH": ("large_graph", True, False), "OPEN_FULL_PREVIEW": ("full_graph_preview", False, True),
    "CLEAR_SELECTION": ("subquery_dependency", False, False), "ANALYZE_FAILED": ("subquery_dependency", False, False),
}
#: Layout of structure graphs and of the table view.
LEFT, TOP, LEVEL_GAP, ROW_GAP = 72, 72, 170, 56
TABLE_VIEW_X, TABLE_VIEW_OUTPUT_X, TABLE_VIEW_GAP = 72, 292, 58
#: Places of columns and outputs beside a structure, and where a graph has only them.
COLUMN_X, FIELD_X, FIELDS_TOP, FIELD_GAP = 70, 420, 280, 76
ONLY_FIELD_X, ONLY_TOP = 380, 70
#: The result that graphs without one are given.
RESULT_ID, RESULT_LABEL, RESULT_LABEL_COLS = "out:query_result", "Query Result", "Query Result (%d cols)"
#: Width and height of a node's box by type; others are BOX.
BOXES = {"output": (132, 32), "subquery": (138, 32), "cte": (125, 30), "output_field": (125, 30), "expression": (125, 30), "column": (122, 29)}
BOX = (118, 29)
#: Order of completion candidates.
COMPLETION_ORDER = {"keyword": "0", "function": "1", "table": "2", "column": "3"}

_ROUNDS_PER_JOB = 8


def _mapped(c: Column, names: dict[str, str], other: str | None) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(c, F.lit(""))), F.lit(other))


def shown_node_type(c: Column) -> Column:
    return _mapped(c, NODE_TYPES, "output")


def shown_edge_type(c: Column) -> Column:
    return _mapped(c, EDGE_TYPES, "table")


def node_tag(c: Column) -> Column:
    return _mapped(c, NODE_TAGS, None)


def short_label(c: Column) -> Column:
    """The last dotted part of a label."""
    return F.when(F.element_at(F.split(c, r"\."), -1) != "", F.element_at(F.split(c, r"\."), -1)).otherwise(c)


def view(nodes: DataFrame, edges: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """The nodes a view keeps, and the edges between them.  Null types count as ``output``."""
    kinds = VIEW_TYPES.get(mode)
    if kinds is None:
        return nodes, edges
    kept = nodes.where(shown_node_type(F.col("node_type")).isin(*kinds))
    ids = kept.select("sql_id", "id").dropDuplicates()
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), ["sql_id", end], "left_semi")
    return kept, edges


def table_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table view: where a statement has exactly one output, tables without an edge to it get one.

    Nodes get positions: tables in one column, the output beside their middle.
    """
    kept, inner = view(nodes, edges, "table")
    inner = inner.select("sql_id", "id", "source", "target", shown_edge_type(F.col("edge_type")).alias("type"))
    kind = shown_node_type(F.col("node_type"))
    outputs = kept.where(kind == "output").groupBy("sql_id").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1").drop("n")
    wanted = kept.where(kind == "table").select("sql_id", F.col("id").alias("source")).join(outputs, "sql_id")
    missing = wanted.join(inner.select("sql_id", "source", "target"), ["sql_id", "source", "target"], "left_anti")
    added = missing.select("sql_id", F.concat(F.lit("table-view:"), "source", F.lit("->"), "target").alias("id"), "source", "target", F.lit("table").alias("type"))
    tables = kept.withColumn("kind", kind)
    row = F.count(F.when(F.col("kind") == "table", 1)).over(Window.partitionBy("sql_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    total = F.count(F.when(F.col("kind") == "table", 1)).over(Window.partitionBy("sql_id"))
    place = F.row_number().over(Window.partitionBy("sql_id").orderBy("ord")) - 1
    y = F.when(F.col("kind") == "table", TOP + row * TABLE_VIEW_GAP).when(total > 0, TOP + (total - 1) * TABLE_VIEW_GAP / 2).otherwise(TOP + place * TABLE_VIEW_GAP)
    laid = tables.select("sql_id", "id", F.col("kind").alias("type"), "label", F.when(F.col("kind") == "table", TABLE_VIEW_X).otherwise(TABLE_VIEW_OUTPUT_X).alias("x"), y.cast("double").alias("y"))
    return laid, inner.unionByName(added)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``sql_id, id, level`` of the structure nodes.

    Tables are on level 0.  Round by round, a CTE or subquery with a placed source goes one level below
    the lowest of its sources placed so far; one without any source is on level 1; those on or behind
    loops that no table feeds end on level 0; outputs go one below all others.  Rounds see the same
    placed nodes for all of a statement, so the result doesn't depend on the order of rows.
    """
    kind = shown_node_type(F.col("node_type"))
    own = nodes.where(kind.isin("table", "cte", "subquery", "output")).select("sql_id", "id", kind.alias("kind")).dropDuplicates(["sql_id", "id"])
    own = materialise(own, "nodes")
    links = materialise(edges.where("source <> '' and target <> ''").select("sql_id", F.col("source").alias("id"), "target").dropDuplicates(), "links")
    fed = links.select("sql_id", F.col("target").alias("id")).dropDuplicates()
    inner = own.where(F.col("kind").isin("cte", "subquery")).select("sql_id", "id")
    free = inner.join(fed, ["sql_id", "id"], "left_anti").withColumn("level", F.lit(1))
    placed = materialise(own.where("kind = 'table'").select("sql_id", "id", F.lit(0).alias("level")).unionByName(free), "levels")
    waiting = inner.join(fed, ["sql_id", "id"], "left_semi")
    links = materialise(links.join(waiting.withColumnRenamed("id", "target"), ["sql_id", "target"], "left_semi").select("sql_id", "id", "target"), "links")
    mixed = links.groupBy("sql_id", "target").count().where("count > 1").select("sql_id").dropDuplicates()
    if mixed.isEmpty():
        placed = _chained(placed, links)
    else:
        mixed = materialise(mixed, "mixed")
        part = lambda df, how: materialise(df.join(mixed, "sql_id", how), "levels")
        placed = _chained(part(placed, "left_anti"), part(links, "left_anti")).unionByName(_in_rounds(part(placed, "left_semi"), part(links, "left_semi")))
    rest = own.where("kind <> 'output'").join(placed, ["sql_id", "id"], "left").select("sql_id", "id", F.coalesce("level", F.lit(0)).alias("level"))
    lowest = rest.groupBy("sql_id").agg(F.max("level").alias("low"))
    outputs = own.where("kind = 'output'").join(lowest, "sql_id", "left").select("sql_id", "id", (F.coalesce("low", F.lit(0)) + 1).alias("level"))
    return rest.unionByName(outputs)


def _chained(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Levels where every waiting node has one source: one more than that of the source."""
    base = F.when(F.col("level") == 1, F.array(F.lit(""), "id")).otherwise(F.array("id"))  # a free node begins one level down
    roots = materialise(placed.select(F.col("sql_id").alias("tree"), F.col("id").alias("node"), base.alias("path")), "roots")
    found = frontier_paths(roots, links.select(F.col("sql_id").alias("tree"), F.col("id").alias("parent"), F.col("target").alias("child")))
    return found.select(F.col("tree").alias("sql_id"), F.col("node").alias("id"), (F.size("path") - 1).alias("level"))


def _in_rounds(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Levels where nodes have several sources: those placed in the same round see the same placed sources."""
    while True:
        step = placed.join(links, ["sql_id", "id"]).groupBy("sql_id", F.col("target").alias("id")).agg((F.max("level") + 1).alias("level"))
        step = materialise(step, "levels")
        if step.isEmpty():
            return placed
        placed = placed.unionByName(step)
        links = materialise(links.join(step.select("sql_id", F.col("id").alias("target")), ["sql_id", "target"], "left_anti").select("sql_id", "id", "target"), "links")


def layout(nodes: DataFrame, edges: DataFrame, node_levels: DataFrame) -> DataFrame:
    """``sql_id, id, level, x, y``: levels side by side, rows in node order, outputs beside their sources' mean."""
    kind = shown_node_type(F.col("node_type"))
    own = nodes.select("sql_id", "ord", "id", kind.alias("kind")).join(node_levels, ["sql_id", "id"])
    row = F.row_number().over(Window.partitionBy("sql_id", "level").orderBy("ord")) - 1
    x = LEFT + F.col("level") * LEVEL_GAP
    inner = own.where("kind <> 'output'").select("sql_id", "id", "level", x.alias("x"), (TOP + row * ROW_GAP).cast("double").alias("y"))
    means = edges.select("sql_id", F.col("source").alias("id"), F.col("target").alias("out")).join(inner, ["sql_id", "id"]).groupBy("sql_id", F.col("out").alias("id")).agg(F.avg("y").alias("own_y"))
    overall = inner.groupBy("sql_id").agg(F.avg("y").alias("all_y"))
    outputs = own.where("kind = 'output'").join(means, ["sql_id", "id"], "left").join(overall, "sql_id", "left")
    return inner.unionByName(outputs.select("sql_id", "id", "level", x.alias("x"), F.coalesce("own_y", "all_y", F.lit(float(TOP))).alias("y")))


def place_all(nodes: DataFrame, edges: DataFrame, node_levels: DataFrame) -> DataFrame:
    """``sql_id, id, type, label, x, y`` of everything that is drawn.

    Structure nodes are laid out by level, columns and output fields below them; where a statement has
    columns only, sources and outputs stand in two rows.  A structure without a result gets one, beside
    the mean of its tables, CTEs and subqueries, labelled with the number of its output fields.
    """
    own = nodes.withColumn("kind", shown_node_type(F.col("node_type")))
    structure = F.col("kind").isin("table", "cte", "subquery", "output")
    flags = own.groupBy("sql_id").agg(F.max(structure).alias("has_structure"), F.max(F.col("kind") == "output").alias("has_result"), F.count_if(F.col("node_type") == "output_column").alias("n_fields"))
    laid = layout(nodes, edges, node_levels).select("sql_id", "id", F.col("x").cast("int").alias("x"), "y").join(own.select("sql_id", "id", "kind", "label"), ["sql_id", "id"])
    before = Window.partitionBy("sql_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # a statement's own nodes
    sources = F.count_if(F.col("node_type") == "physical_column").over(before)
    fields = F.count_if(F.col("node_type") == "output_column").over(before)
    columns = own.withColumns({"s": sources, "f": fields}).where(F.col("node_type").isin("physical_column", "output_column")).join(flags, "sql_id")
    is_field = F.col("node_type") == "output_column"
    row = F.when(F.col("has_structure"), F.when(is_field, F.greatest(F.col("s") - 1, F.lit(0))).otherwise(F.col("s"))).otherwise(F.when(is_field, F.col("f")).otherwise(F.col("s")))
    x = F.when(~is_field, COLUMN_X).when(F.col("has_structure"), FIELD_X).otherwise(ONLY_FIELD_X)
    y = F.when(F.col("has_structure"), FIELDS_TOP).otherwise(ONLY_TOP) + row * FIELD_GAP
    placed = columns.select("sql_id", "id", "kind", "label", x.alias("x"), y.cast("double").alias("y"))
    means = laid.where("kind <> 'output'").groupBy("sql_id").agg(F.avg("y").alias("y"))
    deepest = node_levels.groupBy("sql_id").agg(F.max("level").alias("deep"))
    lacking = flags.where("not has_result and (has_structure or n_fields = 0)").join(means, "sql_id", "left").join(deepest, "sql_id", "left")
    name = F.when(F.col("n_fields") > 0, F.format_string(RESULT_LABEL_COLS, "n_fields")).otherwise(RESULT_LABEL)
    made = lacking.select("sql_id", F.lit(RESULT_ID).alias("id"), F.lit("output").alias("kind"), name.alias("label"), (LEFT + (F.coalesce("deep", F.lit(0)) + 1) * LEVEL_GAP).alias("x"), F.coalesce("y", F.lit(float(TOP))).alias("y"))
    return laid.select("sql_id", "id", "kind", "label", "x", "y").unionByName(placed).unionByName(made).withColumnRenamed("kind", "type")


def bounds(laid: DataFrame, nodes: DataFrame) -> DataFrame:
    """The box around all boxes of a statement; a box's size is that of its node's type."""
    kind = shown_node_type(F.col("node_type"))
    size = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for t, box in BOXES.items() for x in (t, box[k])]), kind), F.lit(BOX[k]))
    boxes = laid.join(nodes.select("sql_id", "id", size(0).alias("w"), size(1).alias("h")), ["sql_id", "id"])
    return boxes.groupBy("sql_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max(F.col("x") + F.col("w")).alias("max_x"), F.max(F.col("y") + F.col("h")).alias("max_y"))


def entity_set(nodes: DataFrame, mode: str) -> DataFrame:
    """``sql_id, id`` of the entities that may be selected in a view: what the table and column views keep, else all."""
    kinds = VIEW_TYPES[mode] if mode in ("table", "column") else None
    kept = nodes if kinds is None else nodes.where(shown_node_type(F.col("node_type")).isin(*kinds))
    return kept.select("sql_id", "id").dropDuplicates()


def select_results(selections: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What selecting search entries leads to.

    ``selections`` has selection_id, sql_id, entity_id, type, view_mode, mode.  Outside the column view an output
    field leads to the first table that feeds it; the result itself, sources and fields without a table lead
    to themselves.  Adds selected_entity, selected_output (null for sources) and next_mode.
    """
    tables = nodes.where("node_type = 'table'").select("sql_id", "ord", F.col("id").alias("table_node"))
    feeds = column_tables(nodes, edges).withColumnRenamed("id", "entity_id").join(tables, "sql_id").where(F.contains("table_node", "table_id"))
    first = feeds.groupBy("sql_id", "entity_id").agg(F.min_by("table_node", "ord").alias("owner"))
    found = selections.join(first, ["sql_id", "entity_id"], "left")
    jumps = (F.col("type") == "output") & (F.col("entity_id") != RESULT_ID) & (F.col("view_mode") != "column")
    told = found.withColumn("event", F.when(F.col("type") == "output", "SELECT_OUTPUT_FIELD").otherwise("FOCUS_FIELD"))
    return render_mode(told).select(
        *selections.columns, F.when(jumps, F.coalesce("owner", "entity_id")).otherwise(F.col("entity_id")).alias("selected_entity"),
        F.when(F.col("type") == "output", F.col("entity_id")).alias("selected_output"), "next_mode",
    )


def column_tables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``sql_id, id, table_id``: tables whose short name stands in the id of a source of ``id``.

    This is a substring test within one statement, kept for parity: ``t`` is found in ``target`` too.
    """
    tables = nodes.where("node_type = 'table'").select("sql_id", F.col("id").alias("table_id"), F.element_at(F.split("id", ":"), -1).alias("tail"))
    pairs = edges.where("source <> '' and target <> ''").select("sql_id", "source", F.col("target").alias("id")).join(tables, "sql_id")
    return pairs.where(F.contains("source", "tail")).select("sql_id", "id", "table_id").dropDuplicates()


def neighbourhood(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """``sql_id, id``: the selected nodes and all that share an edge with one.  ``selected`` has sql_id, id."""
    pairs = edges.select("sql_id", F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))).alias("p"))
    near = pairs.select("sql_id", "p.id", "p.other").join(selected.select("sql_id", "id"), ["sql_id", "id"])
    return near.select("sql_id", F.col("other").alias("id")).unionByName(near.select("sql_id", "id")).dropDuplicates()


def upstream(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """``sql_id, start, id, distance``: all that feeds each selected node, by the shortest way.

    ``selected`` has sql_id, id.  A node on a loop feeds itself at the length of the loop; every pair comes
    once, so loops end.
    """
    links = materialise(edges.where("source <> '' and target <> ''").select("sql_id", F.col("target").alias("id"), "source").dropDuplicates(), "links")
    front = selected.select("sql_id", F.col("id").alias("start"), "id").dropDuplicates()
    found, distance = None, 0
    while True:
        block = None
        for _ in range(_ROUNDS_PER_JOB):
            distance += 1
            front = front.join(links, ["sql_id", "id"]).select("sql_id", "start", F.col("source").alias("id")).dropDuplicates()
            step = front.withColumn("distance", F.lit(distance))
            block = step if block is None else block.unionByName(step)
        block = block.groupBy("sql_id", "start", "id").agg(F.min("distance").alias("distance"))
        if found is not None:
            block = block.join(found, ["sql_id", "start", "id"], "left_anti")
        block = materialise(block, "upstream")
        if block.isEmpty():
            return block if found is None else found
        found = block if found is None else found.unionByName(block)
        front = block.where(F.col("distance") == distance).drop("distance")


def highlights(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame, mode: str) -> DataFrame:
    """``sql_id, kind, id`` of what a view marks: expressions, entities with diagnostics, joins and CTEs."""
    shown_nodes, shown_edges = view(nodes, edges, mode)
    kind, edge_kind = shown_node_type(F.col("node_type")), shown_edge_type(F.col("edge_type"))
    none = nodes.where("false").select("sql_id", F.lit("node").alias("kind"), "id")
    if mode == "expression":
        return shown_nodes.where(kind == "expression").select("sql_id", F.lit("node").alias("kind"), "id").unionByName(shown_edges.where(edge_kind == "expr").select("sql_id", F.lit("edge").alias("kind"), "id"))
    if mode == "diagnostics":
        return diagnostics.select("sql_id", F.lit("node").alias("kind"), F.col("entity_id").alias("id")).dropDuplicates()
    if mode in ("subquery", "semantics"):
        return shown_nodes.where(kind == "cte").select("sql_id", F.lit("node").alias("kind"), "id").unionByName(shown_edges.where(edge_kind == "join").select("sql_id", F.lit("edge").alias("kind"), "id"))
    return none


def search_index(nodes: DataFrame, edges: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """``sql_id, entity_id, display_name, type, sub, reason, confidence``: result, outputs, sources.

    ``statuses`` has sql_id and status: the result of a partial analysis has medium confidence.
    """
    kind = shown_node_type(F.col("node_type"))
    outs = nodes.where("node_type = 'output_column'").select("sql_id", F.col("id").alias("entity_id"), F.col("label").alias("display_name"))
    from_tables = column_tables(nodes, edges).groupBy("sql_id", F.col("id").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_set("table_id")), ", ").alias("tables"))
    outs = outs.join(from_tables, ["sql_id", "entity_id"], "left")
    known = F.col("tables").isNotNull()
    outs = outs.select(
        "sql_id", "entity_id", "display_name", F.lit("output").alias("type"), F.when(known, F.concat(F.lit("from: "), "tables")).otherwise("unknown source").alias("sub"),
        F.when(known, F.concat(F.lit("-> "), "tables")).otherwise("source can't be confirmed").alias("reason"), F.when(known, "high").otherwise("low").alias("confidence"),
    )
    sources = nodes.where(kind.isin("table", "cte", "subquery")).select(
        "sql_id", F.col("id").alias("entity_id"), short_label(F.col("label")).alias("display_name"), F.lit("source").alias("type"), kind.alias("sub"), F.lit("backend").alias("reason"), F.lit("high").alias("confidence")
    )
    counts = nodes.groupBy("sql_id").agg(F.count_if(kind.isin("table", "cte", "subquery")).alias("t"), F.count_if(F.col("node_type") == "output_column").alias("c"), F.min(F.when(kind == "output", F.col("id"))).alias("result"))
    name = F.when(F.col("c") > 0, F.format_string(RESULT_LABEL_COLS, "c")).otherwise(RESULT_LABEL)
    counts = counts.withColumn("partial", F.lit(False)) if statuses is None else counts.join(statuses.groupBy("sql_id").agg(F.max(F.col("status") == "partial").alias("partial")), "sql_id", "left")
    result = counts.select(
        "sql_id", F.coalesce("result", F.lit(RESULT_ID)).alias("entity_id"), name.alias("display_name"), F.lit("output").alias("type"),
        F.format_string("%d tables, %d cols", "t", "c").alias("sub"), F.lit("sql analyze").alias("reason"), F.when(F.col("partial"), "medium").otherwise("high").alias("confidence"),
    )
    return result.unionByName(outs).unionByName(sources)


def search(index: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """Entries whose text contains the query, letter case aside; scope ``output`` looks at names only."""
    q = query.strip().lower()
    if not q:
        return index
    text = F.col("display_name") if scope == "output" else F.concat_ws(" ", "display_name", "sub", "reason")
    return index.where(F.contains(F.lower(text), F.lit(q)))


def cursor_match(cursors: DataFrame, locations: DataFrame) -> DataFrame:
    """``cursor_id, entity_id``: on the cursor's line the nearest location that begins at or before it.

    ``cursors`` has cursor_id, sql_id, line, col; of equally near locations the smallest entity wins.
    """
    places = locations.select("sql_id", "line", F.col("col").alias("start"), "entity_id")
    near = cursors.join(places, ["sql_id", "line"]).where(F.col("start") <= F.col("col"))
    return near.groupBy("cursor_id").agg(F.min(F.struct((F.col("col") - F.col("start")).alias("d"), "entity_id")).alias("m")).select("cursor_id", "m.entity_id")


def editor_ranges(locations: DataFrame) -> DataFrame:
    """Ranges from 1: a location covers at least one character."""
    return locations.select("sql_id", "entity_id", F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), (F.col("col") + F.greatest("len", F.lit(1))).alias("end_col"))


def completion(candidates: DataFrame) -> DataFrame:
    """Candidates (text, type) in the order shown: keywords, functions, tables, columns, then by text."""
    rank = _mapped(F.col("type"), COMPLETION_ORDER, "9")
    return candidates.withColumn("sort_text", F.concat(rank, F.lit("_"), F.lower("text"))).orderBy("sort_text", "text")


def hover(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Type, comment and table of each word that names a column.  ``words`` has word."""
    return words.join(columns.select(F.col("name").alias("word"), "table_name", "data_type", "comment"), "word")


def change_groups(changes: DataFrame) -> DataFrame:
    """Per payload and table name the change type told first and the number of columns."""
    order = F.struct("table_pos", "column_pos")
    return changes.groupBy("payload_id", "table_name").agg(F.min_by("change_type", order).alias("change_type"), F.count_if(F.col("object_type") == "column").alias("n_columns"))


def render_mode(events: DataFrame) -> DataFrame:
    """``mode`` after each event (mode, event); unknown events leave it."""
    rows = [F.struct(F.lit(m).alias("to"), F.lit(k).alias("keep"), F.lit(r).alias("redo")) for m, k, r in RENDER_EVENTS.values()]
    rule = F.try_element_at(F.create_map(*[x for pair in zip(map(F.lit, RENDER_EVENTS), rows) for x in pair]), F.col("event"))
    return events.select("*", F.coalesce(rule["to"], F.col("mode")).alias("next_mode"), rule["keep"].alias("preserve_viewport"), rule["redo"].alias("recompute_layout"))


def entity_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics as entities show them: those without an entity belong to the whole output."""
    return diagnostics.select("sql_id", "ord", F.lit("out:group").alias("entity_id"), F.coalesce("level", F.lit("info")).alias("severity"), "code", "message")


def related_mappings(mappings: DataFrame, selected: DataFrame) -> DataFrame:
    """Mappings of ``expression_lineage.mappings`` whose source or target is a selected entity.

    ``selected`` has sql_id and id, as nodes have them; the source's table counts too.
    """
    source = F.concat(F.lit("physical_column:"), "source_table", F.lit("."), "source_column")
    ends = F.array(source, F.concat(F.lit("physical_table:"), "source_table"), F.concat(F.lit("output_column:"), "output"))
    spread = mappings.withColumn("id", F.explode(ends)).join(selected.select("sql_id", "id").dropDuplicates(), ["sql_id", "id"], "left_semi")
    return spread.select(*mappings.columns).dropDuplicates()
