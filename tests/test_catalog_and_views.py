"""Catalog import and look-ups, and what clients compute from graphs."""

import json

import pytest

from strandline.operators import catalog, expression_lineage, views
from strandline.sources.nested_json import flatten_payloads
from strandline.sources.statements import normalized_dialect, output_fields, parse_statements, read_requests, source_locations, source_tables, statements
from strandline.workspace import scratch_path

F_ORD = {
    "metadata_version": "v1", "source_name": "s",
    "tables": [
        {"table_name": "dwd_order_di", "columns": [{"name": n, "data_type": "string"} for n in ("order_no", "user_id", "order_amount")]},
        {"table_name": "dim_user_df", "schema": "x", "columns": [{"name": "user_id"}, {"name": "country_name", "ordinal": 1, "nullable": False}]},
    ],
}
NODES = "sql_id long, ord long, id string, node_type string, label string"
EDGES = "sql_id long, ord long, id string, source string, target string, edge_type string"


def flat(spark, payload):
    return flatten_payloads(spark.createDataFrame([(1, json.dumps(payload))], "payload_id long, body string"))


def test_preview_commit_and_read_back(spark):
    store = catalog.CatalogStore(spark, scratch_path(spark, "catalog"))
    seen = catalog.preview(flat(spark, F_ORD), "v1")
    assert (seen.status, seen.import_batch_id, seen.changes.count()) == ("preview_ready", None, 7)
    assert [tuple(r)[2:] for r in seen.summary.collect()] == [(2, 5)]
    done = catalog.commit(flat(spark, F_ORD), "v1", store, "s")
    assert (done.status, done.import_batch_id) == ("committed", "1")
    again = catalog.commit(flat(spark, F_ORD), "v1", store)
    assert again.import_batch_id is None and again.diagnostics[0]["code"] == "METADATA_VERSION_EXISTS"
    assert {r["change_type"] for r in again.changes.collect()} == {"unchanged"}
    more = {"tables": [{"table_name": "dwd_order_di", "columns": [{"name": "new"}, {"name": "new", "comment": "last wins"}]}]}
    assert catalog.commit(flat(spark, more), "v2", store).import_batch_id == "2"
    latest = catalog.latest_columns(store.tables(), store.columns())
    assert [(r["name"], r["comment"]) for r in catalog.columns_of_table(latest, "dwd_order_di").collect()] == [("new", "last wins")]
    assert [(r["name"], r["nullable"]) for r in catalog.columns_of_table(latest, "dim_user_df").collect()] == [("user_id", 1), ("country_name", 0)]
    assert catalog.columns_of_table(latest, "").count() == 0
    assert [r["table_name"] for r in catalog.list_tables(store.tables()).collect()] == ["dim_user_df", "dwd_order_di"]
    assert catalog.count_tables(store.tables()).first()["total"] == 2
    assert {r["table_name"]: r["columns"] for r in catalog.columns_by_name(latest).collect()} == {"dwd_order_di": ["new"], "dim_user_df": ["user_id", "country_name"]}


def test_an_import_that_dies_leaves_no_trace(spark, monkeypatch):
    """Rows written before the death stay unseen, also once the next import has the same id."""
    store = catalog.CatalogStore(spark, scratch_path(spark, "catalog"))
    with monkeypatch.context() as patch:
        patch.setattr(catalog.Versions, "store", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            catalog.commit(flat(spark, F_ORD), "v1", store)
    assert store.tables().count() == 0
    other = {"tables": [{"table_name": "other", "columns": [{"name": "c"}]}]}
    assert catalog.commit(flat(spark, other), "v1", store).import_batch_id == "1"
    assert [r["table_name"] for r in store.tables().collect()] == ["other"] and store.columns().count() == 1


def graph(spark):
    nodes = [(1, k, i, t, i.split(":")[1]) for k, (i, t) in enumerate([("physical_table:db.t", "table"), ("physical_table:u", "table"), ("cte:a", "cte"), ("cte:b", "cte"), ("cte:l", "cte"), ("cte:m", "cte"), ("query_result:final", "output"), ("output_column:c", "output_column")])]
    edges = [("physical_table:db.t", "cte:a"), ("cte:a", "cte:b"), ("physical_table:u", "cte:b"), ("cte:b", "query_result:final"), ("cte:l", "cte:m"), ("cte:m", "cte:l"), ("physical_column:db.t.x", "output_column:c")]
    rows = [(1, k, f"edge:{a}->{b}", a, b, "cte_dependency") for k, (a, b) in enumerate(edges)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES)


def test_views(spark):
    nodes, edges = graph(spark)
    assert views.view(nodes, edges, "subquery")[0].count() == 7 and views.view(nodes, edges, "subquery")[1].count() == 6
    assert [r["id"] for r in views.view(nodes, edges, "column")[0].collect()] == ["output_column:c"]
    assert views.view(nodes, edges, "semantics")[1].count() == 7
    laid, shown = views.table_view(nodes, edges)
    assert sorted((r["source"], r["type"]) for r in shown.collect()) == [("physical_table:db.t", "table"), ("physical_table:u", "table")]
    assert [(r["x"], r["y"]) for r in laid.orderBy("x", "y").collect()] == [(72, 72.0), (72, 130.0), (292, 101.0)]


def test_levels_and_layout(spark):
    nodes, edges = graph(spark)
    found = views.levels(nodes, edges)
    assert {r["id"].split(":")[1]: r["level"] for r in found.collect()} == {"db.t": 0, "u": 0, "a": 1, "b": 1, "l": 0, "m": 0, "final": 2}
    laid = {r["id"].split(":")[1]: (r["x"], r["y"]) for r in views.layout(nodes, edges, found).collect()}
    assert laid["a"] == (242, 72.0) and laid["b"] == (242, 128.0) and laid["final"] == (412, 128.0)
    assert views.bounds(views.layout(nodes, edges, found), nodes).first()["max_x"] == 412 + 132


def test_deep_levels(spark):
    n = 21
    nodes = [(1, 0, "physical_table:t", "table", "t")] + [(1, k, f"cte:{k}", "cte", str(k)) for k in range(1, n)]
    edges = [(1, 0, "e", "physical_table:t", "cte:1", None)] + [(1, k, "e", f"cte:{k}", f"cte:{k + 1}", None) for k in range(1, n - 1)]
    found = views.levels(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    assert {r["id"]: r["level"] for r in found.collect()} == {"physical_table:t": 0} | {f"cte:{k}": k for k in range(1, n)}


def test_look_ups(spark):
    nodes, edges = graph(spark)
    picked = spark.createDataFrame([(1, "cte:b")], "sql_id long, id string")
    assert {r["id"] for r in views.neighbourhood(edges, picked).collect()} == {"cte:a", "cte:b", "physical_table:u", "query_result:final"}
    assert {r["id"] for r in views.highlights(nodes, edges, nodes, "subquery").collect()} == {"cte:a", "cte:b", "cte:l", "cte:m"}
    index = views.search_index(nodes, edges)
    assert {(r["display_name"], r["confidence"]) for r in index.where("type = 'output'").collect()} == {("Query Result (1 cols)", "high"), ("c", "high")}
    assert [r["entity_id"] for r in views.search(index, " T ", "output").where("type = 'source'").collect()] == ["physical_table:db.t"]
    assert views.search(index, "").count() == index.count()
    places = spark.createDataFrame([(1, "e1", 1, 8, 3), (1, "e2", 1, 20, 0), (1, "e3", 2, 1, 4)], "sql_id long, entity_id string, line int, col int, len int")
    cursors = spark.createDataFrame([(1, 1, 1, 25), (2, 1, 1, 9), (3, 1, 1, 2), (4, 1, 2, 1)], "cursor_id long, sql_id long, line int, col int")
    assert {r["cursor_id"]: r["entity_id"] for r in views.cursor_match(cursors, places).collect()} == {1: "e2", 2: "e1", 4: "e3"}
    assert [r["end_col"] for r in views.editor_ranges(places).orderBy("entity_id").collect()] == [11, 21, 5]
    words = spark.createDataFrame([("b", "column"), ("Z", "keyword"), ("a", "other"), ("t", "table")], "text string, type string")
    assert [r["text"] for r in views.completion(words).collect()] == ["Z", "t", "b", "a"]
    events = spark.createDataFrame([("m", "FOCUS_FIELD"), ("m", "nothing")], "mode string, event string")
    assert {r["event"]: r["next_mode"] for r in views.render_mode(events).collect()} == {"FOCUS_FIELD": "focus_field", "nothing": "m"}


def test_upstream_with_loop(spark):
    _, edges = graph(spark)
    picked = spark.createDataFrame([(1, "query_result:final"), (1, "cte:l")], "sql_id long, id string")
    found = {(r["start"].split(":")[1], r["id"].split(":")[1], r["distance"]) for r in views.upstream(edges, picked).collect()}
    assert found == {("final", "b", 1), ("final", "a", 2), ("final", "u", 2), ("final", "db.t", 3), ("l", "m", 1), ("l", "l", 2)}
    assert views.upstream(edges, picked.where("false")).count() == 0


def test_requests_from_json(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"sql_id": 1, "sql": "select a from t", "analysis_options": {"include_graph": false}}\n{broken\n{"sql_id": 2, "sql": null}\n')
    rows = {r["sql_id"]: (r["sql"], r["include_graph"]) for r in statements(read_requests(spark, str(tmp_path / "r.json"))).collect()}
    assert rows == {1: ("select a from t", False), 2: (None, True)}


def test_shown_types(spark):
    rows = spark.createDataFrame([("physical_column",), ("odd",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(views.shown_node_type(rows.t), views.shown_edge_type(rows.t), views.node_tag(rows.t)).collect()] == [("column", "table", None), ("output", "table", None), ("output", "table", None)]


def test_statement_facts(spark):
    rows = statements(spark.createDataFrame([(1, "select a as x,\n  sum(o.b) s from t o join t u on 1 = 1 join db.v w on 1 = 1", " Hive ")], "sql_id long, sql string, dialect string"))
    facts = parse_statements(rows).cache()
    assert [r["table_name"] for r in source_tables(facts).orderBy("ord").collect()] == ["t", "db.v"]
    assert [(r["entity_id"], r["line"], r["col"], r["len"]) for r in source_locations(facts).collect()] == [("output_column:x", 1, 8, 1), ("output_column:s", 2, 3, 8)]
    assert [(r["output"], r["source_table"], r["source_column"], r["relation"]) for r in expression_lineage.mappings(facts).orderBy("pos").collect()] == [("x", None, "a", "direct"), ("s", "t", "b", "aggregate")]
    picked = spark.createDataFrame([(1, "physical_column:t.b")], "sql_id long, id string")
    assert [r["output"] for r in views.related_mappings(expression_lineage.mappings(facts), picked).collect()] == ["s"]
    assert facts.first()["dialect"] == "hive" and output_fields(facts).count() == 2
    names = spark.createDataFrame([("Doris",), ("oracle",), (None,)], "d string")
    assert [r[0] for r in names.select(normalized_dialect(names.d)).collect()] == ["doris", "spark", "spark"]
