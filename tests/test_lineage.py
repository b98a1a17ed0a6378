"""Golden statements through the whole analysis, and invariants over generated ones."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from strandline.operators.analysis import analyze, diagnostics_of, edges_of, nodes_of, result_json
from strandline.operators.lineage import attach_metadata, column_lineage, resolve
from strandline.operators.structure import check_graph, dangling_edges
from strandline.sources.statements import parse_statements, statements

F_ORD = [("dwd_order_di", ["order_amount", "order_no", "user_id"]), ("dim_user_df", ["country_name", "user_id"])]
JOIN = "select u.country_name, o.order_no from dim_user_df u join dwd_order_di o on u.user_id = o.user_id"
CHAIN = """with order_base as (select user_id, order_no from dwd_order_di),
metric_base as (select user_id, count(order_no) as cnt from order_base group by user_id) select user_id, cnt from metric_base"""


def run(spark, sqls, catalog=(), include_graph=True):
    requests = statements(spark.createDataFrame([(k, q, "spark", include_graph) for k, q in enumerate(sqls)], "sql_id long, sql string, dialect string, include_graph boolean"))
    columns = spark.createDataFrame(list(catalog), "table_name string, columns array<string>")
    return analyze(requests, columns)


def one(spark, sql, catalog=(), include_graph=True):
    return run(spark, [sql], catalog, include_graph).collect()[0]


def codes(row):
    return [d["code"] for d in row["diagnostics"]]


def column_edges(row):
    return [(e["source"].split(":")[1], e["target"].split(":")[1]) for e in row["edges"] if e["edge_type"] == "column_lineage"]


#: The statements, names and outcomes that an analysis must reproduce (FIXTURES.md, section 2).
GOLDEN = [
    # sql, catalog, status, codes, column edges
    ("select a from t", (), "success", [], [("t.a", "a")]),
    ("select a as aa from t", (), "success", [], [("t.a", "aa")]),
    ("select count(*) as cnt from t", (), "partial", ["UNSUPPORTED_COMPLEX_QUERY"], []),
    ("select country_name, count(order_no) as order_cnt from dwd_order_di group by country_name", (), "partial", ["UNSUPPORTED_COMPLEX_QUERY"], [("dwd_order_di.country_name", "country_name")]),
    ("select 1", (), "partial", ["UNSUPPORTED_COMPLEX_QUERY"] * 2, []),
    ("select a, b from db.table", (), "success", [], [("db.table.a", "a"), ("db.table.b", "b")]),
    (JOIN, (), "success", [], [("dim_user_df.country_name", "country_name"), ("dwd_order_di.order_no", "order_no")]),
    ("select x.a from t", (), "partial", ["UNKNOWN_TABLE_ALIAS"], []),
    ("select a from t1 join t2 on t1.id = t2.id", (), "partial", ["AMBIGUOUS_COLUMN"], []),
    ("select u.country_name, a from dim_user_df u join dwd_order_di o on u.user_id = o.user_id", (), "partial", ["AMBIGUOUS_COLUMN"], [("dim_user_df.country_name", "country_name")]),
    ("select * from no_such_table", (), "partial", ["METADATA_MISSING", "SELECT_STAR_METADATA_REQUIRED"], []),
    ("select * from dwd_order_di", F_ORD, "success", [], [(f"dwd_order_di.{c}", c) for c in ("order_amount", "order_no", "user_id")]),
    ("select *, count(order_no) as cnt from dwd_order_di", F_ORD, "partial", ["UNSUPPORTED_COMPLEX_QUERY"], [(f"dwd_order_di.{c}", c) for c in ("order_amount", "order_no", "user_id")]),
    ("select nonexistent_col from dwd_order_di", F_ORD, "partial", ["UNKNOWN_COLUMN"], []),
    ("select country_name from dim_user_df u join dwd_order_di o on u.user_id = o.user_id", F_ORD, "success", [], [("dim_user_df.country_name", "country_name")]),
    ("select user_id from dim_user_df u join dwd_order_di o on u.user_id = o.user_id", F_ORD, "partial", ["AMBIGUOUS_COLUMN"], []),
    ("select user_id from t1 join t2 on t1.id = t2.id", [("t1", ["user_id"])], "partial", ["AMBIGUOUS_COLUMN"], []),
    ("select nonexistent from t1 join t2 on t1.a = t2.b", [("t1", ["a"]), ("t2", ["b"])], "partial", ["UNKNOWN_COLUMN"], []),
    ("select o.* from dwd_order_di o", F_ORD, "success", [], [(f"dwd_order_di.{c}", c) for c in ("order_amount", "order_no", "user_id")]),
    ("select x.* from dwd_order_di o", F_ORD, "partial", ["UNKNOWN_TABLE_ALIAS"], []),
    ("select t.a, u.b from t x join u x on 1 = 1", (), "success", [], [("t.a", "a"), ("u.b", "b")]),
    ("select x.a from t x join u x on 1 = 1", (), "success", [], [("u.a", "a")]),  # the last of an alias wins
    ("select a from (select a from t) q", (), "partial", ["UNSUPPORTED_COMPLEX_QUERY"] * 2, []),
    ("with\nc as (select a from t) select a from c", (), "partial", ["UNSUPPORTED_COMPLEX_QUERY"] * 2, []),
    ("select A from t", [("t", ["a"])], "partial", ["UNKNOWN_COLUMN"], []),
]


def test_golden_statements(spark):
    catalogs = {}
    for k, (sql, catalog, *_rest) in enumerate(GOLDEN):
        catalogs.setdefault(repr(catalog), (catalog, []))[1].append((k, sql))
    for catalog, group in catalogs.values():
        rows = {r["sql_id"]: r for r in run(spark, [q for _, q in group], catalog).collect()}
        for at, (k, sql) in enumerate(group):
            row, (_, _, status, told, edges) = rows[at], GOLDEN[k]
            assert (row["status"], codes(row), column_edges(row)) == (status, told, edges), sql
            assert row["confidence_level"] == ("high" if status == "success" else "unknown")


def test_simple_graph(spark):
    row = one(spark, "select a from t")
    assert {(n["id"], n["node_type"]) for n in row["nodes"]} == {("query_result:final", "output"), ("physical_table:t", "table"), ("physical_column:t.a", "physical_column"), ("output_column:a", "output_column")}
    assert {e["id"] for e in row["edges"]} == {"edge:physical_table:t->query_result:final", "edge:physical_column:t.a->output_column:a"}
    assert (row["view_mode"], row["node_count"], row["edge_count"], row["output_field_count"]) == ("table", 4, 2, 1)
    assert [x["stage"] for x in row["stage_statuses"]] == ["sql_parse", "table_structure", "join_alias_resolve", "graph_build"]


def test_cte_chain(spark):
    row = one(spark, CHAIN)
    assert (row["status"], row["confidence_level"], row["view_mode"]) == ("success", "medium", "subquery_dependency")
    assert [n["id"] for n in row["nodes"]] == ["cte:order_base", "cte:metric_base", "physical_table:dwd_order_di", "query_result:final"]
    assert [(e["source"], e["target"], e["edge_type"]) for e in row["edges"]] == [
        ("physical_table:dwd_order_di", "cte:order_base", "table_to_cte"), ("cte:order_base", "cte:metric_base", "cte_dependency"), ("cte:metric_base", "query_result:final", "cte_to_result"),
    ]


@pytest.mark.parametrize("sql", ["select from", "", None])
def test_failed(spark, sql):
    row = one(spark, sql)
    assert (row["status"], row["confidence_level"], codes(row), row["error_count"]) == ("failed", "unknown", ["SQL_PARSE_ERROR"], 1)
    assert not row["nodes"] and not row["output_fields"] and row["stage_statuses"][0]["status"] == "failed"


@pytest.mark.parametrize("sql", ["select a from t", CHAIN])
def test_graph_not_asked_for(spark, sql):
    row = one(spark, sql, include_graph=False)
    assert (row["status"], row["confidence_level"], row["nodes"], row["view_mode"]) == ("success", "high", [], "column")


def test_star_without_metadata_and_order(spark):
    rows = statements(spark.createDataFrame([(1, "select b.x, * from t2 a join t1 b on 1 = 1")], "sql_id long, sql string"))
    columns = spark.createDataFrame([("t1", ["x"]), ("t2", ["y", "z"])], "table_name string, columns array<string>")
    facts = attach_metadata(parse_statements(rows), columns)
    assert resolve(facts, has_metadata=False).first()["resolved"]["features"] == ["select_star"]
    assert [(r["source_table"], r["output_column"]) for r in column_lineage(resolve(facts)).orderBy("ord").collect()] == [("t2", "y"), ("t2", "z"), ("t1", "x"), ("t1", "x")]


def test_repeated_rows_one_id_and_json(spark):
    requests = spark.createDataFrame([(1, "select a from t"), (1, "select a from t"), (1, "select b from u"), (None, "select a from t")], "sql_id long, sql string")
    results = analyze(statements(requests), spark.createDataFrame([("u", ["c"])], "table_name string, columns array<string>"))
    assert sorted(r["status"] for r in results.collect()) == ["partial", "success"]
    assert '"status":"success"' in " ".join(r["body"] for r in result_json(results).collect())


def test_empty_corpus(spark):
    assert run(spark, []).count() == 0


names = s.sampled_from(["a", "b", "x", "order_no"])
tables = s.sampled_from(["t", "u", "db.v"])
item = s.one_of(names, s.just("*"), s.builds("{}.{}".format, s.sampled_from(["p", "q", "t"]), names), s.builds("count({})".format, names), s.builds("{} as z".format, names))
query = s.builds(lambda i, t, u: f"select {', '.join(i)} from {t} p" + (f" join {u} q on 1 = 1" if u else ""), s.lists(item, min_size=1, max_size=4), tables, s.one_of(s.none(), tables))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(s.lists(query, min_size=8, max_size=20))
def test_invariants(spark, sqls):
    results = run(spark, sqls, [("t", ["a", "b"]), ("u", ["b"])])
    nodes, edges = nodes_of(results), edges_of(results)
    assert dangling_edges(nodes, edges).count() == 0
    check_graph(nodes, edges)
    told = {r["sql_id"]: r["n"] for r in diagnostics_of(results).groupBy("sql_id").agg(F.count("*").alias("n")).collect()}
    for row in results.collect():
        assert (row["status"] == "success") == (told.get(row["sql_id"], 0) == 0)
        plain = [i for i in sqls[row["sql_id"]].split(" from ")[0][7:].split(", ") if i != "*"]
        own = {e["target"] for e in row["edges"] if e["edge_type"] == "column_lineage"}
        assert own or told.get(row["sql_id"]) or not plain


def test_check_graph_raises(spark):
    nodes = spark.createDataFrame([(1, "a")], "sql_id long, id string")
    edges = spark.createDataFrame([(1, "e", "a", "gone")], "sql_id long, id string, source string, target string")
    with pytest.raises(ValueError, match="missing end"):
        check_graph(nodes, edges)
