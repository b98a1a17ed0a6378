"""The statement parser and its normalised text."""

import pytest

from strandline.functions.sql_parser import parse_facts


def items(sql):
    facts, error = parse_facts(sql)
    assert error is None, error
    return [(i["name"], i["expression"], i["source_type"]) for i in facts.items]


def tables(sql):
    facts, error = parse_facts(sql)
    assert error is None, error
    return [(t["full_name"], t["alias"], t["scope_name"], t["is_top_level"]) for t in facts.tables]


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("select a from t", [("a", "a", "unknown")]),
        ("select a as aa from t", [("aa", "a", "expression")]),
        ("select count(*) as cnt from t", [("cnt", "COUNT(*)", "expression")]),
        ("select a, b, c as cc from t", [("a", "a", "unknown"), ("b", "b", "unknown"), ("cc", "c", "expression")]),
        ("select u.x from t u", [("u.x", "u.x", "unknown")]),
        ("select *, o.* from t o", [("*", "*", "expression"), ("o.*", "o.*", "unknown")]),
        ("SELECT Sum ( distinct x )  total FROM t", [("total", "SUM(DISTINCT x)", "expression")]),
        ("select case when a>1 then 'x' else b end z from t", [("z", "CASE WHEN a > 1 THEN 'x' ELSE b END", "expression")]),
        ("select cast(a as decimal(18,2)) from t", [("CAST(a AS DECIMAL(18, 2))",) * 2 + ("expression",)]),
        ("select a is not null n, b not in (1, 2) m from t", [("n", "NOT a IS NULL", "expression"), ("m", "NOT b IN (1, 2)", "expression")]),
        ("select 1", [("1", "1", "expression")]),
        ("select sum(a) over (partition by b order by c desc) s from t", [("s", "SUM(a) OVER (PARTITION BY b ORDER BY c DESC)", "expression")]),
        ("select a != b x, m['k'] y, -a z from t", [("x", "a <> b", "expression"), ("y", "m['k']", "expression"), ("z", "-a", "expression")]),
        ("from t select a", [("a", "a", "unknown")]),
        ("select `a b` from t -- done\n;", [("`a b`", "`a b`", "unknown")]),
    ],
)
def test_output_fields(sql, expected):
    assert items(sql) == expected


@pytest.mark.parametrize("sql", ["", "  ", None, ";", "select from", "select a from t where", "select a b c from t", "select a,, b from t", "select (a from t", "drop table t", "select a from t; select b from u", "select a from t group", "with a as select 1", "(" * 50_000])
def test_rejected(sql):
    facts, error = parse_facts(sql)
    assert facts is None
    assert error.startswith("SQL parse error:")
    assert parse_facts(sql, "doris")[1].startswith("SQL parse error (doris):")


def test_deep_nesting():
    deep = "(" * 3000 + "a" + ")" * 3000
    assert parse_facts(f"select {deep} as x from t")[0].items[0]["name"] == "x"
    assert parse_facts("select a from " + "(select a from " * 500 + "t" + ") q" * 500)[0].has_subquery


def test_other_dialects():
    assert tables("select a.x from t a straight_join u b on a.k = b.k") == [("t", "a", "", True), ("u", "b", "", True)]
    assert items("select doc->>'$.k' as k from t") == [("k", "doc ->> '$.k'", "expression")]


def test_tables_and_scopes():
    sql = "with a as (select x from s.t join u on 1=1), b as (select y from a) select * from b left join db.c k using (id) where exists (select 1 from z)"
    assert tables(sql) == [("s.t", "t", "a", False), ("u", "u", "a", False), ("a", "a", "b", False), ("b", "b", "", True), ("db.c", "k", "", True), ("z", "z", "", False)]


def test_subquery_flags():
    flag = lambda sql: parse_facts(sql)[0].has_subquery
    assert flag("select a from (select 1) x") and flag("select (select 1) a from t") and flag("select a from t where b in (select 1 from u)")
    assert not flag("select a from t where exists (select 1 from u)") and not flag("select (a) from t where b in (1)")


def test_set_operations_have_no_top_level_table():
    assert tables("select a from t union all select b from u") == [("t", "t", "", False), ("u", "u", "", False)]


def test_constructs_are_accepted():
    for sql in (
        "select /*+ broadcast(t) */ a from t", "select a from t lateral view outer explode(x) e as v", "select a from t tablesample (10 percent) s", "select * from range(10) r",
        "select transform(xs, (x, i) -> x + i) from t", "select a from t cross join u, v natural join w", "select extract(year from d), interval '1' day, date '2020-01-01' from t",
        "select a from t group by grouping sets ((a), ())", "select count(1) filter (where a > 1) c from t having c > 1 order by c nulls last limit 5 offset 2", "values (1, 2), (3, 4)",
        "select x::array<int>, named_struct('a', 1).a from t", "select a from t where b between 1 and 2 and c like '%x' escape '!' or not d <=> null", "with recursive r(n) as (select 1 union all select n + 1 from r) select n from r",
    ):
        assert parse_facts(sql)[1] is None, sql


@pytest.mark.parametrize(
    "sql",
    ["select " + "+".join(["a"] * 50_000) + " from t", "select a from t where " + " and ".join(["b = 1"] * 20_000), "select " + ", ".join(["a"] * 20_000) + " from t", "select a from t where x in (" + ", ".join(["1"] * 50_000) + ")", "select '" + "x" * 500_000 + "' from t"],
)
def test_long_statements(sql):
    assert parse_facts(sql)[1] is None
