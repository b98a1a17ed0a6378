"""Canonical statements and the ledger."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from strandline.llm.canonical_sql import canonical
from strandline.llm.duplicate_ledger import DuplicateLedger, with_keys
from strandline.plans.versions import Versions
from strandline.workspace import materialise, scratch_path

BASE = "select o.a as x, count(b) as n from db.t o where o.c = 'A  b' and o.d > 1.50 order by o.a"
SAME = [
    "SELECT O.A AS X,\r\n\tCOUNT( B ) AS N FROM DB.T O WHERE O.C='A  b' AND O.D>1.50 ORDER BY O.A;;  ",
    "select count(b) as n, o.a as x from db.t o where (o.c = 'A  b' and o.d > 1.50) order by o.a",
    'select "o"."a" as `x`, count(`b`) as n from `db`.`t` "o" where((o.c = \'A  b\' and o.d>1.50)) order by o.a ;',
    "select count (b) as n , o . a as x from `db.t` o\nwhere o.c = 'A  b' and o.d > 1.50 order by o.a",
]
OTHER = [
    "select o.a as x, count(b) as n from db.t o where o.c = 'a  b' and o.d > 1.50 order by o.a",
    "select o.a as x, count(b) as n from db.t o where o.c = 'A b' and o.d > 1.50 order by o.a",
    "select o.a as x, count(b) as n from db.t o where o.c = 'A  b' and o.d > 1.5 order by o.a",
    "select o.a as x, count(b) as n from db.t o where o.c = 'A  b' and o.d >= 1.50 order by o.a",
    "select o.a as x, count(b) as n from db.t o where o.d > 1.50 and o.c = 'A  b' order by o.a",
    "select o.a as x, count(b) as n from db.t o where (o.c = 'A  b') and o.d > 1.50 order by o.a",
    "select distinct o.a as x, count(b) as n from db.t o where o.c = 'A  b' and o.d > 1.50 order by o.a",
    "select b.a as x, count(o) as n from db.t o where o.c = 'A  b' and o.d > 1.50 order by o.a",
]


def test_spelling_does_not_count():
    assert {canonical(q) for q in SAME} == {canonical(BASE)}


def test_all_else_counts():
    forms = [canonical(q) for q in [BASE, *OTHER]]
    assert len(set(forms)) == len(forms)


def test_nested_lists_and_conditions():
    a = "with q as (select b, a from t where (x = 1)) select (select max(d), c from u) as m, f(2, 1) from q where (y in (2, 1))"
    b = "WITH q AS (SELECT a, b FROM t WHERE x = 1) SELECT f(2, 1), (select c, max(d) from u) AS m FROM q WHERE y IN (2, 1)"
    assert canonical(a) == canonical(b)
    assert canonical("select f(1, 2) from t") != canonical("select f(2, 1) from t")
    assert canonical("select a from t where (a) = (b)") != canonical("select a from t where a = b")


@pytest.mark.parametrize("text", [None, "", " \n", ";", " ;;", "''", "1", "(((", "'select'"])
def test_no_words(text):
    assert canonical(text) is None


@pytest.mark.parametrize("text", ["select (a from t", "select a) from t", "select 'open", "select `open", "x" * 200_000, "(" * 50_000 + "a" + ")" * 50_000, "select " + ",".join("abc" * 20_000)])
def test_damaged_and_long(text):
    assert canonical(text)


@settings(max_examples=60, deadline=None)
@given(s.lists(s.sampled_from(["select", "a", "b", ",", "(", ")", "where", "'x y'", "=", ";", "from", "t", "`q`", ">"]), max_size=25), s.randoms())
def test_blanks_and_case_never_matter(tokens, draw):
    plain = " ".join(tokens)
    spaced = "".join(draw.choice([" ", "\n", " \t"]) + (t if t.startswith("'") else draw.choice([t.upper(), t])) for t in tokens)
    assert canonical(plain) == canonical(spaced)


def ledger_of(spark, batches):
    ledger = DuplicateLedger(spark, scratch_path(spark, "ledger"))
    rows = None
    for k, batch in enumerate(batches):
        keyed = with_keys(spark.createDataFrame(batch, "sql_id long, sql string, extra string"), "sql_id", "sql", with_text=True)
        ledger.merge(keyed, f"b{k}")
        ledger.merge(keyed, f"b{k}")  # told twice, counted once
        rows = keyed if rows is None else rows.unionByName(keyed)
    return ledger, rows


def test_ledger_counts_and_copies(spark):
    draw = random.Random(1)
    texts = {k: draw.choice([BASE, *SAME, *OTHER, "", ";", None, "select 1 from a"]) for k in range(1, 200)}
    rows = [(k, q, None) for k, q in texts.items()]
    groups = {}
    for k, q in texts.items():
        if canonical(q):
            groups.setdefault(canonical(q), []).append(k)
    want = {(min(g), k) for g in groups.values() for k in g if k != min(g)}
    for cut in ([rows + rows[:9]], [rows[100:], rows[:60], [], rows[60:100]]):
        ledger, keyed = ledger_of(spark, cut)
        got = [tuple(r) for r in ledger.further_copies(keyed).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        held = {(r["n"], r["first_id"], r["text"]) for r in ledger.records(keyed).collect()}
        assert held == {(len(g), min(g), texts[min(g)]) for g in groups.values()}


def test_empty_ledger(spark):
    ledger, keyed = ledger_of(spark, [[]])
    assert ledger.rows().count() == 0 and ledger.further_copies(keyed).count() == 0


def test_only_touched_buckets_are_written_again(spark):
    ledger = DuplicateLedger(spark, scratch_path(spark, "ledger"), buckets=8)
    keyed = lambda rows: with_keys(spark.createDataFrame(rows, "sql_id long, sql string"), "sql_id", "sql")
    ledger.merge(keyed([(k, f"select c{k} from t") for k in range(60)]), "first")
    before = ledger._state()["at"]
    ledger.merge(keyed([(100, "SELECT c7 FROM t;")]), "second")
    after = ledger._state()["at"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert {r["n"] for r in ledger.rows().where("first_id = 7").collect()} == {2} and ledger.rows().count() == 60


def test_the_merge_moves_only_the_batch(spark):
    """The plan joins bucket by bucket: one exchange, that of the batch's own aggregate."""
    ledger = DuplicateLedger(spark, scratch_path(spark, "ledger"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = materialise(with_keys(spark.createDataFrame([(k, f"select c{k} from t") for k in range(60)], "sql_id long, sql string"), "sql_id", "sql"), "keyed")
    ledger.merge(keyed, "first")
    state = ledger._state()
    table = ledger._attach(state, list(state["at"]))
    joined = keyed.groupBy("k1", "k2").count().join(spark.table(table), ["k1", "k2"], "full")
    plan = joined._jdf.queryExecution().sparkPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    spark.sql(f"DROP TABLE {table}")


def test_a_merge_that_dies_changes_nothing(spark, monkeypatch):
    ledger = DuplicateLedger(spark, scratch_path(spark, "ledger"))
    keyed = with_keys(spark.createDataFrame([(1, "select a from t")], "sql_id long, sql string"), "sql_id", "sql")
    ledger.merge(keyed, "first")
    more = with_keys(spark.createDataFrame([(2, "select A from t")], "sql_id long, sql string"), "sql_id", "sql")
    with monkeypatch.context() as patch:
        patch.setattr(Versions, "store", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ledger.merge(more, "second")
    assert [r["n"] for r in ledger.rows().collect()] == [1]
    ledger.merge(more, "second")
    assert [r["n"] for r in ledger.rows().collect()] == [2]
