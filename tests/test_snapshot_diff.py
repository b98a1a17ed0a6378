"""Snapshot differences against plain Python over random histories, in one batch and in two."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.snapshot_diff import SnapshotIndex, SnapshotSpec, order_snapshots
from strandline.plans.versions import Versions
from strandline.workspace import scratch_path

ROWS = "import_id long, k string, v string, n int, loaded_at int, id long"
IMPORTS = "import_id long, source string, at timestamp"


def spec():
    return SnapshotSpec("source", "import_id", ("k",), {"v": F.lower("v"), "n": F.col("n")}, ("loaded_at", "id"))


def history(seed):
    draw = random.Random(seed)
    imports, rows, next_id = [], [], 0
    for s in range(3):
        for i in range(5):
            sid = 100 - s * 10 - i * (1 if s else -1)
            imports.append((sid, None if s == 2 else f"s{s}", dt.datetime(2025, 1, 1 + i)))
            for k in "abcdef":
                for _ in range(draw.choice((0, 1, 1, 2))):
                    next_id += 1
                    rows.append((sid, None if k == "f" else k, draw.choice(("x", "X", "y", None)), draw.choice((1, None)), draw.choice((1, 2, None)), next_id))
    return imports + imports[:2], rows + rows[:3]


def expected(imports, rows):
    latest = {}
    for r in rows:
        if r[0] not in {i[0] for i in imports}:
            continue
        at = ((r[4] is not None, r[4] or 0), r[5])
        if (r[0], r[1]) not in latest or latest[r[0], r[1]][0] < at:
            latest[r[0], r[1]] = (at, (r[2] and r[2].lower(), r[3]))
    out = set()
    for source in {i[1] for i in imports}:
        line = [i[0] for i in sorted({i for i in imports if i[1] == source}, key=lambda i: (i[2], i[0]))]
        for a, b in zip(line, line[1:]):
            old, new = ({k: v for (s, k), (_, v) in latest.items() if s == x} for x in (a, b))
            for k in old.keys() | new.keys():
                if k not in old or k not in new or old[k] != new[k]:
                    out.add((b, k, "added" if k not in old else "removed" if k not in new else "changed"))
    return out


def run(spark, batches, imports, slices=1):
    index, found = SnapshotIndex(spark, scratch_path(spark, "index")), set()
    known, everything = [], []
    for ids, rows in batches:
        known += [i for i in imports if i[0] in ids]
        everything += rows
        order = order_snapshots(spark.createDataFrame(known, IMPORTS), "import_id", "source", "at")
        changes = index.apply(spark.createDataFrame(rows, ROWS), order, spec(), spark.createDataFrame(everything, ROWS), slices)
        got = [(r["import_id"], r["k"], r["change_type"]) for r in changes.collect()]
        assert len(got) == len(set(got))
        found |= set(got)
    return found


@pytest.mark.parametrize(("seed", "slices"), [(1, 1), (2, 3)])
def test_matches_plain_python(spark, seed, slices):
    imports, rows = history(seed)
    assert run(spark, [({i[0] for i in imports}, rows)], imports, slices) == expected(imports, rows)


def test_two_batches_equal_one(spark):
    imports, rows = history(3)
    early = {i[0] for i in imports if i[2].day <= 3}
    late = {i[0] for i in imports} - early
    batches = [(early, [r for r in rows if r[0] in early]), (late, [r for r in rows if r[0] in late])]
    assert run(spark, batches, imports) == expected(imports, rows)


def test_empty_and_unknown(spark):
    imports = [(1, "s", dt.datetime(2025, 1, 1)), (2, "s", dt.datetime(2025, 1, 2))]
    assert run(spark, [({1, 2}, [])], imports) == set()
    rows = [(1, "a", "x", 1, 1, 1), (9, "b", "x", 1, 1, 2)]
    assert run(spark, [({1, 2}, rows)], imports) == {(2, "a", "removed")}  # the second snapshot is empty


def test_values_of_changes(spark):
    imports = [(1, "s", dt.datetime(2025, 1, 1)), (2, "s", dt.datetime(2025, 1, 2))]
    order = order_snapshots(spark.createDataFrame(imports, IMPORTS), "import_id", "source", "at")
    rows = spark.createDataFrame([(1, "a", "x", 1, 1, 1), (2, "a", "y", 1, 1, 2), (2, "b", "z", 1, 1, 3)], ROWS)
    got = SnapshotIndex(spark, scratch_path(spark, "index")).apply(rows, order, spec()).orderBy("k").collect()
    assert [(r["old"] and r["old"]["v"], r["new"]["v"]) for r in got] == [("x", "y"), (None, "z")]


def two_snapshots(spark):
    imports = [(1, "s", dt.datetime(2025, 1, 1)), (2, "s", dt.datetime(2025, 1, 2)), (3, "t", dt.datetime(2025, 1, 2))]
    order = lambda n: order_snapshots(spark.createDataFrame([i for i in imports if i[0] in n], IMPORTS), "import_id", "source", "at")
    rows = lambda *r: spark.createDataFrame([(s, k, v, 1, 1, n) for n, (s, k, v) in enumerate(r)], ROWS)
    return order, rows


def kinds(changes):
    return sorted((r["import_id"], r["k"], r["change_type"]) for r in changes.collect())


def test_untouched_sources_stay_and_nothing_piles_up(spark):
    """A later batch rewrites its own sources only; dead folders and tables go."""
    order, rows = two_snapshots(spark)
    root = scratch_path(spark, "index")
    tables = len(spark.catalog.listTables())
    assert kinds(SnapshotIndex(spark, root).apply(rows((1, "a", "x"), (3, "b", "x")), order({1, 3}), spec())) == []
    parts = lambda: {n for n in os.listdir(f"{root}/index") if n.startswith("gen=")}
    first = parts()
    new = rows((2, "a", "y"))
    assert kinds(SnapshotIndex(spark, root).apply(new, order({1, 2, 3}), spec(), rows((1, "a", "x"), (2, "a", "y")))) == [(2, "a", "changed")]
    second = parts()
    assert first < second and len(second) == 2  # source t still lies in the first
    assert kinds(SnapshotIndex(spark, root).apply(new, order({1, 2, 3}), spec())) == []  # told already
    assert len(spark.catalog.listTables()) == tables and len([n for n in os.listdir(f"{root}/sources") if n.startswith("s-")]) == 1


def test_a_batch_that_dies_changes_nothing(spark, monkeypatch):
    order, rows = two_snapshots(spark)
    root = scratch_path(spark, "index")
    SnapshotIndex(spark, root).apply(rows((1, "a", "x")), order({1}), spec())
    for method in ("_fetch", "_probe"):
        with monkeypatch.context() as patch:
            patch.setattr(SnapshotIndex, method, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                SnapshotIndex(spark, root).apply(rows((2, "a", "y")), order({1, 2}), spec())
    with monkeypatch.context() as patch:
        patch.setattr(Versions, "store", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            SnapshotIndex(spark, root).apply(rows((2, "a", "y")), order({1, 2}), spec())
    assert kinds(SnapshotIndex(spark, root).apply(rows((2, "a", "y")), order({1, 2}), spec(), rows((1, "a", "x"), (2, "a", "y")))) == [(2, "a", "changed")]


def test_late_snapshots_and_lost_states_are_refused(spark):
    order, rows = two_snapshots(spark)
    root = scratch_path(spark, "index")
    SnapshotIndex(spark, root).apply(rows((2, "a", "y")), order({2}), spec())
    with pytest.raises(ValueError, match="sorts before"):
        SnapshotIndex(spark, root).apply(rows((1, "a", "x")), order({1, 2}), spec())
    for name in os.listdir(root):
        if name.startswith("state-"):
            os.remove(f"{root}/{name}")
    with pytest.raises(RuntimeError, match="no complete state"):
        SnapshotIndex(spark, root).apply(rows((2, "a", "y")), order({2}), spec())


def test_a_damaged_state_falls_back(spark):
    versions = Versions(spark, scratch_path(spark, "states"))
    for n in range(3):
        versions.store({"n": n})
    newest = max(os.listdir(versions.root))
    with open(f"{versions.root}/{newest}", "w") as out:
        out.write('{"n": ')
    for name in os.listdir(versions.root):
        if name.endswith(".crc"):
            os.remove(f"{versions.root}/{name}")
    assert versions.load() == {"n": 1}
