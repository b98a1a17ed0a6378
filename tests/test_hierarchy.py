"""Hierarchies against plain Python on random forests, chains, loops and graphs with several parents."""

import random

import pytest

from strandline.operators.hierarchy import descendants, hierarchies

EDGES = "t long, p string, c string, extra string"


def plain(rows):
    """Definition: tree nodes have only tree parents; the smallest parent path is taken."""
    out, edges = {}, {(t, p, c) for t, p, c, _ in rows if t is not None and p is not None and c is not None}
    nodes = {(t, n) for t, p, c, _ in rows for n in (p, c) if n is not None and t is not None}
    parents = {n: {p for t, p, c in edges if (t, c) == n} for n in nodes}
    path, moved = {}, True
    while moved:
        moved = False
        for t, n in nodes:
            if (t, n) not in path and all((t, p) in path for p in parents[t, n]):
                path[t, n] = (min(path[t, p] for p in parents[t, n]) if parents[t, n] else []) + [n]
                moved = True
    for t, n in nodes:
        if (t, n) in path:
            seen, todo = set(), [n]
            while todo:
                new = {c for u, p, c in edges if u == t and p == todo[-1] and (t, c) in path} - seen
                todo = [*new, *todo[:-1]]
                seen |= new
            below = len(seen)
            out[t, n] = ("tree", path[t, n][0], len(path[t, n]) - 1, " > ".join(path[t, n]), below)
        else:
            seen, todo = set(), [n]
            while todo:
                for u, p, c in edges:
                    if u == t and p == todo[-1] and c not in seen:
                        seen.add(c)
                        todo.insert(0, c)
                todo.pop()
            out[t, n] = ("cycle" if n in seen else "below", "", -1, "", -1)
    return out


def found(spark, rows):
    got = hierarchies(spark.createDataFrame(rows, EDGES), "t", "p", "c").collect()
    assert len({(r["tree"], r["node"]) for r in got}) == len(got)
    return {(r["tree"], r["node"]): (r["state"], r["root"], r["depth"], r["path"], r["n_descendants"]) for r in got}


def forest(seed):
    draw, rows = random.Random(seed), []
    for t in (1, 2):
        for k in range(1, 14):
            rows.append((t, f"n{draw.randrange(k)}", f"n{k}", None))
    rows += [(1, "x", "y", "e"), (1, "y", "z", "e"), (1, "z", "x", "e"), (1, "z", "tail", None), (1, "tail", "tail2", None), (2, "self", "self", None)]
    return rows + rows[:4] + [(1, None, "alone", None), (1, None, "n3", None), (2, "n1", None, None), (None, "a", "b", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_forests_with_loops(spark, seed):
    rows = forest(seed)
    assert found(spark, rows) == plain(rows)


def test_deep_chain_crosses_jobs(spark):
    rows = [(1, f"n{k:03}", f"n{k + 1:03}", None) for k in range(23)]
    assert found(spark, rows) == plain(rows)


def test_several_parents(spark):
    rows = [(1, a[0], a[1], None) for a in ("ra", "rb", "ac", "bc", "cd", "rd", "xy", "yx", "yk", "kz", "dz", "zw", "wv", "vw", "vq")]
    assert found(spark, rows) == plain(rows)


def test_diamond_counts_every_ancestor(spark):
    """Both sides of a diamond have the two nodes below it."""
    rows = [(1, a, b, None) for a, b in ("ra", "rb", "ac", "bc", "cd")] + [(2, "x", "y", None)]
    assert found(spark, rows) == plain(rows)
    got = descendants(spark.createDataFrame(rows, EDGES), "t", "p", "c").collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, a, b) for a, bs in {"r": "abcd", "a": "cd", "b": "cd", "c": "d"}.items() for b in bs] + [(2, "x", "y")])


@pytest.mark.parametrize("seed", [3, 4])
def test_tangles(spark, seed):
    """Several loops that feed each other, bridges between them, self-loops, several parents."""
    draw = random.Random(seed)
    rows = [(t, f"n{draw.randrange(14)}", f"n{draw.randrange(14)}", None) for t in (1, 2, 3) for _ in range(17)]
    assert found(spark, rows) == plain(rows)


def test_a_parent_with_very_many_children(spark, monkeypatch):
    """Children of a hot parent are spread over salts."""
    monkeypatch.setattr("strandline.operators.hierarchy.FAN", 5)
    rows = [(1, "r", "hot", None)] + [(1, "hot", f"c{k:02}", None) for k in range(40)] + [(1, f"c{k:02}", f"d{k:02}", None) for k in range(0, 40, 3)]
    rows += [(1, "d00", f"e{k}", None) for k in range(12)] + [(2, "hot", "c00", None)]
    assert found(spark, rows) == plain(rows)


def test_empty(spark):
    assert found(spark, []) == {}
