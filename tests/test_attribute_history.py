"""Histories against plain Python, with an entity that spans all slices."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.attribute_history import attribute_history

ROWS = "uid long, entity long, at int, got int, kind string, v string, w string"


def plain(rows):
    out = set()
    for entity in {r[1] for r in rows}:
        last = {}
        for r in rows:
            if r[1] == entity and r[2] is not None and (r[2] not in last or last[r[2]][0] < ((r[3] is not None, r[3] or 0), r[0])):
                last[r[2]] = (((r[3] is not None, r[3] or 0), r[0]), None if r[4] == "removed" else (r[5] and r[5].lower(), r[6] or ""))
        state, since = None, None
        for at in sorted(last):
            new = last[at][1]
            if new != state:
                if state is not None:
                    out.add((entity, *state, since, at))
                state, since = new, at
        if state is not None:
            out.add((entity, *state, since, None))
    return out


def found(spark, rows, rows_per_slice=40):
    df = spark.createDataFrame(rows, ROWS)
    got = attribute_history(df, "entity", "at", {"v": F.lower("v"), "w": F.coalesce("w", F.lit(""))}, F.col("kind") == "removed", ["got", "uid"], rows_per_slice=rows_per_slice).collect()
    assert len(set(got)) == len(got)
    return {(r["entity"], r["v"], r["w"], r["valid_from"], r["valid_to"]) for r in got}


def random_rows(seed, n, hot):
    draw = random.Random(seed)
    return [
        (k, draw.choice((1, 1, 1) if hot else (1, 2, 3, None)), draw.choice((None, *range(30 if not hot else 500))), draw.choice((None, 1, 2)),
         draw.choice((None, "changed", "added", "removed", "conflict")), draw.choice(("a", "A", "b", None)), draw.choice(("", None, "x")))
        for k in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_plain_python(spark, seed):
    rows = random_rows(seed, 200, hot=False)
    assert found(spark, rows + rows[:20]) == plain(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_one_entity_over_all_slices(spark, seed):
    rows = random_rows(seed, 900, hot=True)
    assert found(spark, rows) == plain(rows)


def test_constant_state_over_all_slices_is_one_period(spark):
    rows = [(k, 7, k, 1, "changed", "a", None) for k in range(400)]
    assert found(spark, rows) == {(7, "a", "", 0, None)}


def test_long_arrays_are_folded_in_pieces(spark):
    """One slice of more states than a piece holds; equal states meet at the border of pieces."""
    rows = [(k, 7, k, 1, "changed", "ab"[(k // 5) % 2], None) for k in range(700)]
    assert found(spark, rows, 100_000) == plain(rows)


def test_empty(spark):
    assert found(spark, []) == set()
