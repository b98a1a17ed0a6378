"""Flattening of bodies: links, odd shapes, damaged text, and a round trip."""

import json

from strandline.sources.nested_json import SHAPE, flatten_payloads, named_columns

SCHEMA = "payload_id long, source_name string, body string"
GOOD = {"metadata_version": "v1", "default_schema": "dw", "tables": [{"table_name": "t", "columns": [{"name": "a"}, None, {"comment": "no name"}, {"name": "b", "tags": [1]}]}, None, {"name": "u", "table_name": None}, {"columns": {"name": "c"}}]}
EXPECTED = {(0, "t", 0, "a"), (0, "t", 3, "b"), (2, "u", -1, ""), (3, "", 0, "c")}


def found(spark, bodies):
    rows = [(k, "s", b) for k, b in bodies]
    got = named_columns(flatten_payloads(spark.createDataFrame(rows, SCHEMA))).drop("body_id").collect()
    return sorted(tuple(r) for r in got)


def test_all_wrappings(spark):
    text = json.dumps(GOOD)
    bodies = [(1, text), (2, "﻿ \n" + text + "\r\n "), (3, json.dumps({"mode": "commit", "payload": GOOD})), (4, json.dumps({"mode": "preview", "payload": " " + text}))]
    assert found(spark, bodies) == sorted((k, *e) for k in (1, 2, 3, 4) for e in EXPECTED)


def test_damaged_bodies_yield_nothing(spark):
    text = json.dumps(GOOD)
    bad = [None, "", "  ", text[:-1], text + "}", "[]", "null", '"x"', json.dumps({"payload": text[:-3]}), json.dumps({"payload": None}), json.dumps({"payload": "[1]"}), '{"tables": NaN}', "[" * 100_000]
    assert found(spark, list(enumerate(bad))) == []


def test_odd_but_whole(spark):
    assert found(spark, [(1, '{"tables": {"name": "one", "columns": [{"name": "x"}]}}'), (2, "{}"), (3, '{"tables": "no"}'), (4, '{"tables": [7, {"columns": [7, "x"]}]}')]) == [(1, 0, "one", 0, "x"), (4, 1, "", -1, "")]


def test_repeats_once_and_long_text(spark):
    body = json.dumps({"tables": [{"name": "t" * 50_000, "columns": [{"name": f"c{i}"} for i in range(3000)]}]})
    assert len(found(spark, [(1, body), (1, body)])) == 3000


def test_empty_table_and_extra_columns(spark):
    assert found(spark, []) == []
    rows = spark.createDataFrame([(1, "s", json.dumps(GOOD), "x", "y")], SCHEMA + ", tag string, pos string")
    flat = flatten_payloads(rows)
    assert flat["payload"].collect()[0]["default_schema"] == "dw"
    assert flat["column"].where("name = 'b'").count() == 1


def test_bodies_of_one_id_do_not_mix(spark):
    bodies = [json.dumps({"tables": [{"table_name": t, "columns": [{"name": c}]}]}) for t, c in (("A", "x"), ("B", "y"))]
    assert found(spark, [(1, bodies[0]), (1, bodies[1]), (1, bodies[0])]) == [(1, 0, "A", 0, "x"), (1, 0, "B", 0, "y")]


def test_deeper_arrays_by_path(spark):
    """Declared ways at any depth are tables; other arrays of objects are told under ``other``."""
    body = {"tables": [{"name": "t", "columns": [{"name": "c", "tags": [{"k": "a"}, 3, {"k": "b", "w": [{"z": 1}]}]}], "owners": [{"who": "x"}]}], "n": {"a": [1]}}
    shape = SHAPE | {"tag": (("tables", "columns", "tags"), "k string")}
    flat = flatten_payloads(spark.createDataFrame([(1, "s", json.dumps(body))], SCHEMA), shape=shape)
    assert sorted(tuple(r) for r in flat["tag"].drop("body_id").collect()) == [(1, 0, 0, 0, "a"), (1, 0, 0, 2, "b")]
    assert flat["tag"].columns[2:5] == ["table_pos", "column_pos", "tag_pos"]
    others = sorted((r["path"], r["pos"], r["payload"]) for r in flat["other"].collect())
    assert others == [("tables.columns.tags.w", [0, 0, 2, 0], '{"z": "1"}'), ("tables.owners", [0, 0], '{"who": "x"}')]
