"""Flattening of nested records: edge cases and keys."""

import json

from chandas.operators import nested

MAPS = ("a.freq",)


def frame(spark, rows):
    return spark.createDataFrame([(i, p, "clash") for i, p in rows], "record_id long, payload string, ordinals string")


def test_levels_and_bare_objects(spark):
    rows = [
        (1, json.dumps({"w": [{"t": "x", "n": [{"v": 1}, {"v": "2"}]}, {"t": None, "n": {"v": 3}}, None], "a": {"freq": {"k": 1, "": "2"}}})),
        (2, "﻿ " + json.dumps({"w": {"t": "y", "n": []}, "a": None, "new": [1, 2]}) + "\n"),
        (3, '{"w": [{"t"'), (4, None), (5, ""), (6, "[]"), (7, "{}"), (8, json.dumps({"w": [], "a": {}})),
        (9, '{"w": [NaN]}'), (10, '{"w": [{"t": -Infinity}]}'),
    ]
    out = nested.flatten(frame(spark, rows), MAPS)
    assert set(out) == {"", "w", "w.n", "a.freq", "new"}
    assert {r.record_id for r in out[""].collect()} == {1, 2, 7, 8}
    assert sorted((r.record_id, r.ordinals, r.t) for r in out["w"].collect()) == [(1, "0", "x"), (1, "1", None), (2, "0", "y")]
    n = {(r.record_id, r.ordinals): (r.v, r.parent_key) for r in out["w.n"].collect()}
    assert {k: v[0] for k, v in n.items()} == {(1, "0.0"): 1, (1, "0.1"): 2, (1, "1.0"): 3}
    parents = {(r.record_id, r.row_key) for r in out["w"].collect()}
    assert all((k[0], v[1]) in parents for k, v in n.items())
    assert sorted((r.ordinals, r.value) for r in out["a.freq"].collect()) == [("", 2), ("k", 1)]
    assert sorted(r.value for r in out["new"].collect()) == [1, 2]


def test_empty_and_long(spark):
    assert set(nested.flatten(frame(spark, []))) == {""}
    assert nested.flatten(frame(spark, []))[""].count() == 0
    big = json.dumps({"w": [{"t": "z" * 10} for _ in range(20_000)]})
    assert nested.flatten(frame(spark, [(1, big)]))["w"].count() == 20_000


def test_repeats_stay(spark):
    r = frame(spark, [(1, '{"w": [{}]}'), (1, '{"w": [{}]}')])
    schema = nested.Schema(nested.infer(r))
    assert nested.explode_all(r, schema, ["w"], keys_only=True).count() == 2


def test_arrays_in_arrays(spark):
    rows = [
        (1, json.dumps({"a": [[1, 2], [], [3, None, [4]]], "g": [[{"x": 5, "t": [{"y": "u"}]}], [{"x": 6}, {"x": 7}]]})),
        (2, json.dumps({"a": [8, [9]], "g": [{"x": 10, "t": {"y": "v"}}]})), (3, json.dumps({"g": {"x": 11}})),
    ]
    out = nested.flatten(frame(spark, rows))
    assert set(out) == {"", "a", "a[]", "a[][]", "g", "g[]", "g[].t"}
    got = lambda node, c: sorted((r.record_id, r.ordinals, r.ordinal, r[c]) for r in out[node].collect() if r[c] is not None)
    assert got("a[]", "value") == [(1, "0.0", 0, 1), (1, "0.1", 1, 2), (1, "2.0", 0, 3), (2, "1.0", 0, 9)]
    assert got("a[][]", "value") == [(1, "2.2.0", 0, 4)] and got("a", "value") == [(2, "0", 0, 8)] and out["a"].count() == 5
    assert got("g[]", "x") == [(1, "0.0", 0, 5), (1, "1.0", 0, 6), (1, "1.1", 1, 7), (2, "0.0", 0, 10), (3, "0.0", 0, 11)]
    assert got("g[].t", "y") == [(1, "0.0.0", 0, "u"), (2, "0.0.0", 0, "v")]
    for child, parent in (("a[]", "a"), ("a[][]", "a[]"), ("g[]", "g"), ("g[].t", "g[]")):
        keys = [(r.record_id, r.row_key) for r in out[parent].collect()]
        assert len(keys) == len(set(keys)) and {(r.record_id, r.parent_key) for r in out[child].collect()} <= set(keys)


def test_keys_and_types(spark):
    rows = [(1, json.dumps({"x": {"i": [{"n": "7", "d": "5", "t": "5"}]}, "y": {"i": [{"n": 8, "d": "6", "t": "u"}]}}))]
    out = nested.flatten(frame(spark, rows))
    x, y = out["x.i"].first(), out["y.i"].first()
    assert (x.row_key, y.row_key, x.parent_key) == ("/x.i.0", "/y.i.0", "")
    # digits alone, or beside other text, are text; beside numbers they are numbers
    rows = [(i, json.dumps({"a": [{"n": n, "d": "5", "t": t}]})) for i, (n, t) in enumerate([("7", "5"), (8, "u")])]
    a = nested.flatten(frame(spark, rows), nodes=["a"])["a"]
    assert sorted((r.n, r.d, r.t) for r in a.collect()) == [(7, "5", "5"), (8, "5", "u")]
