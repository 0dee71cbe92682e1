"""Differences of several results at once, and of deep ones."""

import json

from strataloom.operators import manage


def deep(value, levels=10):
    for k in reversed(range(levels)):
        value = {f"l{k}": value, "brackets": '[{"\\'} if k % 2 else {f"l{k}": [{"key": "x", "v": value}]}
    return json.dumps(value)


def test_each_result_is_compared_with_its_own(spark):
    frame = lambda rows: spark.createDataFrame(rows, "result_id long, result string")
    before = frame([(1, '{"a": 1, "b": {"c": 1}}'), (2, '{"a": 2, "b": 1}'), (3, '{"a": 3}'), (5, deep(1, 6)), (6, '{"a": {"b": 1}}')])
    after = frame([(1, '{"a": 2}'), (2, '{"a": 2, "b": {"c": 1}}'), (4, '{"a": {"b": 1}}'), (5, deep(2, 6)), (6, '[1]')])
    path = "l0.x.v.l1.l2.x.v.l3.l4.x.v.l5"
    assert {tuple(r) for r in manage.difference(before, after).collect()} == {
        (1, "a", "MODIFIED", "1", "2"), (1, "b", "REMOVED", None, None), (2, "b", "MODIFIED", "1", None), (3, "$", "REMOVED", None, None), (4, "$", "ADDED", None, None),
        (5, path, "MODIFIED", "1", "2"), (6, "$", "MODIFIED", None, "[1]"),
    }


def test_ten_levels(spark):
    nest = lambda x: json.dumps({"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": {"j": x}}}}}}}}}})
    frame = lambda x: spark.createDataFrame([(1, nest(x))], "result_id long, result string")
    assert [tuple(r) for r in manage.difference(frame(1), frame(2)).collect()] == [(1, "a.b.c.d.e.f.g.h.i.j", "MODIFIED", "1", "2")]
