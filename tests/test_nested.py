import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.operators import nested

SCHEMA = "report_id long, json_ld struct<data: array<struct<content: string, index: int>>>, label string"


@pytest.mark.parametrize("bad", ["", "{", "NaN", '{"a":NaN}', "[1,]", "{} x", None])
def test_invalid(bad):
    with pytest.raises(ValueError):
        nested.parse(bad)


@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12))
@settings(max_examples=80, deadline=None)
def test_deep_parser_agrees(v):
    text = json.dumps(v)
    assert nested._parse_deep(text) == json.loads(text)


def test_objects(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    rows = [
        (1, ([('<!-- c -->﻿ {"a":[{"b":{}},[{}]],"k/x":{"y":null}}', 1), ("not json", 2), ('"s"', 3)],), "x"), (1, ([('<!-- c -->﻿ {"a":[{"b":{}},[{}]],"k/x":{"y":null}}', 1), ("not json", 2), ('"s"', 3)],), "x"),
        (2, None, None), (3, (None,), None), (4, ([None, (None, 1), ("[[{}]]", None)],), None), (5, ([(deep, 1)],), None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = [tuple(r) for r in nested.objects_table(df).filter("report_id < 5").collect()]
    assert sorted(out, key=str) == sorted([(1, 1, "$", ""), (1, 1, "$/a/0", "$"), (1, 1, "$/a/0/b", "$/a/0"), (1, 1, "$/a/1/0", "$"), (1, 1, "$/k/x", "$"), (4, None, "$/0/0", "")], key=str)
    assert nested.objects_table(df).filter("report_id = 5").count() == 3000
    assert nested.objects_table(spark.createDataFrame([], SCHEMA)).count() == 0


def _all_leaves(v):
    if isinstance(v, dict | list):
        return [x for y in (v.values() if isinstance(v, dict) else v) for x in _all_leaves(y)]
    return [v]


@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=14))
@settings(max_examples=120, deadline=None)
def test_every_leaf_comes_back(v):
    found = [m for *_, members in nested.objects(v) for m in members]
    told = lambda m: m["value"] if m["kind"] == "string" else json.loads(m["value"]) if m["value"] else None
    assert sorted(map(repr, map(told, found))) == sorted(map(repr, _all_leaves(v)))
    assert len({m["leaf"] for m in found}) == len(found)


def test_members(spark):
    text = '{"sameAs": ["a", "b"], "x": {"y": [1, [true]]}, "n": null, "sameAs/0": "c"}'
    df = spark.createDataFrame([(1, ([(text, 1), ("[5]", 2), ("9" * 5000, 3)],), "x")], SCHEMA)
    out = {(r.script_index, r.leaf): (r.label, r.key, r.position, r.kind, r.value) for r in nested.members_table(df).collect()}
    assert out == {
        (1, "$.k0.e0"): ("$", "sameAs", "0", "string", "a"), (1, "$.k0.e1"): ("$", "sameAs", "1", "string", "b"), (1, "$.k1.k0.e0"): ("$.k1", "y", "0", "number", "1"),
        (1, "$.k1.k0.e1.e0"): ("$.k1", "y", "1.0", "boolean", "true"), (1, "$.k2"): ("$", "n", "", "null", None), (1, "$.k3"): ("$", "sameAs/0", "", "string", "c"),
        (2, "$.e0"): ("", None, "0", "number", "5"), (3, "$"): ("", None, "", "number", "9" * 5000),
    }
    root = nested.table_of(df, "$").first().members
    assert root["sameAs/1"].value == "b" and root["n"].kind == "null" and root["sameAs/0"].value == "c"
    assert nested.objects_table(df).count() == 2
