"""Nested settings against a recursive merge."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import documents


def merge(base, over):
    """Key by key where both are objects."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def shown(doc):
    return json.dumps(doc, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.sampled_from(["", "x", "{", '"']) | st.lists(st.integers(0, 3), max_size=2), lambda v: st.dictionaries(st.sampled_from(["a", "b", "c.d", 'e"']), v, max_size=3), max_leaves=8)
DOCS = st.dictionaries(st.sampled_from(["a", "b", "c.d"]), VALUES, max_size=3)


@settings(deadline=None, max_examples=6)
@given(st.lists(st.lists(DOCS, min_size=1, max_size=4), min_size=6, max_size=6))
def test_merge_equals_recursion(spark, groups):
    rows = [(g, d, json.dumps(doc)) for g, docs in enumerate(groups) for d, doc in enumerate(docs)]
    df = spark.createDataFrame(rows, "g int, depth int, json string").select("g", "depth", F.parse_json("json").alias("doc"))
    found = {r.g: r.json for r in documents.rebuilt(documents.merged(documents.flatten(df), ["g"]), ["g"]).collect()}
    for g, docs in enumerate(groups):
        whole = {}
        for doc in docs:
            whole = merge(whole, doc)
        assert found.get(g, "{}") == shown(whole)


def test_settings_in_force(spark):
    docs = [(".", '{"a": {"x": 1, "y": [1]}, "b": "root"}'), ("p", '{"a": {"x": 2}}'), ("p/q", '{"a": 3}'), ("p/q/r", '{"a": {"z": null}}'), ("other", "[1]"), ("", None)]
    docs = spark.createDataFrame(docs, "dir string, json string").select("dir", F.parse_json("json").alias("doc"))
    targets = spark.createDataFrame([(d,) for d in (".", "p", "p/q", "p/q/r", "p/none", "pq", "p")], "dir string")
    found = {r.dir: json.loads(r.json) for r in documents.in_force(docs, targets).collect()}
    root = {"a": {"x": 1, "y": [1]}, "b": "root"}
    assert found == {".": root, "p": {"a": {"x": 2, "y": [1]}, "b": "root"}, "p/q": {"a": 3, "b": "root"}, "p/q/r": {"a": {"z": None}, "b": "root"}, "p/none": {"a": {"x": 2, "y": [1]}, "b": "root"}, "pq": root}
    ends = spark.createDataFrame([("p",), ("p/q/r",)], "dir string")
    found = {r.dir: json.loads(r.json) for r in documents.in_force(docs, targets, ends).collect()}
    assert found["p/q"] == {"a": 3} and found["p/q/r"] == {"a": {"z": None}} and found["p/none"] == {"a": {"x": 2}} and found["pq"] == root


def test_flatten_keeps_columns_and_places(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": {}}, "c": [{"d": 1}]}'), (2, "7"), (3, None)], "id int, json string").select("id", F.parse_json("json").alias("doc"))
    assert {(r.id, tuple(r.path), r.value) for r in documents.flatten(df).collect()} == {(1, ("a",), None), (1, ("a", "b"), None), (1, ("c",), '[{"d":1}]')}


@pytest.mark.parametrize("empty", [True])
def test_no_documents(spark, empty):
    docs = spark.createDataFrame([("a", "{}")], "dir string, json string").select("dir", F.parse_json("json").alias("doc")).where("false")
    assert [tuple(r) for r in documents.in_force(docs, spark.createDataFrame([("x",)], "dir string")).collect()] == [("x", "{}")]
