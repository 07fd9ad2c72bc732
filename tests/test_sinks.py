"""Artifacts, caches, events and inventories that are written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import assembly
from corpusloom.sources import artifacts, manifests


def lines(folder):
    return sorted(x for p in folder.glob("*.txt") for x in p.read_text().splitlines()) + sorted(x for p in folder.glob("*.json") for x in p.read_text().splitlines())


def test_artifacts_are_appended_and_needed(spark, tmp_path):
    at = f"file://{tmp_path}/made"
    assert artifacts.artifacts(spark, at).isEmpty()
    rows = spark.createDataFrame([("one", "a", '{"x": "é\\n"}'), ("two", "a", "no json")], artifacts.ARTIFACTS)
    artifacts.write_artifacts(rows.withColumn("more", F.lit(1)), at)
    artifacts.write_artifacts(spark.createDataFrame([("one", "b", "[]"), ("one", "a", "{}")], artifacts.ARTIFACTS), at)
    made = artifacts.artifacts(spark, at)
    assert sorted(map(tuple, made.collect())) == sorted([("one", "a", '{"x": "é\\n"}'), ("two", "a", "no json"), ("one", "b", "[]"), ("one", "a", "{}")])
    numbered = spark.createDataFrame([("s", "a", "old", 1), ("s", "a", "new", 2)], "stage string, scope_id string, payload string, n int")
    assert [tuple(r) for r in artifacts.latest(numbered, "n").collect()] == [("s", "a", "new")]
    scopes = spark.createDataFrame([("a",), ("b",), ("a",)], "scope_id string")
    assert sorted(map(tuple, artifacts.required(made, ("one", "two"), scopes).collect())) == [("two", "a", "input artifact is not valid JSON"), ("two", "b", "missing required input artifact")]
    with pytest.raises(artifacts.MissingInput, match="two of a: input artifact is not valid JSON; two of b: missing required input artifact"):
        artifacts.required_inputs(made, ("one", "two"), scopes)
    assert artifacts.required_inputs(made, ("one",), scopes).count() == 3


def test_caches_keep_the_latest(spark, tmp_path):
    at = f"file://{tmp_path}/cache"
    assert artifacts.read_cache(spark, at).isEmpty()
    artifacts.write_cache(spark.createDataFrame([("k", "1"), ("l", "x")], "cache_key string, payload string"), at)
    artifacts.write_cache(spark.createDataFrame([("k", "2")], "cache_key string, payload string"), at)
    asked = spark.createDataFrame([(1, "z", "k"), (2, "l", "k"), (3, "z", "z")], "id int, first string, second string")
    found = {r.id: (r.payload, r.hit) for r in artifacts.cached(asked, artifacts.read_cache(spark, at), ("first", "second")).collect()}
    assert found == {1: ("2", "second"), 2: ("x", "first"), 3: (None, None)}
    assert sorted(r.id for r in artifacts.pending(asked, artifacts.read_cache(spark, at), ("first", "second"), F.col("id") == 2).collect()) == [2, 3]


def test_json_lines_are_sorted_and_events_appended(spark, tmp_path):
    rows = spark.createDataFrame([("é", None, 2)], "z string, a string, m int")
    manifests.write_sorted_json(rows, f"file://{tmp_path}/sorted")
    assert lines(tmp_path / "sorted") == ['{"a":null,"m":2,"z":"é"}']
    for k in range(2):
        manifests.append_events(spark.createDataFrame([(k, "start")], "id int, event string"), f"file://{tmp_path}/events")
    assert [json.loads(x)["id"] for x in lines(tmp_path / "events")] == [0, 1]
    ranked = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, r int, v string")
    assert sorted(map(tuple, manifests.first_candidate(ranked, "k", "r").select("k", "v").collect())) == [(1, "a"), (2, "c")]
    (tmp_path / "texts/sub").mkdir(parents=True)
    for name, text in (("7-a.md", "x"), ("sub/7-b.md", "y"), ("8-c.md", "é"), ("no.md", "z")):
        (tmp_path / "texts" / name).write_text(text)
    assert sorted((r.id, r.text) for r in manifests.artifact_texts(spark, f"file://{tmp_path}/texts").collect()) == [("7", "x"), ("8", "é")]


def test_bundles_and_inventories(spark):
    made = spark.createDataFrame([("a", "1", "{}"), ("b", "1", "{}"), ("a", "2", "{}"), ("b", "2", "[]"), ("a", "2", "{}")], artifacts.ARTIFACTS)
    assert [r.scope_id for r in artifacts.whole_bundles(made, ("a", "b")).collect()] == ["1"]
    studies = spark.createDataFrame([("usable", "2"), ("usable", "1"), (None, "3")], "source_body_status string, self_study_id string")
    assert {r.source_body_status: (r.n, r.self_study_ids) for r in assembly.source_inventory(studies).collect()} == {"usable": (2, ["1", "2"]), None: (1, ["3"])}
