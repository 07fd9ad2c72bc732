"""Whole graphs and merge audits: plans, and odd inputs."""

import json

from pyspark.sql import functions as F

from corpusloom.operators import build, quality
from corpusloom.plans import graphs
from corpusloom.plans.base import Tables

DATA = "/root/testdata/sf0.001"


def test_a_document_moves_its_parts_once(spark):
    tables = graphs._graph(Tables(spark, DATA))
    cut = [spark.createDataFrame(t.collect(), t.schema) for t in tables]
    none = spark.createDataFrame([], "subject_id string, severity string, code string, lesson_id string, concept_id string")
    found = build.documents(*cut, none)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # By subject once for all parts; besides, concepts meet their classifications, and findings are counted.
    assert final.count("Exchange hashpartitioning(subject_id") <= 3 and "SinglePartition" not in final
    levels = final[: final.index("Union")] if "Union" in final else final
    assert levels.count("Exchange hashpartitioning(subject_id") <= 2


def test_a_graph_with_and_without_errors(spark):
    concepts = spark.createDataFrame(
        [("s", 2, "b", "C2", "B", "d", ["x", " "], ["l1"], None), ("s", 1, "a", "C1", "A", None, ["x"], ["l1", "l2"], None), ("t", 1, "a", "C1", "A", "d", ["x"], ["l1"], None)],
        "subject_id string, ord int, concept_id string, display_code string, label string, description string, coverage_criteria array<string>, lesson_ids array<string>, provenance struct<source_candidate_ids: array<string>>",
    )
    classified = spark.createDataFrame([(s, c, k, "r", 0.5) for s, c, k in (("s", "a", "factual"), ("s", "b", "odd"), ("s", "z", "factual"), ("t", "a", "factual"))], "subject_id string, concept_id string, knowledge_type string, rationale string, confidence double")
    lessons = spark.createDataFrame([(s, i, f"l{i}", f"L0{i}", "d", None, None) for s, n in (("s", 3), ("t", 2)) for i in range(1, n + 1)], "subject_id string, ord int, lesson_id string, display_code string, date string, title string, description string")
    segments = spark.createDataFrame(
        [("s", "l1", 2, "", "two", ["b", "b"], True), ("s", "l1", 1, "own", "one", ["a"], False), ("s", "l3", 1, None, "x", [], True), ("t", "l1", 7, None, None, ["a"], True)],
        "subject_id string, lesson_id string, segment_ord int, segment_id string, label string, concept_ids array<string>, repaired boolean",
    )
    found = build.validation(concepts, classified, lessons, segments)
    got = sorted((r.subject_id, r.severity, r.code, r.lesson_id or "", r.concept_id or "") for r in found.collect())
    assert got == sorted([
        ("s", "error", "missing_description", "", "a"), ("s", "error", "invalid_knowledge_type", "", "b"), ("s", "error", "unknown_classified_concept", "", "z"), ("s", "error", "duplicate_segment_concept", "l1", ""),
        ("s", "error", "unrepaired_lesson_segmentation", "l1", ""), ("s", "error", "missing_lesson_segments", "l2", ""), ("s", "warning", "lesson_without_concepts", "l3", ""), ("t", "warning", "lesson_without_concepts", "l2", ""),
    ])
    (doc,) = build.documents(concepts, classified, lessons, segments, found).collect()
    built, served = json.loads(doc.build_graph), json.loads(doc.runtime_graph)
    assert doc.subject_id == "t" and tuple(doc.summary) == (1, 2, 1, 1) and built["validation"] == {"status": "passed_with_warnings", "warning_count": 1}
    assert [(x["lesson_id"], [(s["segment_id"], s["display_code"], s["concept_ids"], s["concept_display_codes"], s["instructional_role"]) for s in x["segments"]], x["segmentation"]["status"]) for x in built["lessons"]] == [("l1", [("segment_001", "L01-S01", ["a"], ["C1"], "teach")], "segmented"), ("l2", [], "skipped_no_concepts")]
    assert "provenance" not in served["concepts"][0] and built["concepts"][0]["provenance"]["knowledge_type_classification"]["knowledge_type"] == "factual" and built["dependency_edges"] == []
    free = build.documents(concepts, classified, lessons, segments, found.where("false"))
    other = json.loads(next(r.build_graph for r in free.collect() if r.subject_id == "s"))
    assert [c["concept_id"] for c in other["concepts"]] == ["a", "b"] and other["concepts"][1]["coverage_criteria"] == ["x"]
    assert [(s["segment_id"], s["display_code"], s["concept_display_codes"]) for s in other["lessons"][0]["segments"]] == [("own", "L01-S01", ["C1"]), ("segment_002", "L01-S02", ["C2", "C2"])]
    empty = [t.where("false") for t in (concepts, classified, lessons, segments)]
    assert build.validation(*empty).isEmpty() and build.documents(*empty, found.where("false")).isEmpty()


def test_every_flag_occurs_in_the_query(spark):
    flags = {f for r in graphs.merge_audits(Tables(spark, "/root/testdata/sf0.01")).collect() for f in r["flags"].split(",")}
    assert flags >= set(quality.FLAGS)


def test_an_audit_of_nothing_wrong(spark):
    entries = spark.createDataFrame([("s", 1, "a", "definition"), ("s", 2, "b", None)], "scope_id string, ord int, candidate_id string, depth string")
    concepts = spark.createDataFrame([("s", 1, "k")], "scope_id string, ord int, concept_id string")
    sources = spark.createDataFrame([("s", "k", 1, "a"), ("s", "k", 2, "b")], "scope_id string, concept_id string, pos int, candidate_id string")
    occurrences = "scope_id string, concept_id string, occurrences array<struct<lesson:struct<lesson_id:string>, source_candidate_ids:array<string>, evidence_types:array<string>, depth:string>>"
    of = spark.createDataFrame([("s", "k", [(("l",), ["x"], None, None), (("m",), None, [], "")])], occurrences)
    none = spark.createDataFrame([], "scope_id string, ord int, candidate_ids array<string>")
    (row,) = quality.merge_audits(entries, concepts, sources, entries.select("scope_id", "candidate_id"), of, of, none).collect()
    assert row["flags"] == [] and row.reliability == "reliable" and set(row.scores) == {3} and row.repair_plan == [] and tuple(row.metrics) == (2, 1, 2, 0, 0, 2)
    other = of.withColumn("occurrences", F.reverse("occurrences"))
    deep = entries.withColumn("depth", F.when(F.col("candidate_id") == "a", "math"))
    (row,) = quality.merge_audits(deep, concepts, sources, entries.where("ord = 2").select("scope_id", "candidate_id"), of, other, spark.createDataFrame([("s", 1, ["a", "b"])], none.schema)).collect()
    assert tuple(row["flags"]) == quality.FLAGS and row.scores.net_phase5_benefit == 0
    assert [(p.repair_reason, p.candidate_ids) for p in row.repair_plan] == [("assignment_incomplete", ["a"]), ("provenance_loss", ["a", "b"]), ("over_merged_group", ["a", "b"]), ("residual_duplicate", ["a", "b"])]
