"""Stages that ask row by row, repairs of results, and provenance by changes, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import changes, runner
from corpusloom.operators.models import Route, Router

ROUTER = Router({"a": Route("a", "m1"), "b": Route("b", "m2"), "c": Route("c", "m3", True)})


def test_only_rows_that_fail_are_asked_again(spark, tmp_path):
    def call(requests):
        out = []
        for r in requests:
            with open(f"{tmp_path}/{r['id']}", "a") as f:
                f.write(json.dumps([r["attempt"], r["route"], r["repair_type"], r["repair_context"]]) + "\n")
            k = json.loads(r["inputs"])["k"]
            if k == 6:
                raise TimeoutError("slow")
            told = json.loads(r["repair_context"] or "null")
            good = json.dumps({"label": f"x{k}"})
            out.append({0: good, 1: "no json" if not told else good, 2: "[1]", 3: '{"label": ""}' if not told else f"```json\n{good}\n```", 4: '{"label": ""}'}.get(k % 5, good))
        return out

    def read(raw, inputs):
        return runner.checked_object(raw, F.when(F.get_json_object(runner.strip_fence(raw), "$.label") == "", "label is required"))

    prompts = spark.createDataFrame([(i, json.dumps({"k": i})) for i in range(6)] + [(6, '{"k": 6}')], "id int, inputs string").repartition(2)
    found = runner.run(prompts, runner.Contract("s", "a", "b", "c"), ROUTER, runner.called(call, 1), read)
    assert {r.id: (r.artifact, r.attempts, r.repaired) for r in found.results.collect()} == {0: ('{"label": "x0"}', 1, False), 5: ('{"label": "x5"}', 1, False), 1: ('{"label": "x1"}', 2, True), 3: ('{"label": "x3"}', 2, True)}
    assert {r.id: (r.attempts, r.reason) for r in found.blocked.collect()} == {2: (2, runner.NO_OBJECT), 4: (2, "label is required"), 6: (1, "TimeoutError: slow")}
    assert found.log.count() == 11 == found.log.count()
    asked = {i: [json.loads(x) for x in open(f"{tmp_path}/{i}")] for i in range(7)}
    assert {i: len(x) for i, x in asked.items()} == {0: 1, 5: 1, 6: 1, 1: 2, 2: 2, 3: 2, 4: 2}  # however often results are read
    assert asked[1][1][1:3] == ["b", "format_repair"] and asked[4][1][1:3] == ["c", "contextual_repair"]
    told = json.loads(asked[4][1][3])
    assert told["validator_errors"] == ["label is required"] and told["failed_output"] == '{"label": ""}' and told["instruction"]
    events = {r.event: r["count"] for r in runner.progress(found).groupBy("event").count().collect()}
    assert events == {"model_call_start": 11, "model_call_returned": 10, "model_call_error": 1}
    empty = runner.run(prompts.where("id < 0"), runner.Contract("s", "a"), ROUTER, runner.called(call), read)
    assert empty.results.isEmpty() and empty.blocked.isEmpty()
    with pytest.raises(KeyError):
        runner.run(prompts, runner.Contract("s", "unknown"), ROUTER, runner.called(call))


def plain_lesson(concepts, sources, assigned, targets, new, new_sources, additions, decided, entries):
    """One scope's repair, step by step on lists."""
    n = len(concepts)
    mine = {c: [x for x in sources.get(c, []) if x not in targets] for c in concepts}
    order = [c for c in concepts if mine[c]]
    names = {}
    for k, i in enumerate(new, n + 1):
        names[i] = f"reconciled-candidate-1-{k:03d}"
        mine[names[i]] = [x for x in new_sources[i] if x in entries]
        order.append(names[i])
    put = [(c, x) for c, x in additions if x in entries]
    out = [a for a in assigned if a[0] not in targets]
    for cand, status, ids, merged, reason in decided:
        if cand not in entries or status not in ("pruned", "used_in", "merged_into"):
            continue
        finals = [names.get(i, i) for i in (ids or [] if status == "used_in" else [merged] if status == "merged_into" else []) if i]
        put += [(f, cand) for f in finals]
        out.append((cand, status, finals if status == "used_in" else None, finals[0] if status == "merged_into" and finals else None, reason if status == "pruned" else None))
    for c, x in put:
        if c in order and x not in mine[c]:
            mine[c].append(x)
    return order, {c: mine[c] for c in order if mine[c]}, out


def test_repairs_of_lessons_are_those_of_lists(spark):
    rng = random.Random(4)
    tables = {k: [] for k in ("concepts", "sources", "assigned", "targets", "new", "new_sources", "additions", "decided", "entries")}
    want = {}
    for scope in range(40):
        cands = [f"c{i}" for i in range(rng.randint(1, 9))]
        entries = [c for c in cands if rng.random() < 0.85]
        concepts = [f"reconciled-candidate-1-{k:03d}" for k in range(1, rng.randint(1, 4))]
        sources = {c: rng.sample(cands, rng.randint(1, len(cands))) for c in concepts}
        targets = [c for c in cands if rng.random() < 0.4]
        new = [f"n{k}" for k in range(rng.randint(0, 2))]
        new_sources = {i: rng.sample(cands, rng.randint(0, len(cands))) for i in new}
        some = [*concepts, *new, "lost"]
        additions = [(rng.choice([*concepts, "lost"]), rng.choice(cands)) for _ in range(rng.randint(0, 3))]
        assigned = [(c, "used_in", ["k"], None, None) for c in cands]
        decided = [(c, s, rng.choices(some, k=rng.randint(0, 2)) if s == "used_in" else None, rng.choice([*some, None, ""]) if s == "merged_into" else None, "duplicate") for c in targets for s in [rng.choice(["pruned", "used_in", "merged_into", "review"])]]
        want[scope] = plain_lesson(concepts, sources, assigned, targets, new, new_sources, additions, decided, entries)
        text = ("l", "d", ["c"], "m")
        tables["concepts"] += [(scope, i, c, *text) for i, c in enumerate(concepts)]
        tables["sources"] += [(scope, c, i, x) for c in concepts for i, x in enumerate(sources[c])]
        tables["assigned"] += [(scope, i, *a, None) for i, a in enumerate(assigned)]
        tables["targets"] += [(scope, c) for c in targets]
        tables["new"] += [(scope, i, c, *text) for i, c in enumerate(new)]
        tables["new_sources"] += [(scope, c, i, x) for c in new for i, x in enumerate(new_sources[c])]
        tables["additions"] += [(scope, i, c, x) for i, (c, x) in enumerate(additions)]
        tables["decided"] += [(scope, i, *a, "why") for i, a in enumerate(decided)]
        tables["entries"] += [(scope, c) for c in entries]
    concept = "scope_id int, ord bigint, {} string, label string, description string, coverage_criteria array<string>, merge_rationale string"
    source, pair = "scope_id int, {} string, pos bigint, candidate_id string", "scope_id int, candidate_id string"
    assignment = "scope_id int, ord bigint, candidate_id string, status string, accepted_ids array<string>, merged_into string, reason string, explanation string"
    schema = {"concepts": concept.format("concept_id"), "new": concept.format("id"), "sources": source.format("concept_id"), "new_sources": source.format("id"), "assigned": assignment, "decided": assignment, "targets": pair, "entries": pair, "additions": "scope_id int, ord bigint, concept_id string, candidate_id string"}
    d = {k: spark.createDataFrame([tuple(re.sub("candidate-1-", f"candidate-{r[0]}-", x) if isinstance(x, str) else [re.sub("candidate-1-", f"candidate-{r[0]}-", y) for y in x] if isinstance(x, list) else x for x in r) for r in rows], schema[k]) for k, rows in tables.items()}
    got = changes.repair_lesson(changes.Result(d["concepts"], d["sources"], d["assigned"]), changes.Decision(d["targets"], d["new"], d["new_sources"], d["additions"], d["decided"]), d["entries"])
    concepts, sources, assigned = ([r.asDict() for r in df.collect()] for df in got[:3])
    for scope, (order, members, said) in want.items():
        named = lambda x, s=scope: x and (re.sub("candidate-1-", f"candidate-{s}-", x) if isinstance(x, str) else [re.sub("candidate-1-", f"candidate-{s}-", y) for y in x])
        assert [r["concept_id"] for r in sorted(concepts, key=lambda r: r["ord"]) if r["scope_id"] == scope] == named(order)
        found = {}
        for r in sorted(sources, key=lambda r: r["pos"]):
            if r["scope_id"] == scope:
                found.setdefault(r["concept_id"], []).append(r["candidate_id"])
        assert found == {named(c): x for c, x in members.items()}
        rows = [r for r in sorted(assigned, key=lambda r: r["ord"]) if r["scope_id"] == scope]
        assert [(r["candidate_id"], r["status"], r["accepted_ids"], r["merged_into"], r["reason"]) for r in rows] == [(c, s, named(i) if i else i, named(m), w) for c, s, i, m, w in said]
    told = {(r.scope_id, r.conflict) for r in got.conflicts.collect()}
    assert {c for _, c in told} == {"candidate is unknown", "concept is not there"}
    total = {r.scope_id: r for r in changes.summary(got, d["entries"]).collect()}
    assert all(total[s].concept_count == len(order) for s, (order, _, _) in want.items() if s in total)


def test_subjects_and_candidates_that_stand_alone(spark):
    concepts = spark.createDataFrame([(1, 1, "k1", "l", "d", ["c"], "m"), (1, 2, "k2", "l", "d", ["c"], "m")], "scope_id int, ord bigint, concept_id string, label string, description string, coverage_criteria array<string>, merge_rationale string")
    sources = spark.createDataFrame([(1, "k1", 1, "a"), (1, "k1", 2, "b"), (1, "k2", 1, "c")], "scope_id int, concept_id string, pos bigint, candidate_id string")
    kind = "scope_id int, ord bigint, candidate_id string, status string, accepted_ids array<string>, merged_into string, reason string, explanation string"
    assigned = spark.createDataFrame([(1, i, c, "used_in", ["k"], None, None, None) for i, c in enumerate("abc")], kind)
    entries = spark.createDataFrame([(1, c, f"L {c}", f"D {c}") for c in "abcd"], "scope_id int, candidate_id string, label string, description string")
    now = changes.Result(concepts, sources, assigned)
    decision = changes.Decision(
        spark.createDataFrame([(1, "b"), (1, "c")], "scope_id int, candidate_id string"), concepts.where("ord = 1").withColumnRenamed("concept_id", "id").withColumn("id", F.lit("x")),
        spark.createDataFrame([(1, "x", 1, "c"), (1, "x", 2, "zz")], "scope_id int, id string, pos bigint, candidate_id string"), None,
        spark.createDataFrame([(1, 1, "c", "used_in", ["x", "k1"], None, None, None), (1, 2, "b", "merged_into", None, "x", None, None), (1, 3, "a", "pruned", None, None, "duplicate", None)], kind),
    )
    got = changes.repair_subject(now, decision, entries)
    made = [r.concept_id for r in got.concepts.orderBy("ord").collect()]
    assert made[0] == "k1" and len(made) == 2 and made[1].startswith("concept-l-")
    assert sorted(tuple(r) for r in got.sources.collect()) == sorted([(1, "k1", 1, "a"), (1, made[1], 1, "c")])
    assert {r.candidate_id: (r.status, r.accepted_ids, r.merged_into) for r in got.assignments.collect()} == {"a": ("used_in", ["k"], None), "c": ("used_in", [made[1]], None), "b": ("merged_into", None, made[1])}
    plans = spark.createDataFrame([(1, "assignment_incomplete", ["d", "a", "zz"]), (1, "other", ["b"])], "scope_id int, repair_reason string, candidate_ids array<string>")
    alone = changes.with_standalone(now, plans, entries)
    (new,) = [r for r in alone.concepts.collect() if r.ord == 3]
    assert (new.label, new.description) == ("L d", "D d") and (1, new.concept_id, 1, "d") in {tuple(r) for r in alone.sources.collect()}
    assert [(r.ord, r.accepted_ids) for r in alone.assignments.where("candidate_id = 'd'").collect()] == [(3, ["phase5b_standalone_d"])]


def test_refreshed_provenance_is_that_of_a_rebuild(spark):
    rng = random.Random(9)
    entries = spark.createDataFrame(
        [(1, f"c{i}", f"l{i % 5}", "t", f"label {i}", "p", f"o{i}", [f"s{i}"], None, ["source_body"], [([("page", i)],), (None,)], "definition") for i in range(60)],
        "scope_id int, candidate_id string, lesson_id string, title string, label string, artifact_path string, original_candidate_id string, source_candidate_ids array<string>, source_roles array<string>, evidence_types array<string>, evidence array<struct<anchors:array<struct<kind:string,at:int>>>>, depth string",
    )
    rows = [(1, f"k{rng.randint(0, 12)}", i, f"c{rng.randint(0, 70)}") for i in range(90)]
    later = [r for r in rows if rng.random() < 0.9] + [(1, "k99", 5, "c1"), (1, "k3", 200, "c2")]
    kind = "scope_id int, concept_id string, pos bigint, candidate_id string"
    before, after = spark.createDataFrame(rows, kind), spark.createDataFrame(later, kind)
    plain = lambda df: sorted(str(r) for r in df.collect())
    assert plain(changes.refreshed(changes.provenance(before, entries), before, after, entries)) == plain(changes.provenance(after, entries))
    stale = {r.concept_id for r in changes.changed(before, after).collect()}
    assert "k99" in stale and changes.changed(before, before.withColumn("pos", F.col("pos") + 5)).isEmpty()
    renamed = entries.withColumn("label", F.when(F.col("candidate_id") == "c7", "other").otherwise(F.col("label")))
    touched = spark.createDataFrame([(1, "c7")], "scope_id int, candidate_id string")
    assert plain(changes.refreshed(changes.provenance(before, entries), before, after, renamed, touched)) == plain(changes.provenance(after, renamed))
    (one,) = changes.provenance(spark.createDataFrame([(1, "k", 1, "c7")], kind), entries).collect()
    assert one.refs[0].anchors == [("page", 7)] and one.occurrences[0].lesson.lesson_id == "l2"
