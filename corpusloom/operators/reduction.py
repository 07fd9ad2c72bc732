"""Reduce decisions as documents, one row each: the registry of candidates, what a model is shown, and the full validation.

A decision row has: scope_id, artifact_type, schema_version, input_candidate_ids (array), accepted_concepts and accepted
(arrays of structs, see CONCEPT), candidate_assignments (array of structs, see ASSIGNMENT), pruned (array of structs with
candidate_id) and summary (see SUMMARY). Everything is an expression over that row, so nothing is moved but the registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import text
from corpusloom.operators.decisions import PRUNING_REASONS, STATUSES

CONCEPT = "struct<id:string,label:string,description:string,merge_rationale:string,coverage_criteria:array<string>,source_candidate_ids:array<string>>"
ASSIGNMENT = "struct<candidate_id:string,status:string,accepted_ids:array<string>,merged_into:string,reason:string,explanation:string>"
SUMMARY = "struct<input_candidate_count:bigint,accepted_count:bigint,pruned_count:bigint,candidate_assignment_count:bigint,review_count:bigint>"
DECISION = f"scope_id string, artifact_type string, schema_version string, input_candidate_ids array<string>, accepted_concepts array<{CONCEPT}>, accepted array<{CONCEPT}>, candidate_assignments array<{ASSIGNMENT}>, pruned array<struct<candidate_id:string>>, summary {SUMMARY}"
#: What names a decision.
ARTIFACT_TYPE, SCHEMA_VERSION = "semantic_reduce_decision", "semantic_reduce_decision.v0"
#: What is wrong with a decision, behind the place that it names, in the order in which it is looked for.
SAYS = {
    "no_id": ".id is required",
    "id_twice": ".id is duplicated",
    "no_criteria": ".coverage_criteria must contain at least one string",
    "no_sources": ".source_candidate_ids must contain candidate IDs",
    "odd_source": ".source_candidate_ids references unknown candidate ",
    "source_twice": ".source_candidate_ids contains duplicates: ",
    "no_candidate": ".candidate_id is required",
    "odd_candidate": ".candidate_id references unknown candidate ",
    "odd_status": ".status must be one of ",
    "no_accepted": ".accepted_ids must reference at least one accepted concept",
    "no_target": ".merged_into is required",
    "odd_reason": ".reason must be a controlled Candidate Pruning Reason",
    "no_explanation": ".explanation is required",
    "pruned_evidence": ".candidate_id cannot be pruned because it is used as accepted evidence",
    "review_evidence": ".candidate_id cannot require review because it is used as accepted evidence",
    "odd_concept": " references unknown accepted concept ",
    "uncited": ".candidate_id must appear in accepted_concepts source_candidate_ids for ",
}


def registry(sources: DataFrame) -> DataFrame:
    """A row for each candidate of sources (scope_id, ord, namespace, artifact_path, lesson_id, self_study_id, model_route,
    evidence_type, candidates): compact_id, order in its scope, the candidate's own fields, and candidate_ref.

    candidates: array of structs with candidate_id, label, description, coverage_criteria, source_roles, evidence_type,
    source_anchors, metadata_anchors, extraction_reason (map). A namespace numbers its candidates from 001.
    """
    from pyspark.sql import Window

    rows = sources.select("scope_id", "ord", "namespace", "artifact_path", "lesson_id", "self_study_id", "model_route", F.col("evidence_type").alias("_kind"), F.posexplode("candidates").alias("_p", "_c"))
    kind = F.coalesce(F.nullif(text("_c.evidence_type"), F.lit("")), text("_kind"))
    number = F.col("_p") + 1
    compact = F.concat(F.col("namespace"), F.lit("_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))
    none = F.array().cast("array<string>")
    anchors = F.coalesce("_c.source_anchors", "_c.metadata_anchors", F.array().cast("array<struct<kind:string,locator:string>>"))
    ref = F.struct("artifact_path", text("_c.candidate_id").alias("candidate_id"), kind.alias("evidence_type"), "model_route", "lesson_id", "self_study_id")
    return rows.select(
        "scope_id", compact.alias("compact_id"), F.row_number().over(Window.partitionBy("scope_id").orderBy("ord", "_p")).alias("order"), text("_c.candidate_id").alias("original_candidate_id"),
        "lesson_id", "self_study_id", "model_route", kind.alias("evidence_type"), F.col("_c.label").alias("label"), F.col("_c.description").alias("description"),
        F.coalesce("_c.coverage_criteria", none).alias("coverage_criteria"), F.coalesce("_c.source_roles", none).alias("source_roles"), anchors.alias("anchors"),
        F.coalesce("_c.extraction_reason", F.create_map().cast("map<string,string>")).alias("extraction_reason"), ref.alias("candidate_ref"),
    )


def registry_problems(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(scope_id, subject, problem): sources without a namespace, and compact ids that come twice in a scope."""
    unnamed = sources.where(F.trim(text("namespace")) == "").select("scope_id", F.col("ord").cast("string").alias("subject"), F.lit("candidate source namespace is required").alias("problem"))
    twice = entries.groupBy("scope_id", "compact_id").count().where("count > 1").select("scope_id", F.col("compact_id").alias("subject"), F.lit("duplicate compact candidate id").alias("problem"))
    return unnamed.unionByName(twice)


def compact_view(entries: DataFrame) -> DataFrame:
    """What a model is shown of a registry's candidates: no artifact paths, filled rationales, the first five locators."""
    from corpusloom.operators.extraction import compact_anchors

    filled = F.map_filter("extraction_reason", lambda _, v: F.trim(text(v)) != "")
    return entries.select("scope_id", "order", F.col("compact_id").alias("id"), "label", "description", "coverage_criteria", "source_roles", "evidence_type", filled.alias("rationale"), compact_anchors("anchors").alias("anchors"))


def reduce_inputs(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(scope_id, candidates, unknown): the compact views that requests (scope_id, input_candidate_ids) ask for, in their
    order, and the ids that the registry does not know."""
    asked = requests.select("scope_id", F.posexplode("input_candidate_ids").alias("_p", "id"))
    both = asked.join(compact_view(entries).withColumn("_known", F.lit(True)).drop("order"), ["scope_id", "id"], "left")
    view = F.struct("id", "label", "description", "coverage_criteria", "source_roles", "evidence_type", F.to_json("rationale").alias("rationale"), "anchors")
    listed = F.array_sort(F.collect_list(F.when(F.col("_known"), F.struct("_p", view.alias("v")))))
    return both.groupBy("scope_id").agg(F.transform(listed, lambda x: x["v"]).alias("candidates"), F.array_sort(F.collect_list(F.when(F.col("_known").isNull(), F.col("id")))).alias("unknown"))


def _repeated(values: Column) -> Column:
    """Values that come more than once, in the order in which their second comes."""
    again = F.filter(F.transform(values, lambda x, i: F.when(F.array_contains(F.slice(values, F.lit(1), i), x), x)), lambda x: x.isNotNull())
    return F.array_distinct(again)


def _filled(strings: Column) -> Column:
    return F.coalesce(F.exists(strings, lambda x: F.trim(text(x)) != ""), F.lit(False))


def _said(*checks: tuple[Column, Column | str]) -> Column:
    """The messages of the checks that are true, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in checks)))


def validate_reduce_decision(decisions: DataFrame, registries: DataFrame) -> DataFrame:
    """(scope_id, errors): what is wrong with each decision, by place and then by the whole; empty for a valid one.

    registries: scope_id, candidate_ids. A null list is one that is missing. Lists are looked at in order: of accepted
    concepts with one id, the last with sources is what references to it are checked against.
    """
    d = decisions.join(registries.select("scope_id", F.col("candidate_ids").alias("_known")), "scope_id", "left")
    own = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    ids_ok = F.col("input_candidate_ids").isNotNull() & F.forall("input_candidate_ids", lambda x: text(x) != "")
    d = d.withColumns({
        "_ids": F.when(F.coalesce(ids_ok, F.lit(False)), F.col("input_candidate_ids")).otherwise(F.array().cast("array<string>")), "_ids_ok": F.coalesce(ids_ok, F.lit(False)),
        "_acc": own("accepted_concepts", f"array<{CONCEPT}>"), "_asg": own("candidate_assignments", f"array<{ASSIGNMENT}>"), "_pru": own("pruned", "array<struct<candidate_id:string>>"),
    })
    inside = lambda x: F.array_contains("_ids", x)
    d = d.withColumn("_acc", F.transform("_acc", lambda x: x.withField("valid", F.filter(F.coalesce(x["source_candidate_ids"], F.array().cast("array<string>")), lambda y: (text(y) != "") & inside(y)))))
    d = d.withColumns({"_acc_ids": F.filter(F.transform("_acc", lambda x: text(x["id"])), lambda x: x != ""), "_used": F.array_distinct(F.flatten(F.transform("_acc", lambda x: x["valid"])))})
    at = lambda what, i, rest: F.concat(F.lit(f"{what}["), i.cast("string"), F.lit("]"), rest if isinstance(rest, Column) else F.lit(rest))

    def concept(x: Column, i: Column) -> Column:
        here = lambda rest: at("accepted_concepts", i, rest)
        before = F.transform(F.slice("_acc", F.lit(1), i), lambda y: text(y["id"]))
        listed = F.coalesce(F.size(x["source_candidate_ids"]) > 0, F.lit(False))
        head = _said(
            (text(x["id"]) == "", here(SAYS["no_id"])), ((text(x["id"]) != "") & F.array_contains(before, text(x["id"])), here(SAYS["id_twice"])),
            *((F.trim(text(x[f])) == "", here(f".{f} is required")) for f in ("label", "description", "merge_rationale")),
            (~_filled(x["coverage_criteria"]), here(SAYS["no_criteria"])), (~listed, here(SAYS["no_sources"])),
        )
        source = lambda y: F.when(text(y) == "", here(SAYS["no_sources"])).when(~inside(y), here(F.concat(F.lit(SAYS["odd_source"]), y)))
        each = F.array_compact(F.transform(F.coalesce(x["source_candidate_ids"], F.array().cast("array<string>")), source))
        twice = _said((F.size(_repeated(x["valid"])) > 0, here(F.concat(F.lit(SAYS["source_twice"]), F.array_join(_repeated(x["valid"]), ", ")))))
        return F.concat(head, each, twice)

    def assignment(x: Column, i: Column) -> Column:
        here = lambda rest: at("candidate_assignments", i, rest)
        id_, status = text(x["candidate_id"]), text(x["status"])
        known = status.isin(*STATUSES)
        named = F.filter(F.coalesce(x["accepted_ids"], F.array().cast("array<string>")), lambda y: text(y) != "")
        into = F.when(text(x["merged_into"]) != "", F.array(x["merged_into"])).otherwise(F.array().cast("array<string>"))
        refs = F.when(status == "used_in", named).when(status == "merged_into", into).when(known, named).otherwise(F.array().cast("array<string>"))
        unexplained, cited = F.trim(text(x["explanation"])) == "", F.array_contains("_used", id_)
        head = _said(
            (id_ == "", here(SAYS["no_candidate"])), ((id_ != "") & ~inside(id_), here(F.concat(F.lit(SAYS["odd_candidate"]), id_))),
            (~known, here(SAYS["odd_status"] + ", ".join(sorted(STATUSES)))),
            ((status == "used_in") & (F.size(named) == 0), here(SAYS["no_accepted"])),
            ((status == "merged_into") & (text(x["merged_into"]) == ""), here(SAYS["no_target"])),
            ((status == "pruned") & ~text(x["reason"]).isin(*PRUNING_REASONS), here(SAYS["odd_reason"])),
            (status.isin("pruned", "review") & unexplained, here(SAYS["no_explanation"])),
            ((status == "pruned") & cited, here(SAYS["pruned_evidence"])),
            ((status == "review") & cited, here(SAYS["review_evidence"])),
        )
        with_sources = lambda ref: F.filter("_acc", lambda y: (text(y["id"]) == ref) & F.coalesce(F.size(y["source_candidate_ids"]) > 0, F.lit(False)))
        cites = lambda ref: F.coalesce(F.array_contains(F.try_element_at(with_sources(ref), F.lit(-1))["valid"], id_), F.lit(False))
        ref = lambda r: F.when(~F.array_contains("_acc_ids", r), here(F.concat(F.lit(SAYS["odd_concept"]), r))).when((id_ != "") & ~cites(r), here(F.concat(F.lit(SAYS["uncited"]), r)))
        return F.concat(head, F.array_compact(F.transform(refs, ref)))

    known = lambda f: F.filter(F.transform("_asg", f), lambda x: x.isNotNull())
    assigned = known(lambda x: F.when((text(x["candidate_id"]) != "") & inside(x["candidate_id"]), x["candidate_id"]))
    of = lambda status: known(lambda x: F.when(x["status"] == status, text(x["candidate_id"])))
    listed = lambda c: F.array_join(c, ", ")
    unknown = F.array_sort(F.array_except("_ids", F.coalesce("_known", F.array().cast("array<string>"))))
    missing = F.array_sort(F.array_except("_ids", assigned))
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    lead = f"{ARTIFACT_TYPE}."
    head = _said(
        (~F.col("artifact_type").eqNullSafe(F.lit(ARTIFACT_TYPE)), f"{lead}artifact_type must be '{ARTIFACT_TYPE}'"), (~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), f"{lead}schema_version must be '{SCHEMA_VERSION}'"),
        (F.col("_known").isNull(), f"{lead}scope_id must match registry.scope_id"), (~F.col("_ids_ok"), f"{lead}input_candidate_ids must contain candidate IDs"),
        (F.size(unknown) > 0, F.concat(F.lit(f"{lead}input_candidate_ids references unknown candidates: "), listed(unknown))),
        (F.col("accepted_concepts").isNull(), f"{lead}accepted_concepts must be a list"), (~F.col("accepted").eqNullSafe(own("accepted_concepts", f"array<{CONCEPT}>")), f"{lead}accepted must match accepted_concepts"),
    )
    middle = _said((F.col("candidate_assignments").isNull(), f"{lead}candidate_assignments must be a list"))
    count = lambda f, have, words: (~F.col(f"summary.{f}").eqNullSafe(have.cast("bigint")), f"{lead}summary.{f} does not match {words}")
    tail = _said(
        (F.size(_repeated(assigned)) > 0, F.concat(F.lit(f"{lead}candidate_assignments candidate_id values are duplicated: "), listed(_repeated(assigned)))),
        (F.size(missing) > 0, F.concat(F.lit("semantic_reduce_decision every input candidate must have one assignment: "), listed(missing))),
        (F.col("pruned").isNull(), f"{lead}pruned must be a list"),
        (as_set(F.transform("_pru", lambda x: text(x["candidate_id"]))) != as_set(of("pruned")), f"{lead}pruned must match candidate_assignments with status pruned"),
        count("input_candidate_count", F.size("_ids"), "input_candidate_ids length"), count("accepted_count", F.size("_acc"), "accepted_concepts length"), count("pruned_count", F.size("_pru"), "pruned length"),
        count("candidate_assignment_count", F.size("_asg"), "candidate_assignments length"), count("review_count", F.size(of("review")), "review assignment length"),
    )
    return d.select("scope_id", F.concat(head, F.flatten(F.transform("_acc", concept)), middle, F.flatten(F.transform("_asg", assignment)), tail).alias("errors"))


def normalize_decision(answers: DataFrame) -> DataFrame:
    """Decision rows (see the module) of answers (scope_id, input_candidate_ids, answer: a JSON text); problem tells what
    an answer lacks to be one, and is null otherwise.

    Fields of assignments go by several names: status or disposition; accepted_ids, used_in, accepted_concept_ids or
    accepted_concepts, a list or one id; merged_into or accepted_id; reason or pruning_reason. The first that is there counts.
    """
    v = F.try_parse_json("answer")
    get = lambda x, *paths: F.coalesce(*(F.try_variant_get(x, f"$.{p}", "string") for p in paths))
    concept = lambda x: F.struct(*(get(x, f).alias(f) for f in ("id", "label", "description", "merge_rationale")), F.try_variant_get(x, "$.coverage_criteria", "array<string>").alias("coverage_criteria"), F.try_variant_get(x, "$.source_candidate_ids", "array<string>").alias("source_candidate_ids"))

    def accepted_ids(x: Column) -> Column:
        found = None
        for p in ("accepted_ids", "used_in", "accepted_concept_ids", "accepted_concepts"):
            as_list, as_one = F.try_variant_get(x, f"$.{p}", "array<string>"), F.try_variant_get(x, f"$.{p}", "string")
            there = F.when(as_list.isNotNull(), as_list).when(as_one.isNotNull(), F.array(as_one))
            found = there if found is None else F.coalesce(found, there)
        return found

    assignment = lambda x: F.struct(get(x, "candidate_id").alias("candidate_id"), get(x, "status", "disposition").alias("status"), accepted_ids(x).alias("accepted_ids"), get(x, "merged_into", "accepted_id").alias("merged_into"), get(x, "reason", "pruning_reason").alias("reason"), get(x, "explanation").alias("explanation"))
    rows = answers.select("scope_id", "input_candidate_ids", v.alias("_v"))
    lists = rows.withColumns({"_a": F.coalesce(F.try_variant_get("_v", "$.accepted_concepts", "array<variant>"), F.try_variant_get("_v", "$.accepted", "array<variant>")), "_s": F.try_variant_get("_v", "$.candidate_assignments", "array<variant>")})
    problem = (
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "semantic reduce model output must be a JSON object")
        .when(F.col("_a").isNull(), "semantic reduce model output must include accepted_concepts").when(F.col("_s").isNull(), "semantic reduce model output must include candidate_assignments")
    )
    made = lists.withColumns({"accepted_concepts": F.transform("_a", concept), "candidate_assignments": F.transform("_s", assignment), "problem": problem})
    pruned = F.transform(F.filter("candidate_assignments", lambda x: x["status"] == "pruned"), lambda x: F.struct(x["candidate_id"].alias("candidate_id")))
    size = lambda c: F.size(c).cast("bigint")
    summary = F.struct(size("input_candidate_ids").alias("input_candidate_count"), size("accepted_concepts").alias("accepted_count"), size(pruned).alias("pruned_count"), size("candidate_assignments").alias("candidate_assignment_count"), size(F.filter("candidate_assignments", lambda x: x["status"] == "review")).alias("review_count"))
    return made.select("scope_id", F.lit(ARTIFACT_TYPE).alias("artifact_type"), F.lit(SCHEMA_VERSION).alias("schema_version"), "input_candidate_ids", "accepted_concepts", F.col("accepted_concepts").alias("accepted"), "candidate_assignments", pruned.alias("pruned"), summary.alias("summary"), "problem")
