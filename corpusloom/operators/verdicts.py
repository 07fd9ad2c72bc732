"""Checks of whole answers after their normal form, and what audits and repairs change. Errors name the place, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import text
from corpusloom.operators.answers import AUDIT_FLAGS, AUDIT_REASONS, AUDIT_SCORES
from corpusloom.operators.decisions import PRUNING_REASONS
from corpusloom.operators.reduction import _filled, _repeated, _said

_STRINGS = "array<string>"
#: Reasons of a repair that are about two candidates at least.
PAIRED_REASONS = ("over_merged_group", "residual_duplicate", "missed_obvious_merge")
#: Reasons of pruning that confirm it when they are given again.
CONFIRMING_REASONS = ("unrelated", "low_teaching_value", "unsupported_lesson_intent", "incidental")
#: What is wrong with an answer, behind the place that it names, in the order in which it is looked for.
SAYS = {
    "no_label": ".label is required",
    "no_concepts": ".concept_ids must not be empty",
    "blank_concept": ".concept_ids must contain Concept IDs",
    "odd_concept": ".concept_ids references unknown Concept ID: ",
    "other_label": ".label must preserve the planner label",
    "other_members": ".concept_ids must preserve the planner Segment membership",
    "not_target": ".candidate_id must be one of the target candidates",
    "review": ".status must not be review",
    "no_reference": " must reference an accepted concept",
    "odd_reference": " references unknown accepted concept ",
    "odd_reason": ".reason must be a controlled pruning reason",
    "odd_status": ".status must be used_in, merged_into, or pruned",
    "no_criteria": ".coverage_criteria must contain at least one string",
    "no_sources": ".source_candidate_ids must contain target candidate IDs",
    "odd_source": ".source_candidate_ids must only contain target candidate IDs",
    "odd_repair": ".repair_reason is not allowed",
    "one_id": ".candidate_ids must contain at least two IDs for ",
    "odd_ids": ".candidate_ids references unknown candidates: ",
    "no_explanation": ".explanation is required",
}


def _none(kind: str = _STRINGS) -> Column:
    return F.array().cast(kind)


def _listed(ids: Column) -> Column:
    return F.array_join(ids, ", ")


def each_error(checked: DataFrame, key: str) -> DataFrame:
    """(key, error) of checked (key, errors), a row for each error.

    An outer explode: for an inner one Spark filters by the size of errors first, pushes that below the answer's parsing and
    so makes all of it again for every element that is looked at.
    """
    return checked.select(key, F.posexplode_outer("errors").alias("_at", "error")).where("_at is not null").drop("_at")


def segment_errors(rows: DataFrame, name: str = "lesson_segment_decision") -> DataFrame:
    """(lesson_id, errors) of rows (lesson_id, segments, expected_concept_ids): every expected concept in one segment, and no other."""
    known = lambda x: F.array_contains("expected_concept_ids", x)

    def one(x: Column, i: Column) -> Column:
        here = lambda rest: F.concat(F.lit(f"{name}.segments["), i.cast("string"), F.lit("]"), rest if isinstance(rest, Column) else F.lit(rest))
        head = _said((F.trim(text(x["label"])) == "", here(SAYS["no_label"])), (F.coalesce(F.size(x["concept_ids"]), F.lit(0)) <= 0, here(SAYS["no_concepts"])))
        each = F.transform(F.coalesce(x["concept_ids"], _none()), lambda y: F.when(text(y) == "", here(SAYS["blank_concept"])).when(~known(y), here(F.concat(F.lit(SAYS["odd_concept"]), y))))
        return F.concat(head, F.array_compact(each))

    seen = F.filter(F.flatten(F.transform("segments", lambda x: F.coalesce(x["concept_ids"], _none()))), lambda x: text(x) != "")
    r = rows.withColumn("_seen", F.coalesce(seen, _none()))
    missing = F.filter("expected_concept_ids", lambda x: ~F.array_contains("_seen", x))
    extra = F.array_sort(F.array_distinct(F.filter("_seen", lambda x: ~known(x))))
    whole = _said(
        (F.size(_repeated(F.col("_seen"))) > 0, F.concat(F.lit(f"{name}.segments repeat Concept IDs: "), _listed(F.array_sort(_repeated(F.col("_seen")))))),
        (F.size(missing) > 0, F.concat(F.lit(f"{name}.segments are missing Concept IDs: "), _listed(missing))), (F.size(extra) > 0, F.concat(F.lit(f"{name}.segments include extra Concept IDs: "), _listed(extra))),
    )
    empty = F.coalesce(F.size("segments"), F.lit(0)) <= 0
    return r.select("lesson_id", F.when(empty, F.array(F.lit(f"{name}.segments must not be empty"))).otherwise(F.concat(F.flatten(F.transform("segments", one)), whole)).alias("errors"))


def orderer_errors(rows: DataFrame, name: str = "lesson_segment_concept_orderer_decision") -> DataFrame:
    """(lesson_id, errors) of rows (lesson_id, segments, planned): an ordering keeps the plan's segments, labels and members."""
    planned = F.flatten(F.transform("planned", lambda x: F.coalesce(x["concept_ids"], _none())))
    checked = segment_errors(rows.select("lesson_id", "segments", planned.alias("expected_concept_ids")), name)
    as_set = lambda ids: F.array_sort(F.array_distinct(F.coalesce(ids, _none())))

    def one(x: Column, i: Column) -> Column:
        here = lambda rest: F.concat(F.lit(f"{name}.segments["), i.cast("string"), F.lit("]" + rest))
        return _said((~x["p"]["label"].eqNullSafe(x["s"]["label"]), here(SAYS["other_label"])), (as_set(x["p"]["concept_ids"]) != as_set(x["s"]["concept_ids"]), here(SAYS["other_members"])))

    both = F.transform(F.arrays_zip(F.col("planned").alias("p"), F.col("segments").alias("s")), lambda x: F.struct(x["p"].alias("p"), x["s"].alias("s")))
    same = F.when(F.size("planned") != F.coalesce(F.size("segments"), F.lit(0)), F.array(F.lit(f"{name} must preserve Segment count"))).otherwise(F.flatten(F.transform(both, one)))
    return checked.join(rows.select("lesson_id", same.alias("_same")), "lesson_id").select("lesson_id", F.concat("errors", "_same").alias("errors"))


def repair_errors(rows: DataFrame, name: str = "lesson_reconciliation_quality_repair_decision") -> DataFrame:
    """(scope_id, errors) of rows (scope_id, target_candidate_ids, existing_ids, new_accepted_concepts, candidate_assignments).

    A repair assigns every target candidate once, none to review, and to concepts that are new or exist.
    """
    target = lambda x: F.array_contains("target_candidate_ids", x)
    r = rows.withColumns({"_new": F.coalesce(F.transform("new_accepted_concepts", lambda x: text(x["id"])), _none()), "_asg": F.col("candidate_assignments")})
    r = r.withColumn("_ids", F.coalesce(F.transform("_asg", lambda x: text(x["candidate_id"])), _none()))

    def assignment(x: Column, i: Column) -> Column:
        here = lambda rest: F.concat(F.lit("candidate_assignments["), i.cast("string"), F.lit("]"), rest if isinstance(rest, Column) else F.lit(rest))
        status = text(x["status"])
        refs = F.when(status == "merged_into", F.array(text(x["merged_into"]))).when(status == "used_in", F.coalesce(x["accepted_ids"], _none())).otherwise(_none())
        head = _said((~target(text(x["candidate_id"])), here(SAYS["not_target"])), (status == "review", here(SAYS["review"])), (status.isin("used_in", "merged_into") & (F.size(refs) == 0), here(SAYS["no_reference"])))
        each = F.transform(refs, lambda y: F.when(~F.array_contains("_new", y) & ~F.array_contains("existing_ids", y), here(F.concat(F.lit(SAYS["odd_reference"]), y))))
        tail = _said(((status == "pruned") & ~text(x["reason"]).isin(*PRUNING_REASONS), here(SAYS["odd_reason"])), (~status.isin("review", "used_in", "merged_into", "pruned"), here(SAYS["odd_status"])))
        return F.concat(head, F.array_compact(each), tail)

    def concept(x: Column, i: Column) -> Column:
        here = lambda rest: F.concat(F.lit("new_accepted_concepts["), i.cast("string"), F.lit("]" + rest))
        sources = F.coalesce(x["source_candidate_ids"], _none())
        return _said(
            *((F.trim(text(x[f])) == "", here(f".{f} is required")) for f in ("id", "label", "description", "merge_rationale")), (~_filled(x["coverage_criteria"]), here(SAYS["no_criteria"])),
            (F.size(sources) == 0, here(SAYS["no_sources"])), (F.exists(sources, lambda y: ~target(y)), here(SAYS["odd_source"])),
        )

    missing = F.array_sort(F.array_except("target_candidate_ids", "_ids"))
    head = _said((F.col("_asg").isNull(), f"{name}.candidate_assignments must be a list"))
    whole = _said(
        (F.size(missing) > 0, F.concat(F.lit(f"{name} must assign every target candidate: "), _listed(missing))),
        (F.size(F.array_distinct("_ids")) < F.size("_ids"), F.concat(F.lit(f"{name} assigns candidates more than once: "), _listed(_repeated(F.col("_ids"))))),
    )
    flat = lambda c, f: F.coalesce(F.flatten(F.transform(c, f)), _none())
    return r.select("scope_id", F.concat(head, flat("_asg", assignment), whole, flat("new_accepted_concepts", concept)).alias("errors"))


def subject_audit_errors(audits: DataFrame, registries: DataFrame, name: str = "subject_merge_quality_audit") -> DataFrame:
    """(scope_id, errors) of audits (scope_id, scores, reliability, flags, repair_plan) against registries (scope_id, candidate_ids)."""
    a = audits.join(registries.select("scope_id", F.col("candidate_ids").alias("_k")), "scope_id", "left").withColumn("_k", F.coalesce("_k", _none()))
    odd = F.array_sort(F.array_except("flags", F.array(*map(F.lit, AUDIT_FLAGS))))
    known = F.col("reliability").isin("reliable", "repair_required")

    def plan(x: Column, i: Column) -> Column:
        here = lambda rest: F.concat(F.lit(f"{name}.repair_plan["), i.cast("string"), F.lit("]"), rest if isinstance(rest, Column) else F.lit(rest))
        reason, unknown = text(x["repair_reason"]), F.array_sort(F.array_except(x["candidate_ids"], F.col("_k")))
        return _said(
            (~reason.isin(*AUDIT_REASONS), here(SAYS["odd_repair"])), (reason.isin(*PAIRED_REASONS) & (F.size(x["candidate_ids"]) < 2), here(F.concat(F.lit(SAYS["one_id"]), reason))),
            (F.size(unknown) > 0, here(F.concat(F.lit(SAYS["odd_ids"]), _listed(unknown)))), (F.trim(text(x["explanation"])) == "", here(SAYS["no_explanation"])),
        )

    head = _said(
        *((~F.coalesce(F.col(f"scores.{f}").between(0, 3), F.lit(False)), f"{name}.scores.{f} must be an integer from 0 to 3") for f in AUDIT_SCORES),
        (~F.coalesce(known, F.lit(False)), f"{name}.reliability must be reliable or repair_required"), (F.col("flags").isNull(), f"{name}.flags must be a list of strings"),
        (F.size(odd) > 0, F.concat(F.lit(f"{name}.flags contains unknown flags: "), _listed(odd))), ((F.col("reliability") == "repair_required") & (F.coalesce(F.size("flags"), F.lit(0)) <= 0), f"{name}.repair_required audits must include at least one flag"),
        (F.col("repair_plan").isNull(), f"{name}.repair_plan must be a list"),
    )
    return a.select("scope_id", F.concat(head, F.coalesce(F.flatten(F.transform("repair_plan", plan)), _none())).alias("errors"))


# ---- what audits and repairs change -----------------------------------------------------------------------------


def repaired_classifications(classified: DataFrame, repaired: DataFrame, artifact: str) -> DataFrame:
    """classified (concept_id, knowledge_type, rationale, confidence, source) with what repaired (concept_id, knowledge_type,
    rationale, confidence) says of some of them; a repair without a confidence leaves it."""
    r = repaired.select("concept_id", *(F.col(c).alias(f"_{c}") for c in ("knowledge_type", "rationale", "confidence")), F.lit(True).alias("_hit"))
    took = F.col("_hit").isNotNull()
    either = lambda c: F.when(took, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return classified.join(r, "concept_id", "left").select("concept_id", either("knowledge_type"), either("rationale"), F.coalesce("_confidence", "confidence").alias("confidence"), F.when(took, "quality_repair").otherwise(F.col("source")).alias("source"), F.when(took, artifact).alias("repair_decision_artifact"))


def guarded(audits: DataFrame, conflicts: DataFrame, flag: str = "cross_segment_conflict") -> DataFrame:
    """audits (scope_id, reliability, flags, planned_concept_ids) under the guardrail that conflicts (scope_id, concept_id) are repaired.

    A scope with conflicts asks for a repair and is flagged; concepts in conflict that no plan has yet are planned, in order.
    """
    found = conflicts.where(text("concept_id") != "").groupBy("scope_id").agg(F.array_sort(F.collect_set("concept_id")).alias("_c"))
    a = audits.join(found, "scope_id", "left")
    has, planned, flags = F.col("_c").isNotNull(), F.coalesce("planned_concept_ids", _none()), F.coalesce("flags", _none())
    return a.select(
        "scope_id", F.when(has, "repair_required").otherwise(F.col("reliability")).alias("reliability"), F.when(has, F.array_union(flags, F.array(F.lit(flag)))).otherwise(flags).alias("flags"),
        F.when(has, F.concat(planned, F.array_except("_c", planned))).otherwise(planned).alias("planned_concept_ids"), F.coalesce("_c", _none()).alias("findings"),
    )


def repair_targets(audits: DataFrame, classified: DataFrame) -> DataFrame:
    """(scope_id, concept_ids): the planned concepts of each audit that classified (scope_id, concept_id) knows, once each, in the plan's order."""
    each = audits.select("scope_id", F.posexplode("planned_concept_ids").alias("_p", "concept_id"))
    kept = each.join(classified.select("scope_id", "concept_id").distinct(), ["scope_id", "concept_id"])
    first = kept.groupBy("scope_id", "concept_id").agg(F.min("_p").alias("_p"))
    return first.groupBy("scope_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "concept_id"))), lambda x: x["concept_id"]).alias("concept_ids"))


def confirmed_repairs(audits: DataFrame, decisions: DataFrame, flag: str = "over_pruned") -> DataFrame:
    """(scope_id, confirmed): scopes flagged before and after for over-pruning alone, whose one repair, made for that
    reason, assigned every target candidate and pruned them all for reasons that confirm it: so the pruning stands.

    audits: scope_id, flags_before, flags_after. decisions: scope_id, repair_reason, target_candidate_ids, candidate_assignments.
    """
    ids = F.transform(F.filter("candidate_assignments", lambda x: text(x["candidate_id"]) != ""), lambda x: x["candidate_id"])
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    whole = (F.size("target_candidate_ids") > 0) & (as_set(F.filter("target_candidate_ids", lambda x: text(x) != "")) == as_set(ids)) & F.forall("candidate_assignments", lambda x: (text(x["status"]) == "pruned") & text(x["reason"]).isin(*CONFIRMING_REASONS))
    one = decisions.groupBy("scope_id").agg(F.count("*").alias("_n"), F.bool_and(whole & (F.col("repair_reason") == flag)).alias("_ok"))
    only = lambda c: as_set(F.coalesce(c, _none())) == F.array(F.lit(flag))
    return audits.join(one, "scope_id", "left").select("scope_id", F.coalesce(only("flags_before") & only("flags_after") & (F.col("_n") == 1) & F.col("_ok"), F.lit(False)).alias("confirmed"))


#: Patterns of workbook labels, and where each may be listed.
LABEL_PATTERNS = ("prerequisite_hint", "lesson_cluster", "application_adjacent_signal", "ignored_ambiguous")
LISTED_AS = {"prerequisite_hint": "active prerequisite hint", "lesson_cluster": "active lesson cluster", "application_adjacent_signal": "audit-only application/adjacent label", "ignored_ambiguous": "ignored label"}


def label_errors(labels: DataFrame, listed: DataFrame, name: str = "workbook_label_interpretation") -> DataFrame:
    """(scope_id, error) of labels (scope_id, label, pattern, rationale, contexts) and of lists made of them (scope_id, pattern, label).

    A label comes once, with a known pattern, a rationale and a context; a list holds labels of its own pattern only.
    """
    shown = F.concat(F.lit(f"{name} label '"), F.coalesce("label", F.lit("None")), F.lit("' "))
    rows = labels.select("scope_id", F.explode(_said(
        (text("label") == "", f"{name}.interpretations[].label is required"), (~F.coalesce(F.col("pattern").isin(*LABEL_PATTERNS), F.lit(False)), F.concat(shown, F.lit("has invalid pattern: "), F.coalesce("pattern", F.lit("None")))),
        (text("rationale") == "", F.concat(shown, F.lit("requires rationale"))), (F.coalesce(F.size("contexts"), F.lit(0)) <= 0, F.concat(shown, F.lit("requires workbook context"))),
    )).alias("error"))
    twice = labels.groupBy("scope_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("label", F.lit("\0"))).alias("d")).where("n <> d").select("scope_id", F.lit(f"{name}.interpretations contains duplicate labels").alias("error"))
    own = labels.groupBy("scope_id", "label").agg(F.collect_set("pattern").alias("_p"))
    of = F.create_map(*(F.lit(x) for kv in LISTED_AS.items() for x in kv))
    wrong = listed.join(own, ["scope_id", "label"], "left").where(~F.coalesce(F.array_contains("_p", F.col("pattern")), F.lit(False)))
    return rows.unionByName(twice).unionByName(wrong.select("scope_id", F.concat(F.try_element_at(of, F.col("pattern")), F.lit(" '"), "label", F.lit("' is not classified as "), "pattern").alias("error")))


def quality_audit_errors(audits: DataFrame, scores: tuple[str, ...], name: str, flags: tuple[str, ...] | None = None) -> DataFrame:
    """(scope_id, errors) of quality audits (scope_id, scores, reliability, findings, and repair_instructions, or with flags
    flags and repair_plan): whole scores from 0 to 3, a known reliability, lists where lists have to be."""
    plan = "repair_instructions" if flags is None else "repair_plan"
    known = F.col("reliability").isin("reliable", "repair_required")
    checks = [(~F.coalesce(F.col(f"scores.{f}").between(0, 3), F.lit(False)), f"{name}.scores.{f} must be an integer from 0 to 3") for f in scores]
    checks.append((~F.coalesce(known, F.lit(False)), f"{name}.reliability must be reliable or repair_required"))
    odd = F.array().cast(_STRINGS)
    if flags is not None:
        checks.append((F.col("flags").isNull(), f"{name}.flags must be a list"))
        odd = F.transform(F.filter(F.coalesce("flags", _none()), lambda x: ~x.isin(*flags)), lambda x: F.concat(F.lit(f"{name}.flags contains unknown flag: "), x))
    tail = _said((F.col("findings").isNull(), f"{name}.findings must be a list"), (F.col(plan).isNull(), f"{name}.{plan} must be a list"), ((F.col("reliability") == "repair_required") & (F.coalesce(F.size(plan), F.lit(0)) <= 0), f"{name}.repair_required requires {plan}"))
    return audits.select("scope_id", F.concat(_said(*checks), odd, tail).alias("errors"))


def depth_findings(cited: DataFrame) -> DataFrame:
    """(scope_id, finding, candidate_id): candidates of concepts (scope_id, concept_id, candidate_id, depth) that were merged
    across depths (over_merged_group), and of those that mix definitions with others (granularity_violation)."""
    of = cited.groupBy("scope_id", "concept_id").agg(F.count("*").alias("_n"), F.count_distinct("depth").alias("_d"), F.bool_or(F.col("depth") == "definition").alias("_plain"))
    wide = of.where("_n >= 2 and _d > 1").select("scope_id", "concept_id", F.when(F.col("_plain"), F.array(F.lit("over_merged_group"), F.lit("granularity_violation"))).otherwise(F.array(F.lit("over_merged_group"))).alias("_f"))
    return cited.join(wide, ["scope_id", "concept_id"]).select("scope_id", F.explode("_f").alias("finding"), "candidate_id")
