"""Reduce decisions as tables: which candidates a scope's concepts accept, and what becomes of each candidate.

accepted: scope_id, ord, id, label, description, coverage_criteria, merge_rationale.
sources: scope_id, accepted_id, pos, candidate_id.
assignments: scope_id, ord, candidate_id, status, accepted_ids, merged_into, reason, explanation.
inputs: scope_id, ord, candidate_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import text
from corpusloom.operators.joins import first_wins

#: What may become of a candidate, and why one may be pruned.
STATUSES = ("used_in", "merged_into", "pruned", "review")
PRUNING_REASONS = (
    "duplicate", "near_duplicate", "low_teaching_value", "incidental", "too_narrow", "too_broad", "unrelated", "unsupported_metadata_only", "unsupported_lesson_intent",
)
ADDED = "Deterministically added: no decision named this candidate."


def normalize_assignments(raw: DataFrame) -> DataFrame:
    """Assignments out of parsed answers (scope_id, ord, a variant column answer), whichever of its names a field has."""
    get = lambda *paths: F.coalesce(*(F.try_variant_get("answer", f"$.{p}", "string") for p in paths))
    ids = F.coalesce(*(F.try_variant_get("answer", f"$.{p}", "array<string>") for p in ("accepted_ids", "used_in")), F.array_compact(F.array(get("accepted_id", "used_in"))))
    return raw.select("scope_id", "ord", get("candidate_id", "id").alias("candidate_id"), F.lower(text(get("status", "assignment"))).alias("status"), F.filter(ids, lambda x: F.trim(x) != "").alias("accepted_ids"), get("merged_into", "merge_target").alias("merged_into"), get("reason", "pruning_reason").alias("reason"), get("explanation", "rationale").alias("explanation"))


def canonical_assignments(assignments: DataFrame, sources: DataFrame, inputs: DataFrame, omitted: str = "review") -> DataFrame:
    """One assignment for each input: the first named; a cited candidate without one is used_in where it is cited.

    What is left gets the status omitted: review, or used_in a concept of its own (see standalone).
    """
    first = first_wins(assignments.where(F.trim(text("candidate_id")) != ""), ["scope_id", "candidate_id"], "ord")
    cited = sources.groupBy("scope_id", "candidate_id").agg(F.array_sort(F.collect_set("accepted_id")).alias("cited_by"))
    joined = inputs.select("scope_id", "candidate_id", F.col("ord").alias("input_ord")).join(first, ["scope_id", "candidate_id"], "left").join(cited, ["scope_id", "candidate_id"], "left")
    status = F.coalesce("status", F.when(F.col("cited_by").isNotNull(), "used_in").otherwise(omitted))
    own = F.array(F.concat(F.lit("standalone_"), F.col("candidate_id")))
    ids = F.coalesce("accepted_ids", "cited_by", F.when(F.lit(omitted) == "used_in", own), F.array().cast("array<string>"))
    unnamed = F.col("status").isNull() & F.col("cited_by").isNull()
    return joined.select("scope_id", F.col("input_ord").alias("ord"), "candidate_id", status.alias("status"), ids.alias("accepted_ids"), "merged_into", "reason", F.coalesce("explanation", F.when(unnamed, ADDED)).alias("explanation"))


def standalone(canonical: DataFrame, candidates: DataFrame) -> DataFrame:
    """Accepted concepts (scope_id, id, label, description) of candidates that stand for themselves."""
    alone = canonical.where(F.array_contains("accepted_ids", F.concat(F.lit("standalone_"), F.col("candidate_id"))))
    return alone.join(candidates, ["scope_id", "candidate_id"]).select("scope_id", F.concat(F.lit("standalone_"), F.col("candidate_id")).alias("id"), "label", "description")


def references(assignments: DataFrame) -> DataFrame:
    """(scope_id, candidate_id, accepted_id): the concepts that an assignment of its status refers to."""
    refs = F.when(F.col("status") == "used_in", F.col("accepted_ids")).when((F.col("status") == "merged_into") & (text("merged_into") != ""), F.array("merged_into"))
    return assignments.select("scope_id", "candidate_id", F.explode(refs).alias("accepted_id"))


def decision_violations(accepted: DataFrame, sources: DataFrame, assignments: DataFrame, inputs: DataFrame) -> DataFrame:
    """(scope_id, subject, violation) rows; none for a valid decision.

    What a row shows by itself is checked where it is read. What tables have to agree on is counted over one union of facts by
    candidate, and over another by concept and candidate and from there by concept: three shuffles for all rules.
    """
    blank = lambda c: F.trim(text(c)) == ""
    said = lambda *checks: F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks))))
    times = lambda code, n: F.array_repeat(F.lit(code), F.greatest(F.lit(0), n).cast("int"))
    row = lambda df, subject, violation: df.select("scope_id", F.col(subject).cast("string").alias("subject"), violation.alias("violation"))
    status = F.col("status")
    own = said(*((blank(f), f"{f} is missing") for f in ("label", "description", "merge_rationale")), (~F.coalesce(F.exists("coverage_criteria", lambda x: F.trim(x) != ""), F.lit(False)), "coverage_criteria are missing"))
    given = said(
        (~F.coalesce(status.isin(*STATUSES), F.lit(False)), "status is unknown"), ((status == "used_in") & (F.coalesce(F.size("accepted_ids"), F.lit(0)) <= 0), "accepted_ids are missing"),
        ((status == "merged_into") & blank("merged_into"), "merged_into is missing"), ((status == "pruned") & ~F.coalesce(F.col("reason").isin(*PRUNING_REASONS), F.lit(False)), "reason is unknown"),
        (status.isin("pruned", "review") & blank("explanation"), "explanation is missing"),
    )
    # By candidate: rows of inputs, assignments (dropped ones among them) and sources.
    kind = lambda df, i, a, d, s: df.select("scope_id", "candidate_id", F.lit(i).alias("i"), F.lit(a).alias("a"), d.alias("d"), F.lit(s).alias("s"))
    no = F.lit(0)
    rows = kind(inputs, 1, 0, no, 0).unionByName(kind(assignments, 0, 1, F.when(status.isin("pruned", "review"), 1).otherwise(0), 0)).unionByName(kind(sources, 0, 0, no, 1))
    by = rows.groupBy("scope_id", "candidate_id").agg(*(F.sum(c).alias(c) for c in "iads"))
    known = (F.col("i") > 0) & F.col("candidate_id").isNotNull()
    found = F.explode(F.flatten(F.array(
        times("source is unknown", F.when(~known, F.col("s")).otherwise(0)), times("assigned candidate is unknown", F.when(~known, F.col("a")).otherwise(0)), times("candidate is assigned twice", (F.col("a") > 1).cast("int")),
        times("candidate has no assignment", ((F.col("i") > 0) & ((F.col("a") == 0) | F.col("candidate_id").isNull())).cast("int")), times("dropped candidate is used as evidence", F.when((F.col("s") > 0) & F.col("candidate_id").isNotNull(), F.col("d")).otherwise(0)),
    )))
    # By concept and candidate: references, citations, and the concepts themselves; then what of these a concept has.
    fact = lambda df, r, s, n: df.select("scope_id", "accepted_id", "candidate_id", F.lit(n > 0).alias("own"), F.lit(r).alias("r"), F.lit(s).alias("s"), F.lit(n).alias("n"))
    cast = accepted.select("scope_id", F.col("id").alias("accepted_id"), F.lit(None).cast(sources.schema["candidate_id"].dataType).alias("candidate_id"))
    facts = fact(references(assignments), 1, 0, 0).unionByName(fact(sources, 0, 1, 0)).unionByName(fact(cast, 0, 0, 1))
    per = facts.groupBy("scope_id", "accepted_id", "own", "candidate_id").agg(*(F.sum(c).alias(c) for c in "rsn"))
    of = Window.partitionBy("scope_id", "accepted_id")
    named = F.col("accepted_id").isNotNull()
    per = per.withColumns({"_there": named & (F.sum("n").over(of) > 0), "_has": named & (F.sum("s").over(of) > 0)})
    both = F.flatten(F.array(
        _named(times("source is repeated", (F.col("s") > 1).cast("int")), "candidate_id"), _named(times("referenced concept is unknown", F.when(~F.col("_there"), F.col("r")).otherwise(0)), "accepted_id"),
        _named(times("concept does not cite its candidate", F.when(F.col("_there") & (F.col("s") == 0), F.col("r")).otherwise(0)), "candidate_id"), _named(times("accepted has no source", F.when(~F.col("_has"), F.col("n")).otherwise(0)), "accepted_id"),
        _named(times("accepted id is repeated", ((F.trim(text("accepted_id")) != "") & (F.col("n") > 1)).cast("int")), "accepted_id"),
    ))
    of_concepts = per.select("scope_id", F.explode(both).alias("_x")).select("scope_id", F.col("_x.subject").alias("subject"), F.col("_x.violation").alias("violation"))
    checks = [
        row(accepted.where(blank("id")), "ord", F.lit("accepted id is missing")), row(accepted.withColumn("_v", own), "id", F.col("_v")), row(assignments.withColumn("_v", given), "candidate_id", F.col("_v")), row(by.withColumn("_v", found), "candidate_id", F.col("_v")),
        of_concepts,
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def _named(codes: Column, subject: str) -> Column:
    return F.transform(codes, lambda v: F.struct(F.col(subject).cast("string").alias("subject"), v.alias("violation")))


def combine(accepted: DataFrame, scope: str = "scope_id") -> DataFrame:
    """Concepts of many clusters' decisions in one scope: ids are prefixed with their cluster, so that none clash."""
    return accepted.withColumn("id", F.concat_ws("__", F.col(scope).cast("string"), F.col("id")))


def apply_repair(accepted: DataFrame, replaced: DataFrame, inserted: DataFrame) -> DataFrame:
    """accepted without the replaced ids (scope_id, id), with inserted ones: a merge by key."""
    return accepted.join(replaced, ["scope_id", "id"], "left_anti").unionByName(inserted)


def without_candidates(sources: DataFrame, removed: DataFrame) -> DataFrame:
    """sources without the removed (scope_id, candidate_id); concepts left without a source vanish with them."""
    return sources.join(removed, ["scope_id", "candidate_id"], "left_anti")


def is_manual_repair(errors: Column, markers: tuple[str, ...] = ("must be", "is required", "JSON")) -> Column:
    """format_repair if every error has a format marker, else contextual_repair."""
    every = F.forall(errors, lambda e: e.rlike("|".join(markers)))
    return F.when(every, "format_repair").otherwise("contextual_repair")
