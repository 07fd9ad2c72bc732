"""Assembly of lessons' and subjects' results out of decisions and the registry, and what the final graph carries beside concepts.

entries: the registry (operators.reduction.registry). accepted: scope_id, ord, id, label, description, coverage_criteria,
merge_rationale. sources: scope_id, accepted_id, pos, candidate_id. assignments: scope_id, ord, candidate_id, status,
accepted_ids, merged_into, reason, explanation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import text
from corpusloom.operators.joins import last_wins

_NONE = "array<string>"
#: Names of subjects that go by a code.
SUBJECT_TITLES = {"COM": "Computacao"}


def _listed(rows: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """Arrays of the values of each key, in order, nulls left out."""
    names = list(values)
    all_ = F.array_sort(F.collect_list(F.struct(*order, *(v.alias(n) for n, v in values.items()))))
    return rows.groupBy(*keys).agg(all_.alias("_l")).select(*keys, *(F.array_compact(F.col(f"_l.{n}")).alias(n) for n in names))


def reconciled(accepted: DataFrame, sources: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each accepted concept: its final id, its sources in order, the roles and kinds of evidence of these (once
    each, in order), and a reference to each of them as evidence."""
    number = F.row_number().over(Window.partitionBy("scope_id").orderBy("ord"))
    final = F.concat(F.lit("reconciled-candidate-"), F.col("scope_id").cast("string"), F.lit("-"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))
    e = entries.select("scope_id", F.col("compact_id").alias("candidate_id"), "source_roles", "evidence_type", "candidate_ref")
    met = sources.join(e, ["scope_id", "candidate_id"])
    parts = _listed(met, ["scope_id", "accepted_id"], ["pos"], source_candidate_ids=F.col("candidate_id"), _roles=F.col("source_roles"), _kinds=F.nullif(text("evidence_type"), F.lit("")), evidence=F.col("candidate_ref"))
    out = accepted.withColumn("reconciled_candidate_id", final).join(parts.withColumnRenamed("accepted_id", "id"), ["scope_id", "id"], "left")
    list_of = lambda c: F.coalesce(c, F.array().cast(_NONE))
    return out.select(
        "scope_id", "ord", "id", "reconciled_candidate_id", "label", "description", list_of(F.col("coverage_criteria")).alias("coverage_criteria"), list_of(F.col("source_candidate_ids")).alias("source_candidate_ids"), "merge_rationale",
        list_of(F.array_distinct(F.flatten("_roles"))).alias("source_roles"), list_of(F.array_distinct("_kinds")).alias("evidence_types"), "evidence",
    )


def dispositions(assignments: DataFrame, found: DataFrame, entries: DataFrame) -> DataFrame:
    """(scope_id, ord, candidate_id, status, final_id, reason, explanation, candidate_ref) of assignments of known candidates.

    final_id: where a merged candidate went: the concept that it names, or else the last that cites it.
    """
    e = entries.select("scope_id", F.col("compact_id").alias("candidate_id"), "candidate_ref")
    by_id = last_wins(found.select("scope_id", F.col("id").alias("merged_into"), "ord", "reconciled_candidate_id"), ["scope_id", "merged_into"], "ord").select("scope_id", "merged_into", F.col("reconciled_candidate_id").alias("_named"))
    cites = found.select("scope_id", "ord", F.explode("source_candidate_ids").alias("candidate_id"), "reconciled_candidate_id")
    by_source = last_wins(cites, ["scope_id", "candidate_id"], "ord").select("scope_id", "candidate_id", F.col("reconciled_candidate_id").alias("_cited"))
    r = assignments.join(e, ["scope_id", "candidate_id"]).join(by_id, ["scope_id", "merged_into"], "left").join(by_source, ["scope_id", "candidate_id"], "left")
    merged = F.col("status") == "merged_into"
    return r.select("scope_id", "ord", "candidate_id", "status", F.when(merged, F.coalesce("_named", "_cited")).alias("final_id"), F.when(F.col("status") == "pruned", F.col("reason")).alias("reason"), F.when(F.col("status").isin("pruned", "review"), F.col("explanation")).alias("explanation"), "candidate_ref")


def reconciliation_summary(entries: DataFrame, found: DataFrame, disposed: DataFrame) -> DataFrame:
    """Numbers of each scope: candidates that came in, concepts that came out, candidates pruned and to review."""
    count = lambda df, name: df.groupBy("scope_id").agg(F.count("*").alias(name))
    by = disposed.groupBy("scope_id").agg(F.count_if(F.col("status") == "pruned").alias("pruned_candidate_count"), F.count_if(F.col("status") == "review").alias("review_candidate_count"))
    return count(entries, "input_candidate_count").join(count(found, "reconciled_candidate_count"), "scope_id", "left").join(by, "scope_id", "left").na.fill(0)


def with_candidates(sources: DataFrame, added: DataFrame) -> DataFrame:
    """sources with candidates added (scope_id, accepted_id, ord, candidate_id) behind those that a concept has; repeats are left out."""
    last = sources.groupBy("scope_id", "accepted_id").agg(F.max("pos").alias("_m"))
    new = added.join(sources.select("scope_id", "accepted_id", "candidate_id"), ["scope_id", "accepted_id", "candidate_id"], "left_anti").groupBy("scope_id", "accepted_id", "candidate_id").agg(F.min("ord").alias("_o"))
    place = F.row_number().over(Window.partitionBy("scope_id", "accepted_id").orderBy("_o", "candidate_id"))
    rows = new.join(last, ["scope_id", "accepted_id"]).select("scope_id", "accepted_id", (F.col("_m") + place).alias("pos"), "candidate_id")
    return sources.select("scope_id", "accepted_id", "pos", "candidate_id").unionByName(rows)


def standing_alone(plans: DataFrame, entries: DataFrame, assigned: DataFrame) -> DataFrame:
    """Concepts (scope_id, id, label, description, candidate_id) for candidates that a plan (scope_id, repair_reason,
    candidate_ids) finds unassigned, that the registry knows and assigned (scope_id, candidate_id) still lacks."""
    wanted = plans.where("repair_reason = 'assignment_incomplete'").select("scope_id", F.explode("candidate_ids").alias("candidate_id")).distinct()
    known = wanted.join(entries.select("scope_id", F.col("compact_id").alias("candidate_id"), "label", "description"), ["scope_id", "candidate_id"])
    fragment = F.regexp_replace(F.regexp_replace(F.lower("candidate_id"), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    return known.join(assigned.select("scope_id", "candidate_id"), ["scope_id", "candidate_id"], "left_anti").select("scope_id", F.concat(F.lit("phase5b_standalone_"), fragment).alias("id"), "label", "description", "candidate_id")


def refs(entries: DataFrame) -> DataFrame:
    """(scope_id, candidate_id, evidence_ref): an entry's reference with what stands behind it: kind, roles, locators."""
    from corpusloom.operators.extraction import compact_anchors

    return entries.select("scope_id", F.col("compact_id").alias("candidate_id"), F.struct("candidate_ref", "evidence_type", "source_roles", compact_anchors("anchors").alias("anchors")).alias("evidence_ref"))


def compact_concepts(found: DataFrame) -> DataFrame:
    """What an audit is shown of concepts: id, label, one line of the description, criteria, how many sources and lessons."""
    line = F.left(F.split_part(F.regexp_replace(F.trim(text("description")), r"(?<=[.!?])\s+", "\u0001"), F.lit("\u0001"), F.lit(1)), F.lit(280))
    return found.select("concept_id", "label", line.alias("description"), "coverage_criteria", F.size("source_candidate_ids").alias("n_sources"), F.size("lesson_ids").alias("n_lessons"))


def runtime_lessons(lessons: DataFrame) -> DataFrame:
    """Lessons as serving needs them: blanks for what is missing; segments (array of structs) with the role teach unless they have one."""
    segment = lambda x: F.struct(x["segment_id"].alias("segment_id"), x["display_code"].alias("display_code"), text(x["label"]).alias("label"), F.coalesce(F.nullif(x["instructional_role"], F.lit("")), F.lit("teach")).alias("instructional_role"), F.coalesce(x["concept_ids"], F.array().cast(_NONE)).alias("concept_ids"), text(x["teaching_notes"]).alias("teaching_notes"))
    return lessons.select("lesson_id", "display_code", "date", text("title").alias("title"), text("description").alias("description"), F.transform("segments", segment).alias("segments"))


def subject_title(subject_id: Column | str) -> Column:
    c = F.coalesce(F.nullif(text(subject_id), F.lit("")), F.lit("Concept Graph"))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SUBJECT_TITLES.items() for x in kv)), c), c)


def subject_metadata(lessons: DataFrame, subject: str, language: str = "pt-BR") -> DataFrame:
    """(subject, title, language, professors): who teaches a subject's lessons, once each, in the lessons' order."""
    named = lessons.where(F.trim(text("professor")) != "").groupBy(F.col(subject).alias("subject_id"), F.trim("professor").alias("_p")).agg(F.min("workbook_row_number").alias("_o"))
    who = named.groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_p"))), lambda x: x["_p"]).alias("professors"))
    every = lessons.select(F.col(subject).alias("subject_id")).distinct()
    return every.join(who, "subject_id", "left").select("subject_id", subject_title("subject_id").alias("title"), F.lit(language).alias("language"), F.coalesce("professors", F.array().cast(_NONE)).alias("professors"))


def source_inventory(studies: DataFrame) -> DataFrame:
    """(source_body_status, n, self_study_ids): what the graph was made from."""
    return studies.groupBy("source_body_status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("self_study_id")).alias("self_study_ids"))


def completion(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(stage, scope_id, status) of expected (stage, scope_id) against artifacts (stage, scope_id, n_errors): complete, invalid or missing."""
    a = artifacts.groupBy("stage", "scope_id").agg(F.max("n_errors").alias("_e"))
    return expected.join(a, ["stage", "scope_id"], "left").select("stage", "scope_id", F.when(F.col("_e").isNull(), "missing").when(F.col("_e") > 0, "invalid").otherwise("complete").alias("status"))


def video_input_tokens(duration: Column | str, fps: Column | float, low_resolution: bool) -> Column:
    """Tokens that a video costs a model, by its length; null where that is not known."""
    #: Tokens of a frame at low and at full resolution, and of a second of sound.
    frame, sound = (66 if low_resolution else 258), 32
    seconds = F.col(duration) if isinstance(duration, str) else duration
    return F.floor(seconds * (sound + F.lit(fps) * frame)).cast("bigint") if not isinstance(fps, Column) else F.floor(seconds * (sound + fps * frame)).cast("bigint")
