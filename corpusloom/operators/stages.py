"""What stages hand to each other: sources of candidates, sets of passes, tasks, required fields, attempts and signals of audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import text
from corpusloom.operators import joins
from corpusloom.operators.graph import KNOWLEDGE_TYPES
from corpusloom.operators.ordinals import ordinals

_NONE = "array<string>"


def _slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def by_lesson(studies: DataFrame) -> DataFrame:
    """(lesson_id, self_study_ids): self-studies of each lesson in order; those without one are under a blank id."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("ord"), F.col("self_study_id"))))
    return studies.groupBy(text("lesson_id").alias("lesson_id")).agg(F.transform(listed, lambda x: x["self_study_id"]).alias("self_study_ids"))


def candidate_sources(studies: DataFrame, passes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sources of candidates for a lesson's registry: a row for each pass over a body, and one for metadata that is not excluded.

    studies: lesson_id, ord, self_study_id. passes: self_study_id, pass_ord, model_route, artifact_path, candidates.
    metadata: self_study_id, model_route, artifact_path, excluded, candidates. Passes come before metadata.
    """
    space = lambda tail: F.concat(F.lit("c"), F.col("self_study_id"), F.lit("_"), tail)
    of = studies.select(F.col("lesson_id").alias("scope_id"), "lesson_id", F.col("ord").alias("_o"), "self_study_id")
    body = of.join(passes, "self_study_id").select("scope_id", "_o", F.col("pass_ord").alias("_p"), space(_slug(text("model_route"))).alias("namespace"), "artifact_path", "lesson_id", "self_study_id", "model_route", F.lit("source_body").alias("evidence_type"), "candidates")
    rest = of.join(metadata.where("not coalesce(excluded, false)"), "self_study_id").select("scope_id", "_o", F.lit(1_000_000).alias("_p"), space(F.lit("metadata")).alias("namespace"), "artifact_path", "lesson_id", "self_study_id", "model_route", F.lit("metadata_only").alias("evidence_type"), "candidates")
    ord_ = F.row_number().over(Window.partitionBy("scope_id").orderBy("_o", "_p")).alias("ord")
    return body.unionByName(rest).select("scope_id", ord_, "namespace", "artifact_path", "lesson_id", "self_study_id", "model_route", "evidence_type", "candidates")


def subject_sources(lessons: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Sources of candidates for a subject's registry: a row for each lesson (subject_id, ord, lesson_id, title) whose result is
    there. reconciled: lesson_id, artifact_path, artifact_type, concepts (array of structs with reconciled_candidate_id, label, evidence).

    Lessons are numbered in their order, those without a result as well. A result of another type makes the lesson blocked.
    """
    n = F.row_number().over(Window.partitionBy("subject_id").orderBy("ord"))
    number = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    met = lessons.withColumn("namespace", F.concat(F.lit("lr"), number)).join(reconciled, "lesson_id")
    kind = F.lit("lesson_reconciliation")
    candidate = lambda x: F.struct(text(x["reconciled_candidate_id"]).alias("candidate_id"), x["label"].alias("label"), F.flatten(F.array_compact(F.transform(x["evidence"], lambda e: e["anchors"]))).alias("source_anchors"))
    return met.select(
        "subject_id", "ord", "namespace", kind.alias("artifact_type"), "artifact_path", "lesson_id", kind.alias("evidence_type"), F.struct("lesson_id", F.col("title").alias("lesson_title")).alias("source_metadata"),
        F.transform("concepts", candidate).alias("candidates"), (text("artifact_type") != kind).alias("blocked"),
    )


def refs_with_reason(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Pruned candidates (scope_id, ord, candidate_ref, pruning_reason, explanation) by the registry's short ids; null where it has none."""
    of = entries.select("scope_id", "candidate_ref", F.col("compact_id").alias("candidate_id")).groupBy("scope_id", "candidate_ref").agg(F.min("candidate_id").alias("candidate_id"))
    return items.join(of, ["scope_id", "candidate_ref"], "left").select("scope_id", "ord", "candidate_id", "pruning_reason", "explanation")


def compact_lessons(lessons: DataFrame) -> DataFrame:
    """What a prompt is told of lessons."""
    return lessons.select(F.col("lesson_id").alias("id"), "title", "description", "date", "display_code")


def taxonomy(prompt: Column | str) -> Column:
    """Kinds of knowledge to what a prompt's text says of them: `KIND (definition):` at the start of a line. A kind that it does not define is an error."""
    c = F.col(prompt) if isinstance(prompt, str) else prompt
    said = lambda k: F.regexp_extract(c, rf"(?m)^{k.upper()} \(([^)]*)\):", 1)
    there = lambda k: c.rlike(rf"(?m)^{k.upper()} \([^)]*\):")
    each = [x for k in KNOWLEDGE_TYPES for x in (F.lit(k), F.when(there(k), said(k)).otherwise(F.raise_error(F.lit(f"no definition of {k.upper()}"))))]
    return F.create_map(*each)


def extraction_sets(passes: DataFrame) -> DataFrame:
    """(lesson_id, self_study_id, passes, n_passes, n_candidates) of passes (lesson_id, self_study_id, ord, pass_id, n_candidates), in order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "pass_id", "n_candidates")))
    return passes.groupBy("lesson_id", "self_study_id").agg(listed.alias("passes"), F.count("*").alias("n_passes"), F.sum("n_candidates").alias("n_candidates"))


def required_fields(concepts: DataFrame) -> DataFrame:
    """concepts with teaching_description (or else description) and what a stage needs of them lacking, as problem; null for whole ones."""
    description = F.trim(F.coalesce(F.nullif(text("teaching_description"), F.lit("")), text("description")))
    criteria = F.filter(F.transform(F.coalesce("coverage_criteria", F.array().cast(_NONE)), lambda x: F.trim(text(x))), lambda x: x != "")
    problem = F.when(text("concept_id") == "", "concept_id").when(F.trim(text("label")) == "", "label").when(description == "", "teaching description").when(F.size(criteria) == 0, "Coverage Criteria")
    return concepts.select("concept_id", F.trim(text("label")).alias("label"), description.alias("teaching_description"), criteria.alias("coverage_criteria"), problem.alias("problem"))


def classification_tasks(segments: DataFrame, concepts: DataFrame) -> DataFrame:
    """(task, lesson_id, segment_id, concept_ids, unknown) of segments (lesson_id, segment_ord, segment_id, concept_ids): one
    task for each that has concepts, numbered by lesson and place; unknown are ids that concepts lack, which block it.

    """
    ids = F.filter(F.coalesce("concept_ids", F.array().cast(_NONE)), lambda x: text(x) != "")
    kept = segments.withColumn("concept_ids", ids).where(F.size("concept_ids") > 0)
    each = kept.select("lesson_id", "segment_ord", F.explode("concept_ids").alias("concept_id"))
    unknown = joins.unresolved(each, "concept_id", concepts).groupBy("lesson_id", "segment_ord").agg(F.array_sort(F.collect_set("concept_id")).alias("unknown"))
    out = ordinals(kept, "lesson_id", "segment_ord", name="task").join(unknown, ["lesson_id", "segment_ord"], "left")
    return out.select("task", "lesson_id", "segment_id", "concept_ids", F.coalesce("unknown", F.array().cast(_NONE)).alias("unknown"))


def labels_for(interpretations: DataFrame, pattern: str) -> DataFrame:
    """Labels of one pattern, in order."""
    return interpretations.where(F.col("pattern") == pattern).select("label", "ord")


def merge_attempts(decisions: DataFrame, clusters: DataFrame) -> DataFrame:
    """What came of each cluster of two candidates or more: (cluster_id, cluster_label, input_candidate_ids, accepted_labels, outcome).

    decisions: cluster_id, input_candidate_ids, accepted (array of structs with label, source_candidate_ids). merged: some
    concept cites two candidates or more; kept_separate: none does.
    """
    ids = F.filter("input_candidate_ids", lambda x: text(x) != "")
    merged = F.exists("accepted", lambda x: F.coalesce(F.size(x["source_candidate_ids"]) >= 2, F.lit(False)))
    d = decisions.withColumn("input_candidate_ids", ids).where(F.size("input_candidate_ids") >= 2).join(clusters.select("cluster_id", F.col("label").alias("cluster_label")), "cluster_id", "left")
    return d.select("cluster_id", "cluster_label", "input_candidate_ids", F.transform("accepted", lambda x: x["label"]).alias("accepted_labels"), F.when(F.coalesce(merged, F.lit(False)), "merged").otherwise("kept_separate").alias("outcome"))


def review_signals(attempts: DataFrame, pairs: DataFrame, k: int = 24) -> DataFrame:
    """(signal, subject, detail): clusters kept separate, and pairs (left_key, right_key, overlap) of much the same words; the first k of each."""
    apart = attempts.where("outcome = 'kept_separate'").orderBy("cluster_id").limit(k).select(F.lit("same_fine_cluster_kept_separate").alias("signal"), F.col("cluster_id").cast("string").alias("subject"), F.array_join("input_candidate_ids", ",").alias("detail"))
    alike = joins.top_overlaps(pairs, k).select(F.lit("high_text_overlap_concept_pairs").alias("signal"), F.col("left_key").cast("string").alias("subject"), F.col("right_key").cast("string").alias("detail"))
    return apart.unionByName(alike)


def merge_summary(entries: DataFrame, concepts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Numbers of a subject's merge after repairs: candidates, concepts, candidates pruned and to review."""
    one = lambda df, name: df.groupBy("scope_id").agg(F.count("*").alias(name))
    by = assignments.groupBy("scope_id").agg(F.count_if(F.col("status") == "pruned").alias("pruned_candidate_count"), F.count_if(F.col("status") == "review").alias("review_candidate_count"))
    return one(entries, "input_candidate_count").join(one(concepts, "concept_count"), "scope_id", "left").join(by, "scope_id", "left").na.fill(0)


def segment_warnings(lessons: DataFrame, most: int = 5) -> DataFrame:
    """(lesson_id, segment_index, label, concept_count) of segments (array of structs with label, concept_ids) that have so many concepts or more."""
    each = lessons.select("lesson_id", F.posexplode("segments").alias("_p", "_s"))
    n = F.coalesce(F.size("_s.concept_ids"), F.lit(0))
    return each.where(n >= most).select("lesson_id", (F.col("_p") + 1).alias("segment_index"), F.col("_s.label").alias("label"), n.alias("concept_count"))
