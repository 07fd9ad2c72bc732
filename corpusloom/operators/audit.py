"""Audits of reductions: how candidates were accepted, merged and pruned, and what that says about quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import any_word, concept_text

#: Words of set-up and administration.
OFF_LESSON_MARKERS = (
    "pip", "install", "installation", "setup", "environment", "github", "git", "repository", "repo", "license", "licensing", "career", "certificate", "certification", "download",
    "dataset download", "file io", "instalacao", "instalar", "ambiente", "repositorio", "licenca", "carreira", "certificado", "baixar",
)
#: Words that tell how deep a concept goes, in the order in which they are tried.
DEPTH_WORDS = {
    "limitation": ("limitation", "limitations", "limita", "critique", "drawback", "tradeoff", "less effective"),
    "implementation": (
        "countvectorizer", "scikit", "sklearn", "nltk", "keras", "tensorflow", "javascript", "regex", "implement", "implementation", "building", "constructing", "stacking",
        "sequential", "dense", "dropout", "softmax", "sigmoid", "using", "method", "code", "library",
    ),
    "math": ("matrix", "gradient", "derivative", "equation", "formula", "log n df"),
    "application": ("apply", "application", "pipeline", "dataset"),
}


def is_off_lesson(*texts: Column) -> Column:
    return any_word(concept_text(F.concat_ws(" ", *texts), fold=False), OFF_LESSON_MARKERS)


def depth(*texts: Column) -> Column:
    """limitation, implementation, math, application or definition: the first whose words stand in the texts."""
    t = concept_text(F.concat_ws(" ", *texts))
    out = F
    for name, words in DEPTH_WORDS.items():
        out = out.when(any_word(t, words), name)
    return out.otherwise("definition")


def merged_depth(depths: DataFrame, key: str, value: str) -> DataFrame:
    """The depth that all of a key's parts have, mixed if they differ, definition if there are none."""
    g = depths.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    return g.select(key, F.when(F.col("_a").isNull(), "definition").when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("mixed").alias("depth"))


def lesson_audit(assignments: DataFrame, accepted: DataFrame) -> DataFrame:
    """Metrics and flags of each lesson.

    assignments: lesson_id, candidate_id, status (used_in, merged_into, pruned, review), reason, explanation, evidence.
    accepted: lesson_id, concept_id, label, description, n_sources, metadata_only. Ratios are over a lesson's candidates.
    """
    has = lambda status: F.count_if(F.col("status") == status)
    a = assignments.groupBy("lesson_id").agg(
        F.count("*").alias("n"), has("review").alias("n_review"), has("pruned").alias("n_pruned"), has("merged_into").alias("n_merged"),
        F.count_if((F.col("status") == "pruned") & (F.col("reason") == "near_duplicate")).alias("n_near_duplicate_pruned"),
        F.count_if(F.contains(F.lower(F.coalesce("explanation", F.lit(""))), F.lit("deterministically added"))).alias("n_fallback"),
        F.count_if(F.col("evidence") == "source_body").alias("n_source_body"),
    )
    normal = concept_text("label", fold=False)
    c = accepted.withColumn("_label", normal).groupBy("lesson_id").agg(
        F.count("*").alias("n_accepted"), F.max("n_sources").alias("largest"), F.sum("n_sources").alias("n_accepted_sources"), F.count_if("metadata_only").alias("n_metadata_only"),
        F.count_if(is_off_lesson(F.col("label"), F.col("description"))).alias("n_off_lesson"), (F.count("*") - F.count_distinct("_label")).alias("n_same_label"),
    )
    both = a.join(c, "lesson_id", "left").fillna(0)
    part = lambda name: F.when(F.col("n") > 0, F.col(name) / F.col("n")).otherwise(0.0)
    review, pruned, took, merged = part("n_review"), part("n_pruned"), part("n_accepted"), part("n_merged")
    flag = lambda cond, name: F.when(cond, name)
    near = F.col("n_near_duplicate_pruned") > 0
    flags = F.array_sort(F.array_compact(F.array(
        flag(F.col("n_review") > 0, "review_needed"), flag(F.col("n_fallback") > 0, "deterministic_review_fallback"),
        flag(near & (pruned >= 0.25), "questionable_prune"), flag(near & (pruned >= 0.25), "granularity_loss"),
        flag((F.col("n") > 0) & (took < 0.15) & (pruned > 0.5), "over_pruned"),
        flag((F.col("n") >= 5) & (took < 0.25) & (pruned < 0.25) & ((F.col("largest") >= 5) | (merged >= 0.5)), "over_merged"),
        flag(F.col("n_same_label") > 0, "fragmented_duplicates"),
        flag((F.col("n_source_body") > 0) & (F.col("n_metadata_only") >= 2) & (F.col("n_metadata_only") / F.greatest("n_accepted", F.lit(1)) >= 0.5), "metadata_overreach"),
        flag(F.col("n_off_lesson") > 0, "off_lesson_accepted"),
        flag((F.col("n") >= 6) & (took >= 0.85) & (pruned <= 0.05) & (F.col("n_accepted_sources") > 1), "over_accepted"),
    )))
    capped = (review >= 0.2) | ((pruned >= 0.5) & near)
    net = F.greatest(F.lit(0), F.lit(3) - F.size(flags))
    return both.select(
        "lesson_id", "n", "n_accepted", "n_review", "n_pruned", "n_merged", review.alias("review_ratio"), pruned.alias("pruned_ratio"), took.alias("accepted_ratio"), merged.alias("merged_ratio"),
        flags.alias("flags"), F.when(capped, F.least(F.lit(1), net)).otherwise(net).cast("int").alias("net_score"),
    ).withColumn("repair_required", F.col("net_score") <= 1)


def distribution(rows: DataFrame, key: str, value: str, values: tuple[str, ...]) -> DataFrame:
    """How many rows of each key have each of the fixed values, zeros filled in."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(value) == v).alias(f"n_{v}") for v in values), F.count("*").alias("n"))


def conflicts(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, chosen, n_values, conflict): the first value in order wins; more than one different value is a conflict."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias("chosen"), F.count_distinct(value).alias("n_values")).withColumn("conflict", F.col("n_values") > 1)


def subject_guardrails(assigned: DataFrame, cited: DataFrame, inputs: DataFrame, concept_lessons: DataFrame, candidate_lessons: DataFrame) -> DataFrame:
    """(flag, candidate_id): candidates that no assignment or no concept has, and those whose provenance a concept lost.

    assigned, inputs: candidate_id. cited: concept_id, candidate_id. concept_lessons: concept_id, lesson_id, as the concept has
    them; candidate_lessons: candidate_id, lesson_id.
    """
    ids = inputs.select("candidate_id").distinct()
    covered = cited.join(assigned.select("candidate_id").distinct(), "candidate_id", "left_semi").select("candidate_id")
    lacking = ids.join(covered, "candidate_id", "left_anti").select(F.lit("assignment_incomplete").alias("flag"), "candidate_id")
    lessons = lambda df, key: df.groupBy(key).agg(F.sort_array(F.collect_list("lesson_id")).alias("l"))
    expected = lessons(cited.join(candidate_lessons, "candidate_id"), "concept_id").withColumnRenamed("l", "e")
    actual = lessons(concept_lessons, "concept_id").withColumnRenamed("l", "a")
    differ = expected.join(actual, "concept_id", "full_outer").where(~F.col("e").eqNullSafe(F.col("a"))).select("concept_id")
    lost = cited.join(differ, "concept_id", "left_semi").select(F.lit("provenance_loss").alias("flag"), "candidate_id").distinct()
    return lacking.unionByName(lost)
