"""The source ledger: lessons and self-studies of a workbook with what the corpus index has of each, and its validation.

Workbook rows: workbook_row_number, row_type, title, date, professor, axis, related_subjects, description, week, sort, url,
resource_code, required, grade_weight, parent_class, class_date. Index records: id (of the row), available, status, type,
path, sha256, word_count, bytes, source_markdown, artifact_dir, warnings, failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import plain_slug, split_labels, text
from corpusloom.functions.times import date_slug
from corpusloom.operators.joins import last_wins
from corpusloom.operators.ordinals import ordinals

#: What a self-study's body can be, and how titles of mere activities begin.
USABLE, UNAVAILABLE, EXCLUDED = "usable_source_body", "unavailable_source_body", "excluded_activity_only_self_study"
ACTIVITY_TITLES = ("atividade:", "questão")
#: What is wrong with a self-study, in the order in which it is looked for.
SAYS = {
    "no_id": "self_study_id is required",
    "twice": "self_study_id is duplicated",
    "no_lesson": "lesson_id must reference a lesson",
    "no_title": "workbook_metadata.title is required",
    "no_required": "workbook_metadata.required is required",
    "no_path": "source_body.path is required for usable source bodies",
    "no_file": "source_body.path does not exist: ",
    "other_file": "source_body.sha256 does not match file: ",
    "no_words": "source_body.word_count is required for usable source bodies",
    "not_metadata_only": "metadata_only_candidate must be true for unavailable source bodies",
    "no_failures": "source_body.availability_failures is required for unavailable source bodies",
    "no_reason": "exclusion_reason is required for excluded activity-only self-studies",
    "odd_status": "source_body_status is invalid: ",
}


def lessons(rows: DataFrame) -> DataFrame:
    """Lessons of the rows of type Class, in order: lesson_id (of date and title), display_code, labels and the row's own fields."""
    kept = ordinals(rows.where("row_type = 'Class'"), "workbook_row_number", name="_number")
    number = F.col("_number")
    return kept.select(
        F.concat(F.lit("lesson-"), date_slug("date"), F.lit("-"), plain_slug("title")).alias("lesson_id"), F.concat(F.lit("L"), F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))).alias("display_code"),
        "workbook_row_number", "title", "date", "professor", "axis", split_labels("related_subjects").alias("related_labels"), "description",
    )


def activity_only(title: Column | str, description: Column | str, url: Column | str, resource_code: Column | str) -> Column:
    """A row that names an activity and has nothing to teach from: no description, address or code."""
    low = F.lower(F.trim(text(title)))
    starts = low.startswith(ACTIVITY_TITLES[0]) | low.startswith(ACTIVITY_TITLES[1])
    return starts & (F.trim(text(description)) == "") & (text(url) == "") & (text(resource_code) == "")


def body_status(available: Column, path: Column, activity: Column) -> Column:
    """usable_source_body with an available file; else excluded for mere activities, and unavailable for all others."""
    usable = F.coalesce(available, F.lit(False)) & (text(path) != "")
    return F.when(usable, USABLE).when(activity, EXCLUDED).otherwise(UNAVAILABLE)


def workbook_metadata() -> Column:
    """What a self-study keeps of its workbook row."""
    weight = F.coalesce(F.col("grade_weight").cast("string").try_cast("double"), F.lit(0.0))
    return F.struct(
        "workbook_row_number", "week", "sort", "title", "description", "url", "resource_code", (F.lower(F.trim(text("required"))) == "yes").alias("required"), weight.alias("grade_weight"),
        split_labels("related_subjects").alias("related_labels"), "parent_class", "class_date",
    )


def source_body() -> Column:
    """What the index has of a self-study's body; a row without a record failed for lack of one."""
    none, there = F.array().cast("array<string>"), F.col("_there").isNotNull()
    failures = F.when(there, F.coalesce("_failures", none)).otherwise(F.array(F.lit("missing_extraction_index_record")))
    return F.struct(
        there.alias("index_record_present"), F.col("_type").alias("type"), F.col("_status").alias("status"), F.col("_path").alias("path"), F.col("_sha256").alias("sha256"), F.col("_word_count").alias("word_count"),
        F.col("_bytes").alias("bytes"), F.col("_source_markdown").alias("source_markdown"), F.col("_artifact_dir").alias("artifact_dir"), F.coalesce("_warnings", none).alias("availability_warnings"), failures.alias("availability_failures"),
    )


def self_studies(rows: DataFrame, found: DataFrame, index: DataFrame, prefix: str = "") -> DataFrame:
    """Self-studies of the rows of type Self-study: id, lesson, body status, metadata, body and warnings.

    A row belongs to the lesson with its parent_class as title and its class_date, or else to the one with that title alone
    (of several the last). Index records are keyed by the row's number as text.
    """
    kept = rows.where("row_type = 'Self-study'")
    by_both = last_wins(found.select(F.col("title").alias("parent_class"), F.col("date").alias("class_date"), "lesson_id", "workbook_row_number"), ["parent_class", "class_date"], "workbook_row_number").select("parent_class", "class_date", F.col("lesson_id").alias("_exact"))
    by_title = last_wins(found.select(F.col("title").alias("parent_class"), "lesson_id", F.col("date").alias("_date"), "workbook_row_number"), ["parent_class"], "workbook_row_number").select("parent_class", F.col("lesson_id").alias("_loose"), "_date")
    records = index.select(F.col("id").alias("_id"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in ("available", "status", "type", "path", "sha256", "word_count", "bytes", "source_markdown", "artifact_dir", "warnings", "failures")))
    r = kept.join(by_both, ["parent_class", "class_date"], "left").join(by_title, "parent_class", "left").join(records, F.col("workbook_row_number").cast("string") == F.col("_id"), "left")
    status = body_status(F.col("_available"), F.col("_path"), activity_only("title", "description", "url", "resource_code"))
    other_date = F.col("_exact").isNull() & F.col("_loose").isNotNull() & (text("class_date") != "") & (F.col("class_date") != F.col("_date"))
    return r.select(
        F.concat(F.lit(prefix), F.col("workbook_row_number").cast("string")).alias("self_study_id"), F.coalesce("_exact", "_loose").alias("lesson_id"), status.alias("source_body_status"),
        (status == UNAVAILABLE).alias("metadata_only_candidate"), F.when(status == EXCLUDED, "activity_only_without_teaching_signal").alias("exclusion_reason"), workbook_metadata().alias("workbook_metadata"),
        source_body().alias("source_body"), F.array_compact(F.array(F.when(other_date, "workbook_parent_class_date_mismatch"))).alias("ledger_warnings"),
    )


def summary(studies: DataFrame) -> DataFrame:
    """How many self-studies there are, and how many of each body status."""
    count = lambda s: F.count_if(F.col("source_body_status") == s)
    return studies.agg(F.count("*").alias("self_study_count"), count(USABLE).alias("available_count"), count(UNAVAILABLE).alias("unavailable_count"), count(EXCLUDED).alias("excluded_count"))


def ledger_errors(studies: DataFrame, found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(self_study_id, error) of self-studies; none for a valid ledger.

    files (path, sha256): what there is; without it, paths are not looked up. An id that comes twice is an error of all
    rows but the first in order of their workbook row.
    """
    known = found.select("lesson_id", F.lit(True).alias("_lesson")).distinct()
    s = studies.join(known, "lesson_id", "left")
    body, status, path = F.col("source_body"), F.col("source_body_status"), F.col("source_body.path")
    if files is not None:
        s = s.join(files.select(F.col("path").alias("_p"), F.col("sha256").alias("_sha")), F.col("source_body.path") == F.col("_p"), "left")
    nth = F.row_number().over(Window.partitionBy("self_study_id").orderBy("workbook_metadata.workbook_row_number"))
    s = s.withColumn("_nth", nth)
    usable = status == USABLE
    looked = [] if files is None else [
        (usable & (text(path) != "") & F.col("_p").isNull(), F.concat(F.lit(SAYS["no_file"]), path)),
        (usable & F.col("_p").isNotNull() & ~F.col("_sha").eqNullSafe(body["sha256"]), F.concat(F.lit(SAYS["other_file"]), path)),
    ]
    checks = [
        (text("self_study_id") == "", F.lit(SAYS["no_id"])), ((text("self_study_id") != "") & (F.col("_nth") > 1), F.lit(SAYS["twice"])), (F.col("_lesson").isNull(), F.lit(SAYS["no_lesson"])),
        (text("workbook_metadata.title") == "", F.lit(SAYS["no_title"])), (F.col("workbook_metadata.required").isNull(), F.lit(SAYS["no_required"])),
        (usable & (text(path) == ""), F.lit(SAYS["no_path"])), *looked,
        (usable & (F.coalesce(body["word_count"], F.lit(0)) == 0), F.lit(SAYS["no_words"])),
        ((status == UNAVAILABLE) & ~F.coalesce("metadata_only_candidate", F.lit(False)), F.lit(SAYS["not_metadata_only"])),
        ((status == UNAVAILABLE) & (F.coalesce(F.size(body["availability_failures"]), F.lit(0)) <= 0), F.lit(SAYS["no_failures"])),
        ((status == EXCLUDED) & (text("exclusion_reason") == ""), F.lit(SAYS["no_reason"])),
        (~F.coalesce(status.isin(USABLE, UNAVAILABLE, EXCLUDED), F.lit(False)), F.concat(F.lit(SAYS["odd_status"]), F.coalesce(status, F.lit("null")))),
    ]
    errors = F.array_compact(F.array(*(F.when(c, m) for c, m in checks)))
    return s.select("self_study_id", F.explode(errors).alias("error"))
