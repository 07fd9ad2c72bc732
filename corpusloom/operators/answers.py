"""Normal forms of what models answer: one JSON text a row in, typed columns out. Everything is an expression over the row.

An answer that is no JSON object, or lacks a list that it has to have, gives a problem and null columns, so a caller can
send it to repair; problem is null otherwise. Fields may go by several names; the first that is not blank counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import text
from corpusloom.operators.extraction import canonical_roles

#: Scores of a subject's audit, flags that it may raise, reasons for which it may ask a repair.
AUDIT_SCORES = ("identity_correctness", "granularity_preservation", "provenance_preservation", "assignment_completeness", "overlap_reduction", "subject_coherence", "net_phase5_benefit")
AUDIT_FLAGS = ("assignment_incomplete", "granularity_violation", "missed_obvious_merge", "over_merged_group", "provenance_loss", "repair_unstable", "residual_duplicate")
AUDIT_REASONS = ("assignment_incomplete", "missed_obvious_merge", "over_merged_group", "provenance_loss", "residual_duplicate")
CONFIDENCES = ("high", "medium", "low")

_STRINGS = "array<string>"


def _get(v: Column | str, *names: str, default: str | None = None) -> Column:
    found = F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names))
    return found if default is None else F.coalesce(found, F.lit(default))


def _list(v: Column | str, *names: str, of: str = "string") -> Column:
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", f"array<{of}>") for n in names))


def _none(kind: str = _STRINGS) -> Column:
    return F.array().cast(kind)


def _is_object(v: Column | str) -> Column:
    """Whether a variant is an object; its schema, which would say so too, is made of all that is in it."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def _objects(v: Column | str, *names: str) -> Column:
    """The objects in a list of an answer; null where there is no such list."""
    return F.filter(_list(v, *names, of="variant"), _is_object)


def _fields(objects: Column, *, strings: tuple[str, ...], lists: tuple[str, ...]) -> Column:
    """Variants as structs of these fields, all taken in one pass; blank strings are null."""
    kind = "struct<" + ",".join([f"{f}:string" for f in strings] + [f"{f}:array<string>" for f in lists]) + ">"
    return F.transform(F.transform(objects, lambda x: F.try_variant_get(x, "$", kind)), lambda x: F.struct(*(F.nullif(x[f], F.lit("")).alias(f) for f in strings), *(x[f].alias(f) for f in lists)))


def _unique(ids: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(ids, _none()), lambda x: text(x) != ""))


def parsed(answers: DataFrame, answer: str = "answer", needs: tuple[str, ...] = (), name: str = "model output") -> DataFrame:
    """answers with _v, the parsed answer, and problem: what keeps it from being used. needs: lists that it must have."""
    rows = answers.withColumn("_v", F.try_parse_json(F.col(answer)))
    problem = F.when(~_is_object("_v"), f"{name} must be a JSON object")
    for n in needs:
        problem = problem.when(_list("_v", *n.split("|"), of="variant").isNull(), f"{name} must include {n.split('|')[0]}")
    return rows.withColumn("problem", problem)


def extractions(answers: DataFrame, metadata_only: bool = False) -> DataFrame:
    """answers (self_study_id, answer, ...) with candidates (array of structs), n_candidates, n_connectors, excluded, exclusion_reason and problem.

    Roles of sources get their own names, but for candidates of metadata alone, which have none.
    """
    rows = parsed(answers, needs=("candidate_concepts",))
    roles = lambda x: _none() if metadata_only else F.coalesce(canonical_roles(_list(x, "source_roles")), _none())
    candidate = lambda x: F.struct(*(_get(x, f).alias(f) for f in ("candidate_id", "label", "description")), F.coalesce(_list(x, "coverage_criteria"), _none()).alias("coverage_criteria"), roles(x).alias("source_roles"))
    found = F.transform(_objects("_v", "candidate_concepts"), candidate)
    connectors = F.coalesce(F.size(_list("_v", "source_local_connector_candidates", of="variant")), F.lit(0))
    excluded = F.coalesce(F.try_variant_get("_v", "$.excluded", "boolean"), F.lit(False))
    return rows.select(*answers.columns, found.alias("candidates"), F.coalesce(F.size(_list("_v", "candidate_concepts", of="variant")), F.lit(0)).alias("n_candidates"), F.greatest(connectors, F.lit(0)).alias("n_connectors"), excluded.alias("excluded"), _get("_v", "exclusion_reason").alias("exclusion_reason"), "problem")


def clusters(answers: DataFrame) -> DataFrame:
    """(scope_id, cluster_ord, cluster_id, label, rationale, candidate_ids) of answers (scope_id, answer) without a problem.

    A cluster without an id is numbered; one without a label is called by its id. cover.repair() then makes the clusters
    cover the inputs.
    """
    rows = parsed(answers, needs=("clusters",)).where("problem is null")
    each = rows.select("scope_id", F.posexplode(_objects("_v", "clusters")).alias("_p", "_c"))
    id_ = F.coalesce(_get("_c", "id"), F.format_string("cluster_%03d", F.col("_p") + 1))
    return each.select("scope_id", (F.col("_p") + 1).alias("cluster_ord"), id_.alias("cluster_id"), F.coalesce(_get("_c", "label", "name"), id_).alias("label"), _get("_c", "rationale", "reason", default="").alias("rationale"), F.coalesce(_list("_c", "candidate_ids", "candidates"), _none()).alias("candidate_ids"))


def repairs(answers: DataFrame) -> DataFrame:
    """answers (scope_id, target_candidate_ids, answer, ...) of a lesson's repair: new concepts, additions to existing ones, assignments, and their numbers."""
    rows = parsed(answers)
    filled = F.when(F.size(_list("_v", "new_accepted_concepts", of="variant")) > 0, _objects("_v", "new_accepted_concepts")).otherwise(_objects("_v", "accepted_concepts"))
    concepts = _fields(filled, strings=("id", "label", "description", "merge_rationale"), lists=("coverage_criteria", "source_candidate_ids"))
    assignments = F.transform(
        _fields(_objects("_v", "candidate_assignments"), strings=("candidate_id", "status", "merged_into", "reason", "explanation"), lists=("accepted_ids",)),
        lambda x: F.struct(*(x[f].alias(f) for f in ("candidate_id", "status", "accepted_ids", "merged_into", "reason", "explanation"))),
    )
    additions = F.transform(_fields(_objects("_v", "existing_concept_candidate_additions"), strings=("reconciled_candidate_id", "id"), lists=("candidate_ids",)), lambda x: F.struct(F.coalesce(x["reconciled_candidate_id"], x["id"]).alias("id"), x["candidate_ids"].alias("candidate_ids")))
    out = rows.select(*answers.columns, concepts.alias("new_accepted_concepts"), additions.alias("additions"), assignments.alias("candidate_assignments"), "problem")
    count = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    return out.withColumns({"n_targets": count("target_candidate_ids"), "n_new": count("new_accepted_concepts"), "n_additions": count("additions"), "n_assignments": count("candidate_assignments")})


def subject_audits(answers: DataFrame) -> DataFrame:
    """answers (scope_id, answer, ...) of a subject's audit: flags, repair_plan, missed_merges, reliability, scores and problem.

    Only known flags and reasons stay. A plan without flags raises its reasons as flags, a missed merge (of two candidates
    or more) its own. Whatever is flagged or planned asks for a repair. Scores are held within 0 and 3; one that is no
    whole number is 1 where anything is flagged, else 3; then the net benefit is the lowest of all.
    """
    rows = parsed(answers)
    plan = F.filter(
        F.transform(F.coalesce(_objects("_v", "repair_plan"), _none("array<variant>")), lambda x: F.struct(F.trim(_get(x, "repair_reason", "reason", default="")).alias("repair_reason"), _unique(_list(x, "candidate_ids")).alias("candidate_ids"), F.trim(_get(x, "explanation", "rationale", default="")).alias("explanation"))),
        lambda x: x["repair_reason"].isin(*AUDIT_REASONS),
    )
    sure = lambda x: F.lower(F.trim(_get(x, "confidence", default="")))
    missed = F.filter(
        F.transform(F.coalesce(_objects("_v", "missed_merge_candidates"), _none("array<variant>")), lambda x: F.struct(_unique(_list(x, "candidate_ids")).alias("candidate_ids"), F.when(sure(x).isin(*CONFIDENCES), sure(x)).otherwise("high").alias("confidence"), F.trim(_get(x, "explanation", "rationale", default="")).alias("explanation"))),
        lambda x: F.size(x["candidate_ids"]) >= 2,
    )
    raised = F.array_distinct(F.filter(F.coalesce(_list("_v", "flags"), _none()), lambda x: x.isin(*AUDIT_FLAGS) & (x != "repair_unstable")))
    rows = rows.withColumns({"repair_plan": plan, "missed_merges": missed, "_flags": raised})
    from_plan = F.when(F.size("_flags") > 0, F.col("_flags")).otherwise(F.array_distinct(F.transform("repair_plan", lambda x: x["repair_reason"])))
    rows = rows.withColumn("_flags", from_plan)
    late = F.when((F.size("missed_merges") > 0) & ~F.array_contains("_flags", "missed_obvious_merge"), F.array(F.lit("missed_obvious_merge"))).otherwise(_none())
    rows = rows.withColumn("flags", F.concat("_flags", late))
    wrong = (F.size("flags") > 0) | (F.size("repair_plan") > 0)
    said = F.trim(_get("_v", "reliability", default=""))
    reliability = F.when(wrong | (said == "repair_required"), "repair_required").otherwise("reliable")
    usual = F.when(F.size("flags") > 0, 1).otherwise(3)

    def score(f: str) -> Column:
        at = f"$.scores.{f}"
        whole = F.when(F.schema_of_variant(F.try_variant_get("_v", at, "variant")) == "BIGINT", F.try_variant_get("_v", at, "int")).otherwise(F.try_variant_get("_v", at, "boolean").cast("int"))
        return F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(whole, usual)))

    rows = rows.withColumns({f: score(f) for f in AUDIT_SCORES})
    net = AUDIT_SCORES[-1]
    rows = rows.withColumn(net, F.when(F.size("flags") > 0, F.least(*AUDIT_SCORES)).otherwise(F.col(net)))
    return rows.select(*answers.columns, "flags", "repair_plan", "missed_merges", reliability.alias("reliability"), F.struct(*AUDIT_SCORES).alias("scores"), "problem")


def quality_audits(answers: DataFrame, name: str, with_flags: bool = False) -> DataFrame:
    """answers (scope_id, answer, ...) of an audit of segments or, with_flags, of kinds of knowledge: scores (JSON), reliability,
    findings and repair_instructions, or flags, findings and repair_plan, as lists of JSON texts, and problem.

    Nothing is judged here (see verdicts.quality_audit_errors()): what is not there is an empty object or list.
    """
    rows = parsed(answers, name=f"{name} quality audit output")
    given = lambda f: F.try_variant_get("_v", f"$.{f}", "variant")
    scores_ = F.when(F.schema_of_variant(given("scores")).startswith("OBJECT"), F.to_json(given("scores")))
    listed = lambda f: F.transform(F.coalesce(_list("_v", f, of="variant"), _none("array<variant>")), lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.to_json(x))).alias(f)
    lists = ("flags", "findings", "repair_plan") if with_flags else ("findings", "repair_instructions")
    return rows.select(*answers.columns, F.when(F.col("problem").isNull(), F.coalesce(scores_, F.lit("{}"))).alias("scores"), _get("_v", "reliability").alias("reliability"), *(F.when(F.col("problem").isNull(), listed(f)).alias(f) for f in lists), "problem")


def type_classifications(answers: DataFrame) -> DataFrame:
    """answers (scope_id, answer, ...) with classifications (concept_id, knowledge_type, rationale, confidence as JSON or null) and problem; what is no object is left out."""
    rows = parsed(answers, name="knowledge type classification output")
    field = lambda x, f: F.trim(_get(x, f, default="")).alias(f)
    sure = lambda x: F.nullif(F.to_json(F.try_variant_get(x, "$.confidence", "variant")), F.lit("null")).alias("confidence")
    one = lambda x: F.struct(field(x, "concept_id"), F.lower(field(x, "knowledge_type")).alias("knowledge_type"), field(x, "rationale"), sure(x))
    found = F.transform(F.coalesce(_objects("_v", "classifications"), _none("array<variant>")), one)
    return rows.select(*answers.columns, F.when(F.col("problem").isNull(), found).alias("classifications"), "problem")


def segments(answers: DataFrame) -> DataFrame:
    """answers (lesson_id, answer, ...) with segments (label, concept_ids), blanks taken off, and problem; no list gives none."""
    rows = parsed(answers)
    kept = lambda ids: F.filter(F.transform(F.coalesce(ids, _none()), lambda x: F.trim(text(x))), lambda x: x != "")
    found = F.transform(F.coalesce(_objects("_v", "segments"), _none("array<variant>")), lambda x: F.struct(F.trim(_get(x, "label", default="")).alias("label"), kept(_list(x, "concept_ids")).alias("concept_ids")))
    return rows.select(*answers.columns, F.when(F.col("problem").isNull(), found).alias("segments"), "problem")


def image_analyses(answers: DataFrame) -> DataFrame:
    """answers (url, answer, ...) of image descriptions: original_url, pedagogical_importance, reason, description, transcribed_text.

    An importance that is not known, or no answer at all, is unavailable; an address left out is the one asked for.
    """
    rows = parsed(answers)
    low = F.lower(F.trim(_get("_v", "pedagogical_importance", default="")))
    importance = F.when(F.col("problem").isNull() & low.isin("important", "not_important", "unavailable"), low).otherwise("unavailable")
    field = lambda f: F.trim(_get("_v", f, default="")).alias(f)
    return rows.select(*answers.columns, F.coalesce(F.nullif(F.trim(_get("_v", "original_url", default="")), F.lit("")), F.col("url")).alias("original_url"), importance.alias("pedagogical_importance"), field("reason"), field("description"), field("transcribed_text"))
