"""Checks of extracted candidates, and normal forms of what models answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import role_token, text

#: Roles of a source, and other names for them.
SOURCE_ROLES = ("primary", "supporting", "example", "exercise", "reference")
ROLE_NAMES = {"main": "primary", "core": "primary", "support": "supporting", "examples": "example", "exercises": "exercise", "ref": "reference"}
#: Kinds of labels' knowledge by the plural that answers use.
PLURALS = {"concepts": "conceptual", "procedures": "procedural", "facts": "factual", "applications": "applied"}


def blank(c: Column | str) -> Column:
    return F.trim(text(c)) == ""


def has_text(strings: Column | str) -> Column:
    """Whether an array has a string that is not blank."""
    s = F.col(strings) if isinstance(strings, str) else strings
    return F.coalesce(F.exists(s, lambda x: ~blank(x)), F.lit(False))


def valid_anchors(anchors: Column | str) -> Column:
    """There are anchors, and each has a kind and a locator."""
    a = F.col(anchors) if isinstance(anchors, str) else anchors
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: ~blank(x["kind"]) & ~blank(x["locator"])), F.lit(False))


def compact_anchors(anchors: Column | str, n: int = 5) -> Column:
    """Locators of the first n anchors, blanks left out."""
    a = F.col(anchors) if isinstance(anchors, str) else anchors
    return F.filter(F.transform(F.slice(F.coalesce(a, F.array().cast("array<struct<kind:string,locator:string>>")), 1, n), lambda x: F.trim(text(x["locator"]))), lambda x: x != "")


def canonical_roles(roles: Column | str) -> Column:
    """Roles under their own names, once each, in order."""
    r = F.col(roles) if isinstance(roles, str) else roles
    names = F.create_map(*(F.lit(x) for kv in ROLE_NAMES.items() for x in kv))
    return F.array_distinct(F.transform(r, lambda x: F.coalesce(F.try_element_at(names, role_token(x)), role_token(x))))


def candidate_violations(candidates: DataFrame, connectors: DataFrame, metadata_only: bool = False) -> DataFrame:
    """(self_study_id, candidate_id, violation) of candidates and of connectors between them.

    candidates: self_study_id, candidate_id, label, description, coverage_criteria, source_roles, anchors. connectors:
    self_study_id, from_candidate_id, to_candidate_id, reason.
    """
    row = lambda df, code, subject="candidate_id": df.select("self_study_id", F.col(subject).alias("candidate_id"), F.lit(code).alias("violation"))
    scoped = F.col("candidate_id").startswith(F.concat(F.col("self_study_id"), F.lit("_")))
    known_roles = F.forall("source_roles", lambda x: x.isin(*SOURCE_ROLES))
    checks = [
        row(candidates.where(blank("candidate_id")), "candidate_id is missing"),
        row(candidates.where(~blank("candidate_id") & ~scoped), "candidate_id is not scoped"),
        row(candidates.groupBy("self_study_id", "candidate_id").count().where("count > 1"), "candidate_id is repeated"),
        *(row(candidates.where(blank(c)), f"{c} is missing") for c in ("label", "description")),
        row(candidates.where(~has_text("coverage_criteria")), "coverage_criteria are missing"),
        row(candidates.where(~valid_anchors("anchors")), "anchors are invalid"),
    ]
    if not metadata_only:
        checks.append(row(candidates.where(~F.coalesce((F.size("source_roles") > 0) & known_roles, F.lit(False))), "source_roles are invalid"))
    ids = candidates.select("self_study_id", "candidate_id").distinct()
    for end in ("from_candidate_id", "to_candidate_id"):
        missing = connectors.withColumnRenamed(end, "candidate_id").join(ids, ["self_study_id", "candidate_id"], "left_anti")
        checks.append(row(missing, f"connector {end} is unknown"))
    checks.append(row(connectors.where(F.col("from_candidate_id") == F.col("to_candidate_id")), "connector joins a candidate to itself", "from_candidate_id"))
    checks.append(row(connectors.where(blank("reason")), "connector reason is missing", "from_candidate_id"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def forbidden_keys(rows: DataFrame, key: str, answer: str, forbidden: tuple[str, ...]) -> DataFrame:
    """(key, forbidden_key): top-level keys of a JSON object that must not be there."""
    found = F.array_intersect(F.json_object_keys(answer), F.array(*map(F.lit, forbidden)))
    return rows.select(key, F.explode(found).alias("forbidden_key"))


def classifications(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, label, knowledge_type) out of answers of either shape: rows of label and type, or lists of labels by plural.

    Of a label that is named more than once the last counts.
    """
    listed = answers.select(key, F.posexplode(F.from_json(answer, "classifications array<struct<label string, concept string, knowledge_type string, type string>>")["classifications"]).alias("p", "c"))
    rows = listed.select(key, F.col("p").alias("o"), F.coalesce("c.label", "c.concept").alias("label"), F.lower(F.trim(F.coalesce("c.knowledge_type", "c.type"))).alias("knowledge_type"))
    for i, (plural, kind) in enumerate(PLURALS.items(), 1):
        by = answers.select(key, F.posexplode(F.from_json(answer, f"{plural} array<string>")[plural]).alias("p", "label"))
        rows = rows.unionByName(by.select(key, (F.col("p") + 1_000_000 * i).alias("o"), "label", F.lit(kind).alias("knowledge_type")))
    known = rows.where(~blank("label") & ~blank("knowledge_type"))
    return known.groupBy(key, F.trim("label").alias("label")).agg(F.max_by("knowledge_type", "o").alias("knowledge_type"))


def compare_labels(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, label, problem): labels that an answer leaves out, or adds."""
    lack = expected.select(key, "label").join(found.select(key, "label"), [key, "label"], "left_anti").withColumn("problem", F.lit("missing"))
    more = found.select(key, "label").join(expected.select(key, "label"), [key, "label"], "left_anti").withColumn("problem", F.lit("unknown"))
    return lack.unionByName(more)


def same_segments(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lesson_id, segment_id, problem): where a reordering changed more than the order of segments.

    Both: lesson_id, segment_id, label, concept_ids. Members count as sets.
    """
    side = lambda df, n: df.select("lesson_id", "segment_id", F.struct("label", F.array_sort("concept_ids").alias("m")).alias(n))
    both = side(before, "b").join(side(after, "a"), ["lesson_id", "segment_id"], "full_outer")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unknown").when(F.col("a") != F.col("b"), "changed")
    return both.select("lesson_id", "segment_id", problem.alias("problem")).where("problem is not null")


def scores(audits: DataFrame, columns: tuple[str, ...], high: int = 3) -> DataFrame:
    """audits with scores held within 0 and high, and net_score: the smallest of them."""
    held = {c: F.greatest(F.lit(0), F.least(F.lit(high), F.coalesce(F.col(c).try_cast("int"), F.lit(0)))) for c in columns}
    out = audits.withColumns(held)
    return out.withColumn("net_score", F.least(*columns) if len(columns) > 1 else F.col(columns[0]))
