"""The interface to models, which are external, and stand-ins that answer without one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import any_word, concept_text, text


@dataclass(frozen=True)
class Route:
    """Where a stage's calls go."""

    name: str
    model: str
    thinking: bool = False
    timeout_seconds: int = 600


@dataclass
class Router:
    """Routes by their names and aliases."""

    routes: dict[str, Route]
    aliases: dict[str, str] = field(default_factory=dict)

    def resolve(self, name: str) -> Route:
        known = self.aliases.get(name, name)
        if known not in self.routes:
            raise KeyError(f"no route {name}")
        return self.routes[known]


Answer = Callable[[DataFrame], DataFrame]
Check = Callable[[DataFrame], DataFrame]


def run_stage(prompts: DataFrame, answer: Answer, normalise: Answer, check: Check, repair: Answer | None = None) -> DataFrame:
    """Answers to prompts that hold: normalised and checked, repaired once at most; what still fails stops the stage."""
    found = normalise(answer(prompts))
    wrong = check(found)
    if not wrong.isEmpty() and repair is not None:
        found = normalise(repair(prompts))
        wrong = check(found)
    if not wrong.isEmpty():
        raise ValueError(f"stage is blocked: {[tuple(r) for r in wrong.limit(10).collect()]}")
    return found


#: Words by which the stand-in tells kinds of knowledge, in the order in which they are tried.
KIND_WORDS = {
    "applied": ("apply", "applied", "application", "project", "case"),
    "procedural": ("how to", "step", "steps", "procedure", "implement", "build", "code"),
    "factual": ("date", "history", "name", "fact", "facts"),
}


def classify(label: Column | str, description: Column | str) -> Column:
    t = concept_text(F.concat_ws(" ", text(label), text(description)))
    out = F
    for kind, words in KIND_WORDS.items():
        out = out.when(any_word(t, words), kind)
    return out.otherwise("conceptual")


def stand_in_classification(concepts: DataFrame) -> DataFrame:
    """(concept_id, knowledge_type, confidence) without a model."""
    return concepts.select("concept_id", classify("label", "description").alias("knowledge_type"), F.lit(0.8).alias("confidence"))


def stand_in_extraction(sources: DataFrame) -> DataFrame:
    """One candidate for each source (self_study_id, title, text)."""
    anchor = F.array(F.struct(F.lit("section").alias("kind"), F.lit("start").alias("locator")))
    return sources.select(
        "self_study_id", F.concat(F.col("self_study_id"), F.lit("_001")).alias("candidate_id"), F.col("title").alias("label"), F.left(text("text"), F.lit(200)).alias("description"),
        F.array(F.concat(F.lit("explains "), F.col("title"))).alias("coverage_criteria"), F.array(F.lit("primary")).alias("source_roles"), anchor.alias("anchors"),
    )


#: What the stand-in says of metadata alone.
METADATA_SAYS = {
    "description": "Deterministic workbook-metadata candidate for offline pipeline smoke runs.", "criterion": "Student can summarize the main teaching signal from the workbook row.", "evidence_type": "workbook_metadata",
    "metadata_grounded_rationale": "Offline fixture preserves the workbook row as a candidate.", "granularity_rationale": "One candidate keeps the fixture small while exercising the stage contract.",
}


def stand_in_metadata(studies: DataFrame) -> DataFrame:
    """studies (self_study_id, title) with answer: one candidate for each, as a model would answer in JSON."""
    said = {k: F.lit(v) for k, v in METADATA_SAYS.items()}
    anchor = F.struct(F.lit("workbook_title").alias("kind"), F.lit("Title").alias("locator"))
    reason = F.struct(*(said[k].alias(k) for k in ("metadata_grounded_rationale", "granularity_rationale")))
    candidate = F.struct(
        F.concat(F.lit("metadata-candidate-"), F.col("self_study_id").cast("string"), F.lit("-001")).alias("candidate_id"), F.col("title").alias("label"), said["description"].alias("description"), F.array(said["criterion"]).alias("coverage_criteria"),
        said["evidence_type"].alias("evidence_type"), F.array(anchor).alias("metadata_anchors"), reason.alias("extraction_reason"),
    )
    return studies.withColumn("answer", F.to_json(F.struct(F.array(candidate).alias("candidate_concepts"))))


def stand_in_reduction(inputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, sources, assignments) that take every candidate (scope_id, ord, candidate_id, label, description) as it is."""
    ids = F.concat(F.lit("k_"), F.col("candidate_id"))
    accepted = inputs.select("scope_id", "ord", ids.alias("id"), "label", "description", F.array("label").alias("coverage_criteria"), F.lit("stands for itself").alias("merge_rationale"))
    sources = inputs.select("scope_id", ids.alias("accepted_id"), F.lit(0).alias("pos"), "candidate_id")
    none = F.lit(None).cast("string")
    assignments = inputs.select("scope_id", "ord", "candidate_id", F.lit("used_in").alias("status"), F.array(ids).alias("accepted_ids"), none.alias("merged_into"), none.alias("reason"), none.alias("explanation"))
    return accepted, sources, assignments
