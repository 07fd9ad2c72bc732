"""Interpretations of labels, kept from run to run: only labels whose contexts changed are interpreted anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import text

#: What a label may be, and what it is where a classifier does not say.
PATTERNS = ("prerequisite_hint", "lesson_cluster", "application_adjacent_signal", "ignored_ambiguous")
UNSAID = "ignored_ambiguous"

STORED = "label string, pattern string, confidence string, rationale string, digest string"


def digests(contexts: DataFrame) -> DataFrame:
    """(label, context_count, digest) of contexts (label, and any other columns), whatever the order of a label's contexts.

    A digest is a count and two sums of hashes, so a label with any number of contexts is pre-aggregated. Blank labels are left out.
    """
    row = F.to_json(F.struct(*sorted(c for c in contexts.columns if c != "label")), {"ignoreNullFields": "false"})
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).bitwiseAND(F.lit((1 << 30) - 1)))
    by = contexts.where(text("label") != "").groupBy("label").agg(F.count("*").alias("context_count"), half(1).alias("_a"), half(2).alias("_b"))
    return by.select("label", "context_count", F.concat_ws("-", "context_count", F.hex("_a"), F.hex("_b")).alias("digest"))


def usable(stored: DataFrame) -> DataFrame:
    """Stored interpretations that may be used again: with a label, a pattern that there is, and a rationale; a label's last by digest."""
    ok = stored.where((text("label") != "") & F.col("pattern").isin(*PATTERNS) & (text("rationale") != ""))
    row = F.struct("pattern", F.coalesce("confidence", F.lit("existing")).alias("confidence"), "rationale", "digest")
    return ok.groupBy("label").agg(F.max_by(row, F.struct("digest", "pattern", "rationale")).alias("_r")).select("label", "_r.*")


def interpreted(contexts: DataFrame, stored: DataFrame, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(label, pattern, confidence, rationale, reused, context_count, digest), a row a label that has contexts.

    A stored interpretation counts if it is usable and its digest is that of the label's contexts, or it has none. All others
    are classified: classify takes their contexts and gives label, pattern, confidence and rationale. Labels without
    contexts are gone. What comes back can be stored for the next run.
    """
    now = digests(contexts)
    met = now.join(usable(stored).withColumnRenamed("digest", "_d"), "label", "left")
    reused = F.col("rationale").isNotNull() & (F.col("_d").isNull() | (F.col("_d") == F.col("digest")))
    kept = met.where(reused).select("label", "pattern", "confidence", "rationale", F.lit(True).alias("reused"), "context_count", "digest")
    left = met.where(~reused).select("label", "context_count", "digest")
    new = classify(contexts.join(left.select("label"), "label", "left_semi")).select("label", *(F.col(c).alias(f"_{c}") for c in ("pattern", "confidence", "rationale")))
    said = left.join(new, "label", "left").select("label", F.coalesce("_pattern", F.lit(UNSAID)).alias("pattern"), F.coalesce("_confidence", F.lit("stubbed")).alias("confidence"), text("_rationale").alias("rationale"), F.lit(False).alias("reused"), "context_count", "digest")
    return kept.unionByName(said)


def interpretation_summary(found: DataFrame) -> DataFrame:
    """One row: how many labels there are, how many were used again and classified, and how many have each pattern."""
    of = lambda c: F.count_if(c).alias
    return found.agg(
        F.count("*").alias("unique_label_count"), of(F.col("reused"))("reused_count"), of(~F.col("reused"))("classified_count"), *(of(F.col("pattern") == p)(f"{p}_count") for p in PATTERNS)
    )
