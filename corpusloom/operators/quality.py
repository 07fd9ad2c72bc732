"""The quality audit of a subject's merge: flags, scores, numbers and a plan of repairs.

entries: scope_id, ord, candidate_id, depth. concepts: scope_id, ord, concept_id. sources: scope_id, concept_id, pos, candidate_id.
assignments: scope_id, candidate_id. expected and actual: scope_id, concept_id, occurrences, as operators.changes.provenance() gives
them; actual is what the result says. duplicates: scope_id, ord, candidate_ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import text

#: Flags in the order in which they are given, what each takes from a score, and what its repair is told.
FLAGS = ("assignment_incomplete", "provenance_loss", "over_merged_group", "granularity_violation", "residual_duplicate")
SCORES = {
    "identity_correctness": ("over_merged_group", 1), "granularity_preservation": ("granularity_violation", 1), "provenance_preservation": ("provenance_loss", 0), "assignment_completeness": ("assignment_incomplete", 0),
    "overlap_reduction": ("residual_duplicate", 1),
}
BEST, SOME_FLAG = 3, 2
WHY = {
    "assignment_incomplete": "Every lesson-local concept must be assigned; missing candidates become standalone.",
    "provenance_loss": "Concept occurrences do not match lesson-local source provenance.",
    "over_merged_group": "A merged concept crosses depth bands or added teachable behavior.",
    "residual_duplicate": "Two surviving subject concepts look like duplicate definitions.",
}
DEPTHS = ("implementation", "limitation", "math", "application")


def occurrence_keys(occurrences: Column | str) -> Column:
    """What of occurrences has to agree: lessons, sources, kinds of evidence and depth, in order."""
    c = F.col(occurrences) if isinstance(occurrences, str) else occurrences
    none = F.array().cast("array<string>")
    key = lambda x: F.to_json(F.struct(x["lesson"]["lesson_id"].alias("l"), F.coalesce(x["source_candidate_ids"], none).alias("s"), F.coalesce(x["evidence_types"], none).alias("e"), text(x["depth"]).alias("d")))
    return F.transform(c, key)


def findings(entries: DataFrame, concepts: DataFrame, sources: DataFrame, assignments: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(scope_id, flag, at, candidate_id): candidates that an audit names, with their place; a candidate can come more than once.

    Candidates are counted once (as entries, assignments and sources), concepts once (their sources, bands and provenance).
    """
    band = F.when(F.col("depth").isin(*DEPTHS), F.col("depth")).otherwise("definition")
    kind = lambda df, e, a, s, o: df.select("scope_id", "candidate_id", F.lit(e).alias("e"), F.lit(a).alias("a"), F.lit(s).alias("s"), o.cast("bigint").alias("o"))
    no = F.lit(None)
    by = _union(kind(entries, 1, 0, 0, F.col("ord")), kind(assignments.where(text("candidate_id") != ""), 0, 1, 0, no), kind(sources, 0, 0, 1, no)).groupBy("scope_id", "candidate_id").agg(*(F.max(c).alias(c) for c in "eas"), F.min("o").alias("o"))
    missing = by.where("e = 1 and (a = 0 or s = 0)").select("scope_id", F.lit(FLAGS[0]).alias("flag"), F.struct(F.col("o").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("at"), "candidate_id")
    cited = sources.join(entries.select("scope_id", "candidate_id", band.alias("_band")), ["scope_id", "candidate_id"]).join(concepts.select("scope_id", "concept_id", F.col("ord").cast("bigint").alias("_o")), ["scope_id", "concept_id"])
    per = cited.groupBy("scope_id", "concept_id").agg(F.count("*").alias("_n"), F.count_distinct("_band").alias("_d"), F.bool_or(F.col("_band") == "definition").alias("_plain"))
    of = ["scope_id", "concept_id"]
    told = expected.select(*of, occurrence_keys("occurrences").alias("_e")).join(actual.select(*of, occurrence_keys("occurrences").alias("_a")), of, "full_outer")
    lost = told.where(~F.col("_e").eqNullSafe(F.col("_a"))).select(*of, F.lit(True).alias("_lost"))
    wide = (F.col("_n") >= 2) & (F.col("_d") > 1)
    per = per.join(lost, of, "left").withColumn("_flags", F.array_compact(F.array(F.when(F.col("_lost"), FLAGS[1]), F.when(wide, FLAGS[2]), F.when(wide & F.col("_plain"), FLAGS[3]))))
    each = cited.join(per.where(F.size("_flags") > 0).select(*of, "_flags"), of)
    return missing.unionByName(each.select("scope_id", F.explode("_flags").alias("flag"), F.struct(F.col("_o").alias("a"), F.col("pos").cast("bigint").alias("b")).alias("at"), "candidate_id"))


def _union(*rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def merge_audits(entries: DataFrame, concepts: DataFrame, sources: DataFrame, assignments: DataFrame, expected: DataFrame, actual: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(scope_id, flags, reliability, scores, metrics, repair_plan), a row for each scope that has entries, concepts or assignments.

    All numbers and flags come from one aggregation over facts by grouping sets: a scope's, and those of each of its flags.
    """
    found = findings(entries, concepts, sources, assignments, expected, actual).groupBy("scope_id", "flag", "candidate_id").agg(F.min("at").alias("at"))
    string, place = F.lit(None).cast("string"), "struct<a: bigint, b: bigint>"
    widest = sources.groupBy("scope_id", "concept_id").agg(F.count("*").alias("_n"))
    fact = lambda df, what, flag=string, n=F.lit(1), at=F.lit(None).cast(place), ids=F.lit(None).cast("array<string>"): df.select("scope_id", F.lit(what).alias("what"), flag.alias("flag"), n.cast("bigint").alias("n"), at.alias("at"), ids.alias("ids"))
    pair_at = F.struct(F.col("ord").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).cast(place)
    facts = _union(
        fact(entries, "entry"), fact(concepts, "concept"), fact(assignments, "assignment"), fact(widest, "width", n=F.col("_n")), fact(found, "found", F.col("flag"), at=F.col("at").cast(place), ids=F.array(F.col("candidate_id").cast("string"))),
        fact(duplicates, "found", F.lit(FLAGS[4]), at=pair_at, ids=F.transform("candidate_ids", lambda x: x.cast("string"))),
    )
    of = lambda what: F.count_if(F.col("what") == what)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == "found", F.struct("at", "ids")))), lambda x: x["ids"])
    sets = facts.groupingSets([["scope_id"], ["scope_id", "flag"]], "scope_id", "flag").agg(
        F.grouping("flag").alias("_whole"), of("entry").alias("entries"), of("concept").alias("concepts"), of("assignment").alias("assignments"), F.max(F.when(F.col("what") == "width", F.col("n"))).alias("widest"), of("found").alias("found"), listed.alias("ids")
    )
    plan = F.when(F.col("flag") == FLAGS[4], F.transform("ids", lambda x: F.struct(F.lit(FLAGS[4]).alias("repair_reason"), x.alias("candidate_ids"), F.lit(WHY[FLAGS[4]]).alias("explanation"))))
    for flag in FLAGS[:3]:
        plan = plan.when(F.col("flag") == flag, F.array(F.struct(F.lit(flag).alias("repair_reason"), F.flatten("ids").alias("candidate_ids"), F.lit(WHY[flag]).alias("explanation"))))
    rank = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("flag"))
    flagged = (F.col("_whole") == 0) & F.col("flag").isNotNull()
    whole = lambda c: F.max(F.when(F.col("_whole") == 1, F.col(c)))
    count = lambda flag: F.coalesce(F.max(F.when(flagged & (F.col("flag") == flag), F.col("found"))), F.lit(0))
    by = sets.withColumn("_plan", plan).groupBy("scope_id").agg(
        *(whole(c).alias(c) for c in ("entries", "concepts", "assignments", "widest")), F.array_sort(F.collect_list(F.when(flagged, F.struct(rank.alias("r"), F.col("flag").alias("f"), F.col("_plan").alias("p"))))).alias("_f"),
        count(FLAGS[0]).alias("missing"), count(FLAGS[1]).alias("lost"),
    )
    flags = F.transform("_f", lambda x: x["f"])
    scores = {name: F.when(F.array_contains(flags, flag), low).otherwise(BEST) for name, (flag, low) in SCORES.items()}
    scores["subject_coherence"] = F.when(F.size(flags) > 0, SOME_FLAG).otherwise(BEST)
    scores["net_phase5_benefit"] = F.least(*scores.values())
    metrics = F.struct(
        F.col("entries").alias("input_candidate_count"), F.col("concepts").alias("concept_count"), F.col("assignments").alias("assignment_count"), F.col("missing").alias("missing_assignment_count"),
        F.col("lost").alias("provenance_loss_candidate_count"), F.coalesce("widest", F.lit(0)).alias("largest_concept_source_count"),
    )
    return by.select(
        "scope_id", flags.alias("flags"), F.when(F.size(flags) > 0, "repair_required").otherwise("reliable").alias("reliability"), F.struct(*(c.alias(n) for n, c in scores.items())).alias("scores"), metrics.alias("metrics"),
        F.flatten(F.array_compact(F.transform("_f", lambda x: x["p"]))).alias("repair_plan"),
    )
