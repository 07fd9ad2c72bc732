"""Joins of records: ledgers, ranges, nested occurrences, token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import col, jaccard
from corpusloom.operators.rounds import cut, release


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last in order, as an index that is written over has it."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def two_step_lookup(rows: DataFrame, lookup: DataFrame, exact: list[str], fallback: list[str], value: str, order: str) -> DataFrame:
    """rows with value from lookup by the exact key, or else by the fallback key; of repeated keys the last counts."""
    a = last_wins(lookup.select(*exact, value, order), exact, order).select(*exact, F.col(value).alias("_a"))
    b = last_wins(lookup.select(*fallback, value, order), fallback, order).select(*fallback, F.col(value).alias("_b"))
    found = rows.join(a, exact, "left").join(b, fallback, "left")
    return found.select(*rows.columns, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "exact").when(F.col("_b").isNotNull(), "fallback").otherwise("none").alias("matched_by"))


def occurrences(parents: DataFrame, key: str, nested: str, field: str) -> DataFrame:
    """(field, key) pairs of a nested array of structs, once each: the inverted index of occurrences."""
    return parents.select(key, F.explode(nested).alias("_o")).select(F.col(f"_o.{field}").alias(field), key).distinct()


def label_contexts(*groups: tuple[DataFrame, str, str, str]) -> DataFrame:
    """(label, contexts, n): where labels stand, in arrival order. Each group: rows, labels column (array), context, order."""
    rows = None
    for i, (g, labels, context, order) in enumerate(groups):
        one = g.select(F.posexplode(labels).alias("_p", "label"), F.col(context).cast("string").alias("context"), F.lit(i).alias("_g"), F.col(order).cast("bigint").alias("_o"))
        rows = one if rows is None else rows.unionByName(one)
    listed = F.array_sort(F.collect_list(F.struct("_g", "_o", "_p", "context")))
    return rows.groupBy("label").agg(F.transform(listed, lambda x: x["context"]).alias("contexts"), F.count("*").alias("n"))


def overlapping(segments: DataFrame, windows: DataFrame, key: str, start: str, end: str, w_start: str, w_end: str, width: float, closed: bool = True) -> DataFrame:
    """Segments with the windows of the same key that they overlap. Ends are closed, or the end of a window is open.

    Both sides are dealt to cells of the given width, so the join is by equality on (key, cell) and a window meets only
    segments near it; a pair is kept in the first cell that both reach. Segments without a start go to every window.
    """
    cells = lambda a, b: F.sequence(F.floor(a / width).cast("bigint"), F.floor(F.greatest(b, a) / width).cast("bigint"))
    timed = segments.where(F.col(start).isNotNull())
    w = windows.withColumn("_cell", F.explode(cells(F.col(w_start), F.col(w_end)))).withColumnRenamed(key, "_key")
    s = timed.withColumn("_c", F.explode(cells(F.col(start), F.col(end))))
    near = (F.col(end) >= F.col(w_start)) & ((F.col(start) <= F.col(w_end)) if closed else (F.col(start) < F.col(w_end)))
    first = F.greatest(F.floor(F.col(start) / width), F.floor(F.col(w_start) / width))
    met = s.join(w, (s[key] == F.col("_key")) & (F.col("_c") == F.col("_cell")) & near & (F.col("_cell") == first)).drop("_key", "_cell", "_c")
    free = segments.where(F.col(start).isNull()).join(windows.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key")).drop("_key")
    return met.unionByName(free)


def with_next_start(rows: DataFrame, key: str, start: str, order: str, end: str | Column) -> DataFrame:
    """rows with section_end: the next row's start, or for the last the given end."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("section_end", F.coalesce(following, col(end)))


#: Most frequent tokens that are told apart by their frequency; all rarer ones come before them, ordered by hash.
FREQUENT = 20_000


def _classes(rows: DataFrame, key: str, tokens: str, block: str | None) -> DataFrame:
    """(_k, _b, _t, _d): rows with tokens, and a digest that is alike for equal sets of a block."""
    sets = rows.select(F.col(key).alias("_k"), F.col(tokens).alias("_t"), (F.col(block) if block else F.lit("")).alias("_b")).where(F.size("_t") > 0)
    return sets.withColumn("_d", F.md5(F.to_json(F.struct(F.array_sort("_t").alias("t"))).cast("binary")))


def _similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(_b, left_d, right_d, left_first, right_first, overlap): different sets of a block with a Jaccard of at least threshold.

    Equal sets are one, so copies cost nothing. Tokens are hashed to 64 bits and ordered from the rarest; two sets that
    are similar enough share one of the first few (len - ceil(threshold * len) + 1) of each. That makes it an equality
    join, on which lengths, places in the order and a bitmap of 256 bits (their differing bits are at most the tokens
    that differ) rule out most pairs before whole sets meet.
    """
    heads = sets.groupBy("_b", "_d").agg(F.min("_k").alias("_first"), F.first(F.transform("_t", lambda x: F.xxhash64(x))).alias("_h"))
    each = heads.select("_b", "_d", "_first", F.explode("_h").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.shiftright("h", 6).bitwiseAND(3)
    known = each.join(F.broadcast(often), "h", "left").groupBy("_b", "_d").agg(
        F.first("_first").alias("_first"), F.count("*").alias("len"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h"))).alias("_r"),
        *(F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0)).alias(f"m{i}") for i in range(4)),
    )
    taken = F.col("len") - F.ceil(F.lit(threshold) * F.col("len") - 1e-9) + 1
    rows = known.select("_b", "_d", "_first", "len", "m0", "m1", "m2", "m3", F.posexplode(F.slice("_r", F.lit(1), taken.cast("int"))).alias("p", "_x"))
    rows = rows.select("_b", F.col("_x.h").alias("h"), "_d", "_first", "len", "p", "m0", "m1", "m2", "m3")
    side = lambda end: rows.select("_b", "h", *(F.col(c).alias(f"{end}{c}") for c in rows.columns if c not in ("_b", "h")))
    least = F.lit(threshold) / (1 + threshold) * (F.col("llen") + F.col("rlen")) - 1e-9
    ahead = F.least(F.col("llen") - F.col("lp"), F.col("rlen") - F.col("rp"))  # places from 0: the shared token and all after it
    differ = sum((F.bit_count(F.col(f"lm{i}").bitwiseXOR(F.col(f"rm{i}"))) for i in range(4)), F.lit(0))
    met = side("l").join(side("r"), ["_b", "h"]).where((F.col("l_first") < F.col("r_first")) & (F.least("llen", "rlen") >= threshold * F.greatest("llen", "rlen") - 1e-9))
    met = met.where((ahead >= least) & (differ <= F.col("llen") + F.col("rlen") - 2 * least)).select("_b", "l_d", "r_d", "l_first", "r_first").distinct()
    whole = lambda end: known.select("_b", F.col("_d").alias(f"{end}_d"), F.transform("_r", lambda x: x["h"]).alias(f"{end}_t"))
    scored = met.join(whole("l"), ["_b", "l_d"]).join(whole("r"), ["_b", "r_d"]).withColumn("overlap", jaccard("l_t", "r_t"))
    return scored.where(F.col("overlap") >= threshold).select("_b", F.col("l_d").alias("left_d"), F.col("r_d").alias("right_d"), F.col("l_first").alias("left_first"), F.col("r_first").alias("right_first"), "overlap")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key"), "overlap")


def overlap_pairs(rows: DataFrame, key: str, tokens: str, threshold: float, block: str | None = None) -> DataFrame:
    """(left_key, right_key, overlap) of rows of the same block whose token sets have a Jaccard of at least threshold.

    All pairs, those of equal sets included; most_similar() gives the best of them without listing all. Empty sets pair
    with none.
    """
    sets = _classes(rows, key, tokens, block)
    members = sets.select("_b", "_d", "_k")
    near = _similar_sets(sets, threshold)
    across = near.join(members.select("_b", F.col("_d").alias("left_d"), F.col("_k").alias("a")), ["_b", "left_d"]).join(members.select("_b", F.col("_d").alias("right_d"), F.col("_k").alias("b")), ["_b", "right_d"]).select("a", "b", "overlap")
    within = members.withColumnRenamed("_k", "a").join(members.withColumnRenamed("_k", "b"), ["_b", "_d"]).where("a < b").select("a", "b", F.lit(1.0).alias("overlap"))
    return _ordered(across.unionByName(within))


def top_overlaps(pairs: DataFrame, k: int = 24) -> DataFrame:
    """The k most similar pairs, ties by keys."""
    return pairs.orderBy(F.desc("overlap"), "left_key", "right_key").limit(k)


#: Overlaps at which the most similar pairs are looked for before the least that counts.
LEVELS = (0.95, 0.9)


def most_similar(rows: DataFrame, key: str, tokens: str, threshold: float, block: str | None = None, k: int = 24) -> DataFrame:
    """top_overlaps() of overlap_pairs(), without the pairs that cannot be among them.

    A pair of sets stands for all pairs of their members, of which that of the smallest keys comes first: only the k
    first pairs of sets count, and of each set the k + 1 smallest keys. So a set that many rows share costs k + 1 of them.
    Pairs of equal sets come first of all; then LEVELS are tried, from the highest: where k pairs reach a level, none below
    it is among the first, and the higher a level the fewer tokens two sets can differ in, so the less there is to compare.
    """
    sets = _classes(rows, key, tokens, block)
    few = sets.select("_b", "_d", "_k").withColumn("_n", F.row_number().over(Window.partitionBy("_b", "_d").orderBy("_k"))).where(F.col("_n") <= k + 1).drop("_n")
    lists = cut(few.groupBy("_b", "_d").agg(F.array_sort(F.collect_list("_k")).alias("_m")), "lists")
    copies = top_overlaps(lists.where(F.size("_m") > 1).select("_m", F.lit(1.0).alias("overlap"), F.get("_m", F.lit(0)).alias("left_key"), F.get("_m", F.lit(1)).alias("right_key")), k)
    within = copies.select("_m", "overlap", F.explode("_m").alias("a")).select("a", F.explode("_m").alias("b"), "overlap").where("a < b")
    best = cut(top_overlaps(_ordered(within), k), "most-similar")
    side = lambda end: lists.select("_b", F.col("_d").alias(f"{end}_d"), F.col("_m").alias(f"{end}_m"))
    levels = [x for x in LEVELS if x > threshold] + [threshold]
    while levels and best.count() < k:
        near = _similar_sets(sets, levels.pop(0)).select("_b", "left_d", "right_d", F.least("left_first", "right_first").alias("left_key"), F.greatest("left_first", "right_first").alias("right_key"), "overlap")
        across = top_overlaps(near, k).join(side("left"), ["_b", "left_d"]).join(side("right"), ["_b", "right_d"])
        across = across.select(F.explode("left_m").alias("a"), "right_m", "overlap").select("a", F.explode("right_m").alias("b"), "overlap")
        best, before = cut(top_overlaps(_ordered(across.unionByName(within)), k), "most-similar"), best
        release(before)
    release(lists)
    return best


def ordered_union(entries: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): different values of the entries in order; scalars as well as arrays."""
    rows = entries
    if dict(entries.dtypes)[value].startswith("array"):
        rows = entries.select(key, order, F.posexplode(value).alias("_p", "_v"))
    else:
        rows = entries.select(key, order, F.lit(0).alias("_p"), F.col(value).alias("_v"))
    firsts = rows.where("_v is not null").groupBy(key, "_v").agg(F.min(F.struct(order, "_p")).alias("_o"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias("values"))


def unresolved(references: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """References whose key is not known: the referential check."""
    return references.join(known.select(key).distinct(), key, "left_anti")
