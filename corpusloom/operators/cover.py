"""Groupings that must cover their inputs exactly: checks, and repair in order. Order is explicit in every table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.rounds import cut


def stable_unique(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): the different values of each key in the order of their first appearance."""
    firsts = rows.groupBy(key, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))


def duplicates(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values that a key has more than once, with the place of the first repeat and how many there are."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key, value).orderBy(order)))
    return ranked.where("_k > 1").groupBy(key, value).agg(F.min(order).alias("first_repeat"), (F.count("*") + 1).alias("n"))


def compact_ids(rows: DataFrame, namespace: str, order: str) -> DataFrame:
    """rows with compact_id: the namespace and a number from 1 within it, three digits at least."""
    n = F.row_number().over(Window.partitionBy(namespace).orderBy(order))
    return rows.withColumn("compact_id", F.concat(F.col(namespace), F.lit("_"), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0"))))


def repair(members: DataFrame, inputs: DataFrame) -> DataFrame:
    """Memberships (scope_id, cluster_ord, pos, cluster_id, candidate_id) made to cover inputs (scope_id, ord, candidate_id).

    Unknown candidates go, and all but the first membership of each, so emptied clusters go as well. What no cluster
    holds becomes a cluster of its own after the others, in input order, called added_001 and so on; numbers under
    which the scope has a cluster are passed over. Returns scope_id, cluster_id, candidate_id, pos and origin (kept or added).
    """
    place = F.struct("cluster_ord", F.col("pos").cast("bigint").alias("pos"), "cluster_id")
    both = members.select("scope_id", "candidate_id", place.alias("_m"), F.lit(None).cast(inputs.schema["ord"].dataType).alias("ord"), F.lit(False).alias("_in"))
    both = both.unionByName(inputs.select("scope_id", "candidate_id", F.lit(None).cast(both.schema["_m"].dataType).alias("_m"), "ord", F.lit(True).alias("_in")))
    met = cut(both.groupBy("scope_id", "candidate_id").agg(F.min("_m").alias("_m"), F.min("ord").alias("ord"), F.max("_in").alias("_in")).where("_in"), "cover")
    held = "_m is not null and candidate_id is not null and scope_id is not null"  # a null is no member of anything
    kept = met.where(held).select("scope_id", "_m.cluster_id", "candidate_id", "_m.pos", F.lit("kept").alias("origin"))
    added = met.where(f"not ({held})").select("scope_id", "candidate_id", "ord")
    taken = kept.select("scope_id", "cluster_id").distinct().select("scope_id", _generated("cluster_id", "added_").alias("n")).where("n > 0")
    added = numbered_apart(added, taken, "scope_id", "ord", "candidate_id").select("scope_id", generated("added_", F.col("n")).alias("cluster_id"), "candidate_id", F.lit(0).cast("bigint").alias("pos"), F.lit("added").alias("origin"))
    return kept.unionByName(added)


def generated(prefix: str, n: Column) -> Column:
    """A name made of a number, three digits at least."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))


def _generated(name: str, prefix: str) -> Column:
    """The number of a generated name; null for another name, and for one that is not written so."""
    n = F.regexp_extract(name, f"^{prefix}([0-9]{{3,18}})$", 1).try_cast("bigint")
    return F.when(generated(prefix, n) == F.col(name), n)


def numbered_apart(rows: DataFrame, taken: DataFrame, scope: str, *order: str) -> DataFrame:
    """rows with n: from 1 in order within their scope, without the numbers taken (scope, n).

    The j-th number taken, t, has t - j free ones below it, so it is passed over by the rows after these: a running count.
    """
    of = Window.partitionBy(scope)
    if taken.isEmpty():  # nothing to pass over
        return rows.withColumn("n", F.row_number().over(of.orderBy(*order)))
    below = F.col("n") - F.row_number().over(of.orderBy("n"))
    free = taken.select(scope, below.alias("_at"), F.lit(1).alias("_taken"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != scope))
    own = rows.select("*", (F.row_number().over(of.orderBy(*order)) - 1).alias("_at"), F.lit(0).alias("_taken"))
    passed = F.sum("_taken").over(of.orderBy("_at", F.desc("_taken")).rowsBetween(Window.unboundedPreceding, 0))
    both = own.unionByName(free).withColumn("_passed", passed).where("_taken = 0")
    return both.withColumn("n", F.col("_at") + 1 + F.col("_passed")).drop("_at", "_taken", "_passed")


def violations(members: DataFrame, inputs: DataFrame) -> DataFrame:
    """(scope_id, candidate_id, violation): unknown, missing or repeated candidates of a grouping; none for an exact cover."""
    counts = members.groupBy("scope_id", "candidate_id").agg(F.count("*").alias("n"))
    both = counts.join(inputs.select("scope_id", "candidate_id", F.lit(True).alias("known")).distinct(), ["scope_id", "candidate_id"], "full_outer")
    kind = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("scope_id", "candidate_id", kind.alias("violation")).where("violation is not null")


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """rows with batch (from 1) and batch_pos (from 1), size to a batch in order within each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("batch", (F.floor(n / size) + 1).cast("bigint")).withColumn("batch_pos", (n % size + 1).cast("bigint"))
