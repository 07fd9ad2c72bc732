"""Numbers over a whole table without a task that holds all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import text
from corpusloom.operators.rounds import cut

#: Bits of monotonically_increasing_id() that count the rows of a partition.
_ROW_BITS = 33


def id_order(c: Column | str) -> list[Column]:
    """Sort keys of ids: those of digits alone by their numbers, of any length, before all others, which go by their text."""
    v = text(c)
    number = F.when(v.rlike("^[0-9]+$"), F.ltrim(v, F.lit("0")))
    return [number.isNull(), F.length(number), F.coalesce(number, v), v]


def ordinals(rows: DataFrame, *order: Column | str, name: str = "ordinal", start: int = 1) -> DataFrame:
    """rows with name: their number from start on in the whole table's order. Ties are numbered in any order.

    Rows are dealt out by ranges of the order and sorted in each; a range's rows are counted, and each range begins behind
    the rows of those before. What goes through the driver is a count a range. Rows are written once, between the two.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = rows.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    columns = [f"_k{i}" for i in range(len(keys))]
    dealt = named.repartitionByRange(*columns).sortWithinPartitions(*columns).drop(*columns)
    dealt = cut(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}), "ordinals")
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # a row a range
    ends = reduce(lambda out, x: [*out, (x[0], out[-1][1] + x[1])], counts, [(-1, start)])
    before = {k: ends[i][1] for i, (k, _) in enumerate(counts)}
    if not before:
        return dealt.select(*rows.columns, F.lit(None).cast("bigint").alias(name))
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)).cast("map<int,bigint>"), F.col("_range"))
    return dealt.select(*rows.columns, (offset + F.col("_at")).alias(name))


def batch_results(results: DataFrame, key: str = "id") -> DataFrame:
    """A batch's results with ordinal, in the order in which they are reported: numeric ids by number, then the others."""
    return ordinals(results, *id_order(key))
