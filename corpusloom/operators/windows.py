"""Ordinals and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import col


def display_codes(rows: DataFrame, prefix: Column | str, key: str, order: str, digits: int = 3) -> DataFrame:
    """rows with display_code: a prefix and the place within key, from 1."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("string")
    return rows.withColumn("display_code", F.concat(col(prefix), F.lit("-"), F.lpad(n, F.greatest(F.lit(digits), F.length(n)), F.lit("0"))))


def chunk_windows(spans: DataFrame, key: str, duration: str, longer_than: float, chunk: int, overlap: int, fps: float = 1.0) -> DataFrame:
    """(key, index, start_seconds, end_seconds): sliding windows over each duration.

    Up to longer_than, or for null, one window without ends. Else windows of max(60, chunk) seconds that overlap by at
    most a third; a tail shorter than max(30, min(120, 2 / fps)) belongs to the window before it. Starts are an
    arithmetic row, so windows come from a sequence and not from a loop.
    """
    size = max(60, chunk)
    step = size - max(0, min(overlap, size // 3))
    tail = max(30.0, min(120.0, 2.0 / fps))
    d = F.col(duration)
    # The last window is the first whose end is at the duration or, but for the first window, nearer to it than tail.
    first_full = F.greatest(F.lit(0), F.ceil((d - size) / step))
    near = F.greatest(F.lit(1), F.floor((d - size - tail) / step) + 1)
    last = F.when(d <= size, 0).otherwise(F.least(first_full, near)).cast("int")
    long = spans.where(d > longer_than).select(key, d.alias("_d"), last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    end = F.when(F.col("_i") == F.col("_last"), F.col("_d")).otherwise(F.col("_i") * step + float(size))
    long = long.select(key, (F.col("_i") + 1).cast("bigint").alias("index"), F.round((F.col("_i") * step).cast("double"), 3).alias("start_seconds"), F.round(end, 3).alias("end_seconds"))
    none = F.lit(None).cast("double")
    short = spans.where(d.isNull() | (d <= longer_than)).select(key, F.lit(1).cast("bigint").alias("index"), none.alias("start_seconds"), none.alias("end_seconds"))
    return long.unionByName(short)


def segments_by_size(rows: DataFrame, key: str, order: str, size: int = 4) -> DataFrame:
    """(key, segment_code, label, members): members in order, size to a segment; the label names the first."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    parts = rows.withColumn("_s", F.floor(n / size) + 1).withColumn("_n", n)
    listed = F.array_sort(F.collect_list(F.struct("_n", F.col("label").cast("string").alias("label"))))
    g = parts.groupBy(key, "_s").agg(F.transform(listed, lambda x: x["label"]).alias("members"))
    code = F.concat(F.col(key).cast("string"), F.lit("-S"), F.lpad(F.col("_s").cast("string"), F.greatest(F.lit(2), F.length(F.col("_s").cast("string"))), F.lit("0")))
    label = F.when(F.size("members") > 1, F.concat(F.get("members", F.lit(0)), F.lit(" and related ideas"))).otherwise(F.get("members", F.lit(0)))
    return g.select(key, code.alias("segment_code"), label.alias("label"), "members", (F.size("members") >= 5).alias("large"))


def nearest_step(value: Column | str, ladder: tuple[int, ...], below: bool = False) -> Column:
    """The largest of a ladder that is at most value (below: less than it), else 2."""
    v = col(value)
    fits = [F.when((F.lit(x) < v) if below else (F.lit(x) <= v), x) for x in sorted(ladder)]
    return F.coalesce(F.greatest(*fits, F.lit(None).cast("int")), F.lit(2))
