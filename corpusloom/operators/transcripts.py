"""Captions to timed segments, and what is built of them. Parsing stays in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse_space, containment, jaccard, overlap_tokens, strip, text
from corpusloom.functions.times import section_timestamp, timestamp_label

_STAMP = r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d{1,3})?"


def _seconds(c: Column) -> Column:
    n = F.transform(F.split(c, ":"), lambda x: x.try_cast("double"))
    at = lambda i: F.get(n, F.lit(i))
    return F.when(F.size(n) == 2, at(0) * 60 + at(1)).when(F.size(n) == 3, at(0) * 3600 + at(1) * 60 + at(2))


def strip_markup(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" "))


def from_vtt(files: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, cue, start_seconds, duration_seconds, text) of WebVTT payloads.

    A blank line ends a cue. Its last timing line gives the times, lines before that and header lines don't count. Cues
    without text are dropped, those without timing are untimed.
    """
    cues = files.select(key, F.posexplode(F.split(text(payload), r"(?:\r\n|\r|\n)[ \t]*(?=\r|\n)")).alias("cue", "_b"))
    lines = F.transform(F.split("_b", r"\r\n|\r|\n"), lambda x: F.trim(x))
    is_time = lambda x: x.rlike(rf"^{_STAMP}\s+-->\s+{_STAMP}")
    cues = cues.withColumn("_l", lines).withColumn("_t", F.element_at(F.concat(F.array(F.lit("")), F.filter("_l", is_time)), -1))
    after = F.when(F.col("_t") == "", F.col("_l")).otherwise(F.slice("_l", F.greatest(F.lit(1), F.array_position("_l", F.col("_t")).cast("int")), F.size("_l")))
    said = F.filter(after, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT$|NOTE|STYLE|Kind:|Language:)") & ~x.contains("-->"))
    start = _seconds(F.regexp_extract("_t", rf"^({_STAMP})", 1))
    end = _seconds(F.regexp_extract("_t", rf"-->\s+({_STAMP})", 1))
    out = cues.select(key, "cue", start.alias("start_seconds"), (end - start).alias("duration_seconds"), collapse_space(F.array_join(F.transform(said, strip_markup), " ")).alias("text"))
    return out.where("text <> ''")


def from_json3(files: DataFrame, key: str, payload: str) -> DataFrame:
    """As from_vtt, of JSON3 caption payloads; what is no such JSON has no segments."""
    schema = "events array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>"
    events = files.select(key, F.posexplode(F.from_json(text(payload), schema)["events"]).alias("cue", "_e"))
    said = collapse_space(F.array_join(F.transform("_e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    return events.select(key, "cue", (F.col("_e.tStartMs") / 1000).alias("start_seconds"), (F.col("_e.dDurationMs") / 1000).alias("duration_seconds"), said.alias("text")).where("text <> ''")


def from_captions(files: DataFrame, key: str, payload: str) -> DataFrame:
    """Segments of either format; a payload with neither is one untimed segment of its plain text."""
    is_json = F.trim(text(payload)).startswith("{")
    timed = from_json3(files.where(is_json), key, payload).unionByName(from_vtt(files.where(~is_json), key, payload))
    none = F.lit(None).cast("double")
    rest = files.join(timed.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("cue"), none.alias("start_seconds"), none.alias("duration_seconds"), collapse_space(strip_markup(text(payload))).alias("text"))
    return timed.unionByName(rest.where("text <> ''"))


def as_bullets(segments: DataFrame, key: str) -> DataFrame:
    """(key, markdown): segments in order as a list with time stamps."""
    line = F.concat(F.lit("- "), F.when(F.col("start_seconds").isNull(), "").otherwise(F.concat(F.lit("["), section_timestamp("start_seconds"), F.lit("] "))), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("start_seconds", F.lit(-1.0)).alias("s"), "cue", line.alias("line"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("markdown"))


def near_duplicate(a: Column, b: Column) -> Column:
    """Read texts that say the same: most of the smaller's words in the other, or a high Jaccard; equality if one has none."""
    ta, tb = overlap_tokens(a), overlap_tokens(b)
    either_empty = (F.size(ta) == 0) | (F.size(tb) == 0)
    return F.when(either_empty, F.lower(F.trim(text(a))) == F.lower(F.trim(text(b)))).otherwise((containment(ta, tb) >= 0.9) | (jaccard(ta, tb) >= 0.82))


#: Phrases of English boilerplate that recognisers hear in silence, and the words below which it is all there is.
ENGLISH_BOILERPLATE, TINY_WORDS = ("we'll be right back", "we will be right back", "thanks for watching", "don't forget to subscribe", "music"), 40


def tiny_english_boilerplate(said: Column, words: Column) -> Column:
    low, some = F.lower(said), F.lit(False)
    for phrase in ENGLISH_BOILERPLATE:
        some = some | low.contains(phrase)
    return (words < TINY_WORDS) & some


def _dominant(units: Column) -> Column:
    """The share of the most frequent of a text's units; 0 for none."""
    counts = F.transform(F.array_distinct(units), lambda x: F.size(F.filter(units, lambda y: y == x)))
    return F.when(F.size(units) > 0, F.array_max(counts) / F.size(units)).otherwise(0.0)


def unusable_reasons(said: Column, duration: Column, language: Column) -> Column:
    """Why a recognised text is of no use: empty; too few words for a minute or more; one line or phrase over and over;
    English boilerplate where the preferred language is Portuguese. Nothing for a usable one."""
    words = F.regexp_count(F.lower(text(said)), F.lit(r"[\p{L}\p{M}\p{N}_']+"))
    split = lambda sign: F.filter(F.transform(F.split(F.lower(text(said)), sign), strip), lambda x: x != "")
    lines, phrases = split(r"[\r\n]+"), split(r"[.!?]+")
    over = lambda units: (F.size(units) >= 3) & (_dominant(units) >= 0.75)
    flags = [
        ((duration >= 60) & (words < F.greatest(F.lit(15), F.floor(duration / 4))), "very_low_word_count"), (over(lines), "repeated_lines"), (over(phrases), "repeated_phrase"),
        (text(language).startswith("pt") & tiny_english_boilerplate(text(said), words), "language_mismatch"),
    ]
    return F.when(words == 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*(F.when(c, n) for c, n in flags))))


TRUNCATED = "\n[transcript truncated for this chunk]"


def context(overlaps: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """(keys, context): what is said in each window, of rows that joins.overlapping gives, cut at max_chars."""
    line = F.concat(F.when(F.col("start_seconds").isNull(), "").otherwise(F.concat(F.lit("["), timestamp_label("start_seconds"), F.lit("] "))), collapse_space("text"))
    listed = F.array_sort(F.collect_list(F.struct("cue", line.alias("line"))))
    whole = overlaps.where(F.trim(text("text")) != "").groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("_c"))
    cut = F.concat(F.rtrim(F.left("_c", F.lit(max_chars))), F.lit(TRUNCATED))
    return whole.select(*keys, F.when(F.length("_c") > max_chars, cut).otherwise(F.col("_c")).alias("context"))


def without_repeats(frames: DataFrame, key: str, order: str) -> DataFrame:
    """frames (key, order, text) without those that repeat the last one kept, of each key in order.

    What is kept depends on what was kept before, so a key's frames are read in order by one task: frames of one video.
    Exact repeats of the frame before go first, without that.
    """
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy(key).orderBy(order))
    some = frames.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("text"))).drop("_before")

    def tokens(said: str) -> set[str]:
        return set(re.findall(r"[\w']+", said.lower()))

    def keep(found: pd.DataFrame) -> pd.DataFrame:
        last, rows = None, []
        for i, said in zip(found.sort_values(order).index, found.sort_values(order)["text"].fillna("")):
            a, b = (tokens(last), tokens(said)) if last is not None else (set(), set())
            both = len(a & b)
            same = last is not None and (said.strip().lower() == last.strip().lower() if not a or not b else both / min(len(a), len(b)) >= 0.9 or both / len(a | b) >= 0.82)
            if not same:
                last = said
                rows.append(i)
        return found.loc[rows]

    return some.groupBy(key).applyInPandas(keep, some.schema)
