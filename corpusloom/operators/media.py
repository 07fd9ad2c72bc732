"""Gates and choices for books and videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.text import jaccard, markdown_images, text, title_tokens, word_count
from corpusloom.functions.times import timestamps_in
from corpusloom.operators.gate import _set, status_of

#: Caption formats from the best on.
CAPTION_FORMATS = ("vtt", "ttml", "json3", "srv3")
#: Words of messages that ask for a manual step.
MANUAL_MARKERS = ("manual access", "captcha", "login", "sign in", "two-factor")


def video_gate(videos: DataFrame, min_words: int = 80, min_span: float = 0.6, tolerance: float = 5.0, min_title: float = 0.2) -> DataFrame:
    """videos (title, source_title, duration_seconds, markdown, n_empty_chunks) with failures, warnings and status."""
    words, stamps, d = word_count("markdown"), timestamps_in("markdown"), F.col("duration_seconds")
    last = F.array_max(stamps)
    alike = F.when(text("source_title") != "", jaccard(title_tokens("title"), title_tokens("source_title")))
    blank = text("markdown").rlike(r"^\s*$")
    failures = _set(
        (blank, "empty_output"), (F.size(stamps) == 0, "missing_timestamps"), (d <= 0, "invalid_duration"),
        ((d > 120) & (last < d * min_span), "timestamp_span_short"), (F.coalesce("n_empty_chunks", F.lit(0)) > 0, "empty_chunk_output"),
    )
    warnings = _set(
        (~blank & (words < min_words), "short_output"), (d.isNull(), "duration_unknown"), ((d > 0) & (last > d + tolerance), "timestamp_beyond_duration"),
        (alike.isNull(), "source_title_unknown"), (alike < min_title, "title_mismatch"), (markdown_images("markdown") == 0, "no_visual_placeholders"),
    )
    out = videos.withColumns({"failures": failures, "warnings": warnings, "word_count": words, "title_similarity": alike, "max_timestamp_seconds": last})
    return out.withColumn("status", status_of(F.col("failures"), F.col("warnings")))


def book_gate(captures: DataFrame, requested: DataFrame) -> DataFrame:
    """(book_id, status, failures, warnings) of captured pages against the requested ones.

    captures: book_id, page_index, label, pageid, words. requested: book_id, labels (array, in order).
    """
    listed = F.array_sort(F.collect_list(F.struct("page_index", "label")))
    low = F.sort_array(F.collect_list(F.when(F.col("words") < 20, F.concat(F.lit("low_reader_word_count_page_"), F.lpad(F.col("page_index").cast("string"), 4, "0")))))
    pages = captures.groupBy("book_id").agg(F.transform(listed, lambda x: x["label"]).alias("got"), F.count_if(text("pageid") == "").alias("n_missing"), low.alias("low"))
    both = requested.join(pages, "book_id", "left")
    none = F.array().cast("array<string>")
    failures = _set(
        (~F.coalesce("got", none).eqNullSafe(F.coalesce("labels", none)), "page_coverage_mismatch"), (F.col("got").isNull(), "empty_page_manifest"), (F.col("n_missing") > 0, "missing_reader_pageid"),
    )
    warnings = F.array_distinct(F.coalesce("low", none))
    return both.select("book_id", failures.alias("failures"), warnings.alias("warnings")).withColumn("status", status_of(F.col("failures"), F.col("warnings")))


def caption_track(tracks: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """(video_id, language, ext, url): the track to take of tracks (video_id, language, pos, ext, url, translated).

    Originals before translations; then the languages preferred, an exact match before one of the same base; then
    the other languages by name; then the best format, then the first listed.
    """
    base = F.split_part("language", F.lit("-"), F.lit(1))
    rank = F
    for i, p in enumerate(preferred):
        rank = rank.when(F.col("language") == p, 2 * i).when(base == p.split("-")[0], 2 * i + 1)
    rank = rank.otherwise(2 * len(preferred)) if preferred else F.lit(0)
    fmt = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CAPTION_FORMATS)), F.col("ext")), F.lit(0).cast("bigint")), F.lit(99).cast("bigint"))
    best = F.min_by(F.struct("language", "ext", "url"), F.struct(F.coalesce("translated", F.lit(False)), rank, "language", fmt, "pos"))
    return tracks.where(text("url") != "").groupBy("video_id").agg(best.alias("_t")).select("video_id", "_t.*")


def needs_manual_access(content: Column, url: Column) -> Column:
    """The first reason why a reader page needs a person: a login address, a message that says so, or nothing on it."""
    said = F.lower(text(content))
    login = urls.host(url).rlike(r"(^|\.)(login|auth|accounts|sso)\.") | F.lower(urls.path(url)).rlike("/(login|signin|sso)(/|$)")
    return F.when(login, "login_url").when(said.rlike("|".join(MANUAL_MARKERS)) & (word_count(content) < 200), "manual_message").when(F.trim(said) == "", "empty_page")


def is_blank_page(content: Column) -> Column:
    """A page that says that it is left blank."""
    return F.lower(text(content)).rlike(r"(intentionally (left )?blank|página (deixada )?em branco)")


def reader_page_id(url: Column) -> Column:
    """The page in a reader's address, by the forms it can have; else a part of the address's hash."""
    tries = [r"pageid/(\w+)", r"[?&#]pageid=(\w+)", r"/page/(\w+)", r"[?&#]page=(\w+)"]
    found = [F.nullif(F.regexp_extract(text(url), r"(?i)" + p, 1), F.lit("")) for p in tries]
    return F.coalesce(*found, F.left(F.sha2(text(url).cast("binary"), 256), F.lit(12)))


def usage_totals(chunks: DataFrame, key: str, usage: str) -> DataFrame:
    """(key, usage): sums of the values of a map column, entry by entry."""
    sums = chunks.select(key, F.explode(usage).alias("_k", "_v")).groupBy(key, "_k").agg(F.sum("_v").alias("_v"))
    return sums.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("usage"))


def error_summary(errors: DataFrame, message: str) -> DataFrame:
    """(text): how often each message came, as 'Nx message'."""
    return errors.groupBy(message).agg(F.count("*").alias("n")).select(F.concat(F.col("n"), F.lit("x "), F.col(message)).alias("text"))


def run_summary(gates: DataFrame, key: str) -> DataFrame:
    """(status, n, ids): how many of each status, and which, in order of integer ids first."""
    order = F.struct(F.col(key).cast("string").try_cast("bigint").isNull().alias("a"), F.col(key).cast("string").try_cast("bigint").alias("b"), F.col(key).cast("string").alias("c"))
    return gates.groupBy("status").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(order)), lambda x: x["c"]).alias("ids"))


#: Words of titles of Portuguese videos, and languages to prefer.
PORTUGUESE_MARKERS = ("aprender", "forma", "linguagem", "nuvem", "pln", "processamento", "programador", "regulares", "melhor", "express", "vídeo", "video")
PORTUGUESE_FIRST, ENGLISH_FIRST = ("pt", "pt-BR", "pt-PT", "en", "en-US"), ("en", "en-US", "pt", "pt-BR", "pt-PT")


def preferred_languages(title: Column) -> Column:
    """Caption languages from the best on, by a video's title."""
    low = F.lower(text(title))
    return F.when(low.rlike("|".join(PORTUGUESE_MARKERS)), F.array(*map(F.lit, PORTUGUESE_FIRST))).otherwise(F.array(*map(F.lit, ENGLISH_FIRST)))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait, from a number or an HTTP date; null for others."""
    seconds = text(value).try_cast("double")
    date = F.try_to_timestamp(F.regexp_extract(text(value), r"^\w{3}, (\d{1,2} \w{3} \d{4} \d\d:\d\d:\d\d)", 1), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, (F.unix_seconds(date) - F.unix_seconds(now)).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


#: What passing errors of a provider say.
TRANSIENT_MARKERS = ("HTTP 429", "HTTP 503", "request timed out", "request failed", "returned an empty message", "RemoteDisconnected", "IncompleteRead")


def is_transient(message: Column) -> Column:
    return text(message).rlike("|".join(TRANSIENT_MARKERS))


#: Warnings of a transcript by where it is from, and those that have a language.
SOURCE_WARNINGS = {"auto_captions": "auto_captions", "local_whisper": "local_whisper_fallback", "video_ocr": "video_ocr_fallback"}
CAPTION_SOURCES = ("manual_captions", "auto_captions")


def video_warnings(source: Column, language: Column, n_segments: Column, words: Column, duration: Column) -> Column:
    """Warnings of a video's transcript, in order; sparse: no segments, or few words for more than a minute."""
    of = F.create_map(*(F.lit(x) for kv in SOURCE_WARNINGS.items() for x in kv))
    few = (n_segments == 0) | ((duration > 60) & (words < F.greatest(F.lit(15), F.floor(duration / 4))))
    return F.array_compact(F.array(F.try_element_at(of, source), F.when(source.isin(*CAPTION_SOURCES) & (text(language) == ""), "caption_language_unknown"), F.when(F.coalesce(few, F.lit(False)), "sparse_transcript")))
