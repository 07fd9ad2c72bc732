"""Gates over content: flags, gate status, blocking, and reports on what passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import markdown_images, strip, text, word_count

MIN_WORDS, MAX_WORDS, MAX_IMAGES, AUTH_WORDS, ERROR_WORDS, PROBE_CHARS = 150, 35_000, 150, 1200, 1000, 4000

#: Phrases of error pages, pay walls, boilerplate, bot walls and login walls.
ERROR_PHRASES = (
    "page not found", "not found", "deleted by author", "access denied", "forbidden", "unauthorized", "service unavailable", "bad gateway", "gateway timeout", "too many requests",
    "rate limit", "captcha", "cloudflare", "blocked", "just a moment", "security verification", "not a bot", "enable javascript", "enable cookies",
)
PAYWALL_PHRASES = (
    "paywall", "subscriber-only", "members-only", "member-only", "premium article", "subscribe to continue", "sign in to continue", "login to continue",
    "create an account to continue", "upgrade to continue", "reading limit", "free member-only story", "this story is for members",
)
BOILERPLATE_PHRASES = (
    "advertisement", "cookie policy", "privacy preferences", "related articles", "recommended for you", "write for us", "newsletter", "subscribe to our",
    "terms of content use", "do not sell or share my personal information",
)
BOT_WALL_PHRASES = ("cloudflare", "captcha", "security check", "security verification", "just a moment", "verify you are human", "blocked by", "enable cookies", "enable javascript")
AUTH_WALL_PHRASES = ("sign in", "log in", "required to access", "unauthorized", "authentication required", "subscribe to continue", "join medium")
#: What keeps a source out of the corpus.
BLOCKED_STATUSES = ("failed_gate", "needs_manual", "failed", "acquisition_failed")
BLOCKING_FAILURES = (
    "manual_access_required", "auth_wall_detected", "error_page_detected", "http_status_401", "http_status_403", "http_status_404", "http_status_410", "metadata_error", "acquisition_failed",
)


def has_phrase(low: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a lower-cased text has one of the phrases between word boundaries; plain searches rule most texts out."""
    some = F.lit(False)
    for p in phrases:
        some = some | low.contains(p)
    return some & low.rlike(r"\b(" + "|".join(phrases) + r")\b")


def _set(*flags: tuple[Column, Column | str]) -> Column:
    """Names of the flags that hold, sorted, once each."""
    named = [F.when(c, F.lit(n) if isinstance(n, str) else n) for c, n in flags]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))


#: How notes of a route begin that are flags of what it brought.
NOTED = {"github_blob_pdf": "rewritten_source_url", "pdf_mode_ocr": "ocr_pdf"}


def _noted(notes: Column) -> Column:
    def has(start: str) -> Column:
        return F.coalesce(F.exists(notes, lambda n: n.startswith(start)), F.lit(False))

    return F.array_compact(F.array(*(F.when(has(start), flag) for start, flag in NOTED.items())))


def with_flags(rows: DataFrame, content: str, requested_title: Column, found_title: Column, strategy: Column, min_words: int = MIN_WORDS, route_notes: Column | None = None) -> DataFrame:
    """rows with flags: sorted flags of a content; walls and error pages are sought in titles and the first part of it.

    route_notes: an array of how the content was fetched, of which some are flags too.

    What several flags look at (the trimmed text, its lower case, its words, the probe) is a column of its own below
    them, so it is made once a row.
    """
    r = rows.withColumns({"_body": strip(text(content)), "_titles": F.concat_ws("\n", text(found_title), text(requested_title)), "_strategy": text(strategy)})
    r = r.withColumns({"_words": word_count("_body"), "_low": F.lower("_body"), "_images": markdown_images("_body")})
    r = r.withColumn("_probe", F.concat_ws("\n", F.lower("_titles"), F.left("_low", F.lit(PROBE_CHARS))))
    body, words, low, probe = F.col("_body"), F.col("_words"), F.col("_low"), F.col("_probe")
    flags = _set(
        (body == "", "empty_content"),
        ((body != "") & (words < min_words), "short_content"),
        (words > MAX_WORDS, "very_long_content"),
        (F.col("_images") > MAX_IMAGES, "many_images"),
        (has_phrase(probe, ERROR_PHRASES), "looks_like_error_page"),
        (has_phrase(probe, PAYWALL_PHRASES), "possible_paywall"),
        (has_phrase(low, BOILERPLATE_PHRASES), "possible_boilerplate"),
        (has_phrase(probe, BOT_WALL_PHRASES), "possible_bot_wall"),
        ((words < AUTH_WORDS) & has_phrase(probe, AUTH_WALL_PHRASES), "possible_auth_wall"),
        (F.col("_strategy") == "interactive_shell", "interactive_shell_review"),
    )
    if route_notes is not None:
        flags = F.array_sort(F.array_union(flags, _noted(route_notes)))
    return r.withColumn("flags", flags).drop("_body", "_titles", "_strategy", "_words", "_low", "_images", "_probe")


def status_of(failures: Column, warnings: Column) -> Column:
    return F.when(F.size(failures) > 0, "failed_gate").when(F.size(warnings) > 0, "passed_with_warnings").otherwise("passed")


def gate(pages: DataFrame) -> DataFrame:
    """pages (content, title, status_code, content_type, strategy, screenshot_blank) with failures, warnings and status."""
    staged = pages.withColumns({"word_count": word_count("content"), "_title": F.lower(text("title")), "_head": F.lower(F.left(text("content"), F.lit(PROBE_CHARS)))})
    staged = staged.withColumn("_probe", F.concat_ws("\n", "_title", "_head"))
    title, probe, words = F.col("_title"), F.col("_probe"), F.col("word_count")
    kind = F.lower(text("content_type"))
    pdf = text("strategy") == "pdf"
    failures = _set(
        (~F.col("status_code").between(200, 299), F.concat(F.lit("http_status_"), F.col("status_code").cast("string"))),
        (has_phrase(probe, BOT_WALL_PHRASES), "bot_wall_detected"),
        (has_phrase(probe, AUTH_WALL_PHRASES) & (words < AUTH_WORDS), "auth_wall_detected"),
        (has_phrase(probe, ERROR_PHRASES) & (words < ERROR_WORDS), "error_page_detected"),
        (F.coalesce("screenshot_blank", F.lit(False)), "blank_or_unreadable_screenshot"),
    )
    warnings = _set(
        (pdf & ~kind.contains("pdf"), "expected_pdf_but_metadata_not_pdf"),
        (~pdf & (kind != "") & ~kind.rlike("html|text|json|xml"), "unexpected_content_type"),
        (F.col("screenshot_blank").isNull(), "missing_screenshot"),
        (text("strategy") == "interactive_shell", "interactive_shell_requires_manual_review"),
        ((title != "") & has_phrase(title, ERROR_PHRASES), "title_error_review"),
    )
    gated = staged.withColumns({"failures": failures, "warnings": warnings}).drop("_title", "_head", "_probe")
    return gated.withColumn("status", status_of(F.col("failures"), F.col("warnings")))


def is_blocked(status: Column, failures: Column, has_text: Column) -> Column:
    return ~has_text | F.lower(text(status)).isin(*BLOCKED_STATUSES) | F.arrays_overlap(failures, F.array(*map(F.lit, BLOCKING_FAILURES)))


def corpus_index(rows: DataFrame, gates: DataFrame, texts: DataFrame) -> DataFrame:
    """The corpus index: source rows (id, type, title) with their gate (id, status, failures, warnings) and text (id, text).

    A row without a gate is missing its acquisition; one without text is not available.
    """
    # Texts are measured where they are read; what moves to the rows is their figures.
    figures = texts.where("text is not null").select("id", word_count("text").alias("word_count"), F.octet_length("text").cast("bigint").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    one = rows.join(gates, "id", "left").join(figures, "id", "left")
    status = F.coalesce("status", F.lit("missing_acquisition_artifact"))
    failures = F.coalesce("failures", F.array(F.lit("missing_acquisition_artifact")))
    return one.select(
        "id", "type", "title", status.alias("status"), failures.alias("failures"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        (~is_blocked(status, failures, F.col("sha256").isNotNull())).alias("available"), "word_count", "bytes", "sha256",
    )


def mix_report(index: DataFrame, by: str = "type") -> DataFrame:
    """Rows, and available ones, of each type."""
    return index.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if("available").alias("n_available"))


def histogram(rows: DataFrame, array_column: str, name: str = "value") -> DataFrame:
    """How often each value stands in an array column."""
    return rows.select(F.explode(array_column).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def dominant_repeat_ratio(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """Of each key the share of its most frequent value; the values, not their occurrences, are what a key gathers."""
    counts = rows.select(key, value.alias("_v")).groupBy(key, "_v").agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg((F.max("_n") / F.sum("_n")).alias("repeat_ratio"), F.sum("_n").alias("n_values"))


def transcript_warnings(words: Column, duration: Column, language: Column, source_kind: Column) -> Column:
    """Sorted warnings of a transcript; sparse: fewer words than a quarter of its seconds, or than 15."""
    return _set(
        (text(language).isin("", "unknown"), "language_unknown"),
        (words < F.greatest(F.lit(15.0), F.coalesce(duration, F.lit(0.0)) / 4), "sparse_transcript"),
        (text(source_kind) == "automatic", "automatic_captions"),
        (text(source_kind) == "plain_text", "untimed_transcript"),
    )
