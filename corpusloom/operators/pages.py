"""Pages of articles and videos as they are stored: what is known of them as front matter, then their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.jsons import json_scalar
from corpusloom.functions.text import text, word_count

#: Who a page comes from, and the strategy of videos.
ARTICLE_PROVIDER, VIDEO_PROVIDER, VIDEO_STRATEGY = "firecrawl", "gemini_multimodal", "video_gemini_two_pass"
_IMAGE, _LINK = r"!\[[^\]]*\]\([^)]+\)", r"\[[^\]]+\]\([^)]+\)"


def matter(fields: dict[str, Column | list]) -> Column:
    """Front matter of fields in the order given: numbers and truth values as they are, texts quoted, nulls null.

    A list of one column stands for an array of texts, an item a line, or [] where it is empty or null.
    """

    def line(name: str, value: Column | list) -> Column:
        if not isinstance(value, list):
            return F.concat(F.lit(f"{name}: "), json_scalar(value))
        (items,) = value
        listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit("\n  - "), json_scalar(x))), "")
        return F.concat(F.lit(f"{name}:"), F.coalesce(F.nullif(listed, F.lit("")), F.lit(" []")))

    return F.concat_ws("\n", F.lit("---"), *(line(k, v) for k, v in fields.items()), F.lit("---"))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(text(c), r"\s+$", "")


def image_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_IMAGE)).cast("bigint")


def link_count(c: Column) -> Column:
    """Links that are no images."""
    return F.regexp_count(F.regexp_replace(c, _IMAGE, ""), F.lit(_LINK)).cast("bigint")


def _measures(body: Column) -> dict[str, Column]:
    return {"word_count": word_count(body), "char_count": F.length(body).cast("bigint"), "content_sha256": F.sha2(body.cast("binary"), 256)}


def articles(rows: DataFrame) -> DataFrame:
    """rows with markdown. rows: id, title, url, fetch_url, strategy, notes (array), cache_key, fetched_at, content, warnings (array),
    gate_status, gate_failures (array), metadata (struct url, sourceURL, title, description, statusCode, contentType), n_images, n_links."""
    m, body = (lambda f: F.col(f"metadata.{f}")), text("content")
    fields = {
        "id": F.col("id"), "title": F.col("title"), "source_url": F.col("url"), "fetch_url": F.col("fetch_url"), "resolved_url": F.coalesce(F.nullif(m("url"), F.lit("")), m("sourceURL")), "firecrawl_title": m("title"), "description": m("description"),
        "fetched_at": F.col("fetched_at"), "provider": F.lit(ARTICLE_PROVIDER), "strategy": F.col("strategy"), "cache_key": F.col("cache_key"), "firecrawl_status_code": m("statusCode"), "firecrawl_content_type": m("contentType"), **_measures(body),
        "image_count": F.coalesce("n_images", F.lit(0)), "link_count": F.coalesce("n_links", F.lit(0)), "warnings": [F.col("warnings")], "gate_status": F.col("gate_status"), "gate_failures": [F.col("gate_failures")], "route_notes": [F.col("notes")],
    }
    return rows.withColumn("markdown", F.concat(matter(fields), F.lit("\n\n"), _trimmed(body), F.lit("\n")))


def videos(rows: DataFrame) -> DataFrame:
    """rows with markdown. rows: id, title, url, original_url, final_url, fetched_at, cache_keys (array), model, media_resolution, fps,
    prompt_version, duration_seconds, transcript_source, transcript_sha256, body, total_token_count, warnings, gate_status, gate_failures."""
    body = _trimmed(F.col("body"))
    frame, sound = F.when(F.col("media_resolution") == "low", 66).otherwise(258), 32  # tokens of a frame and of a second of sound
    no_text = F.lit(None).cast("string")
    fields = {
        "id": F.col("id"), "title": F.col("title"), "source_url": F.coalesce(F.nullif(F.col("original_url"), F.lit("")), F.col("url")), "fetch_url": F.col("url"), "resolved_url": F.col("final_url"), "firecrawl_title": no_text, "description": no_text,
        "fetched_at": F.col("fetched_at"), "provider": F.lit(VIDEO_PROVIDER), "strategy": F.lit(VIDEO_STRATEGY), "cache_key": F.when(F.size("cache_keys") == 1, F.get("cache_keys", F.lit(0))), "cache_keys": [F.col("cache_keys")],
        "gemini_model": F.col("model"), "gemini_media_resolution": F.col("media_resolution"), "gemini_fps": F.col("fps"), "prompt_version": F.col("prompt_version"), "duration_seconds": F.col("duration_seconds"), "transcript_source": F.col("transcript_source"),
        "transcript_sha256": F.col("transcript_sha256"), **_measures(body), "image_count": image_count(body), "link_count": link_count(body), "total_token_count": F.col("total_token_count"),
        "estimated_input_tokens": F.floor(F.col("duration_seconds") * (sound + F.col("fps") * frame)).cast("bigint"), "warnings": [F.col("warnings")], "gate_status": F.col("gate_status"), "gate_failures": [F.col("gate_failures")], "route_notes": [F.array().cast("array<string>")],
    }
    return rows.withColumn("markdown", F.concat(matter(fields), F.lit("\n\n"), body, F.lit("\n")))
