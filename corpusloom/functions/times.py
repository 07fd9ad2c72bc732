"""Dates and time stamps of transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import col, plain_slug, text

TIMESTAMP = r"(?<![\d:])(?:\d{1,2}:)?\d{1,2}:\d{2}(?![\d:])"


def date_iso(c: Column | str) -> Column:
    """dd/mm/yyyy as yyyy-mm-dd, days not checked; other texts as they are."""
    return F.regexp_replace(F.trim(text(c)), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")


def date_slug(c: Column | str) -> Column:
    """A valid dd/mm/yyyy as ISO date, else the text's slug."""
    day = F.try_to_date(F.when(F.trim(text(c)).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.trim(text(c))), "d/M/yyyy")
    return F.coalesce(day.cast("string"), plain_slug(c))


def seconds_of(c: Column | str) -> Column:
    """MM:SS or H:MM:SS in seconds; null for others."""
    n = F.transform(F.split(F.trim(text(c)), ":"), lambda x: x.try_cast("double"))
    at = lambda i: F.get(n, F.lit(i))
    return F.when(F.size(n) == 2, at(0) * 60 + at(1)).when(F.size(n) == 3, at(0) * 3600 + at(1) * 60 + at(2))


def timestamp_label(c: Column | str) -> Column:
    """Seconds as MM:SS, from an hour on H:MM:SS; halves to the even second; unknown for null."""
    s = F.bround(col(c), 0).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(col(c).isNull(), "unknown").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), r))


def section_timestamp(c: Column | str) -> Column:
    """Seconds as HH:MM:SS.mmm."""
    ms = F.bround(col(c) * 1000, 0).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def seconds_offset(c: Column | str) -> Column:
    return F.format_string("%.3fs", col(c).cast("double"))


def timestamps_in(c: Column | str) -> Column:
    """All time stamps of a text, in seconds."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(TIMESTAMP), F.lit(0)), seconds_of)
