"""JSON and hashing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import ascii_slug, col, strip_fence, text


def sha256_text(c: Column | str) -> Column:
    return F.sha2(text(c).cast("binary"), 256)


def compact_json(**fields: Column) -> Column:
    """An object with sorted keys and no spaces; null fields are kept as null."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def spaced_json(**fields: Column) -> Column:
    """As compact_json with a space after each comma and colon between its (string) fields."""
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(F.regexp_replace(F.to_json(F.array(fields[k])), r"^\[|\]$", ""), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _small_hex(json: Column) -> Column:
    """JSON whose control characters have small hex digits, as most writers have them. An escaped backslash before a u stays."""
    for upper in "ABCDEF":
        json = F.regexp_replace(json, rf"(?<!\\)((?:\\\\)*\\u00[01]){upper}", f"$1{upper.lower()}")
    return json


def json_scalar(c: Column) -> Column:
    """A column's value as JSON; null for null."""
    return F.coalesce(_small_hex(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")), F.lit("null"))


def sorted_json(fields: dict, spaced: bool = False) -> Column:
    """An object of columns and objects, keys sorted at every level, non-ASCII characters as they are; spaced: a space after
    commas and colons. An object with the one key '' stands for a column that is JSON already. Nulls are null."""
    if fields.keys() == {""}:
        return F.coalesce(fields[""], F.lit("null"))
    comma, colon = (", ", ": ") if spaced else (",", ":")
    parts = [F.concat(F.lit(f'"{k}"{colon}'), sorted_json(v, spaced) if isinstance(v, dict) else json_scalar(v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))


def canonical_json(c: Column) -> Column:
    """A map of names to variants as JSON, keys sorted at every level; an empty object for null."""
    entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))))
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    return _small_hex(F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(name(e["k"]), F.lit(":"), F.coalesce(e["v"], F.lit("null")))), ","), F.lit("")), F.lit("}")))


def stable_hash(compact: bool = True, **fields: Column) -> Column:
    return F.sha2((compact_json if compact else spaced_json)(**fields).cast("binary"), 256)


def string_array_json(c: Column | str) -> Column:
    """An array of strings as JSON with a space after each comma."""
    each = F.transform(col(c), lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def concept_id(label: Column | str, description: Column | str, criteria: Column | str, source_ids: Column | str) -> Column:
    """concept-, the label's slug, and eight digits of the SHA-1 over label, description, criteria and sources."""
    body = F.concat_ws("\n", text(label), text(description), string_array_json(criteria), string_array_json(source_ids))
    return F.concat(F.lit("concept-"), ascii_slug(label, "concept"), F.lit("-"), F.left(F.sha1(body.cast("binary")), F.lit(8)))


def parsed(c: Column | str) -> Column:
    """A model's answer as a variant, its code fence taken off; null where it is no JSON."""
    return F.try_parse_json(strip_fence(c))


def optional_float(c: Column | str) -> Column:
    """A finite number, or null."""
    n = col(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def optional_int(c: Column | str) -> Column:
    """An integer from 1 on, or null."""
    n = F.floor(optional_float(c)).try_cast("bigint")
    return F.when(n >= 1, n)


def without_blank_values(c: Column | str) -> Column:
    """A map's entries whose values are not blank."""
    return F.map_filter(col(c), lambda _, v: F.trim(F.coalesce(v, F.lit(""))) != "")
