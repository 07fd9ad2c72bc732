"""Who may fetch what, and what a failure asks for: host configuration, addresses of readers, reasons to try again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.text import text

#: Hosts of readers and of the catalogue that hands over to them, and paths there.
READER_HOST, HANDOFF_HOST, TERMINAL_HOST = "integrada.minhabiblioteca.com.br", "jigsaw.minhabiblioteca.com.br", "philos.sophia.com.br"
HANDOFF_PATH, TERMINAL_PATH, SIGN_ON_PATH = "/auth/redirects/", "/terminal/9418", "/IntegracaoDigital/ExecutarSingleSignOn"
#: Fields of the catalogue's items, and how far around a mention a number counts.
NUMBER_FIELD, ADDRESS_FIELD, NEAR = "Codigo", "URL", 800
#: What providers say under pressure, in the order in which it is looked for.
PRESSURE = ("DeepSeek HTTP 403", "DeepSeek HTTP 429", "DeepSeek HTTP 503", "DeepSeek request timed out", "DeepSeek request failed", "DeepSeek returned an empty message")
#: Errors of form alone.
FORMAT_ERRORS = ("JSON parse error", "stage output must be a JSON object", "must be a JSON object", "must include accepted_concepts", "must include candidate_assignments")


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in phrases))


def host_settings(rows: DataFrame, url: str, settings: DataFrame) -> DataFrame:
    """rows with the settings (host, value) of their address's host, or of the nearest domain above it that has some."""
    parts = F.split(urls.host(F.col(url)), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = rows.withColumn("_id", F.monotonically_increasing_id()).select("*", F.posexplode(above).alias("_p", "host"))
    met = each.join(settings.select("host", F.col("value").alias("_v")), "host", "left")
    best = F.min_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.col("_p")))
    return met.groupBy("_id", *rows.columns).agg(best.alias("value")).select(*rows.columns, "value")


def is_book_address(url: Column, code: Column) -> Column:
    return (urls.host(url) == READER_HOST) & urls.path(url).contains(F.concat(F.lit("/books/"), code))


def is_reader_page(url: Column, code: Column) -> Column:
    """A page of a book in the reader."""
    return (urls.host(url) == READER_HOST) & urls.path(url).contains(F.concat(F.lit("/reader/books/"), code))


def is_terminal(url: Column) -> Column:
    return (urls.host(url) == TERMINAL_HOST) & urls.path(url).startswith(TERMINAL_PATH)


def may_hand_over(url: Column, code: Column) -> Column:
    """Where a sign-on may lead: the book's own address, or the reader's redirects."""
    return is_book_address(url, code) | ((urls.host(url) == HANDOFF_HOST) & urls.path(url).startswith(HANDOFF_PATH))


def is_login(url: Column) -> Column:
    h = urls.host(url)
    return (h == "login.vitalsource.com") | (h.rlike(r"(^|\.)vitalsource\.com$") & urls.path(url).contains("login"))


def subfield_code(html: Column, code: Column) -> Column:
    """The catalogue's number for a book's digital copy: of the first item whose address is the book's, or else the first
    number in the text around the book's first mention; blank if there is none.

    Items are what stands between a brace and the next one that closes it; their fields are read by name.
    """
    plain = F.replace(F.replace(text(html), F.lit("&quot;"), F.lit('"')), F.lit("&#34;"), F.lit('"'))
    bodies = F.transform(F.split(plain, r"\}"), lambda x: F.element_at(F.split(x, r"\{"), -1))
    whole = F.transform(F.slice(bodies, 1, F.size(bodies) - 1), lambda x: F.struct(_number_after(x, NUMBER_FIELD).alias("n"), _string_after(x, ADDRESS_FIELD).alias("at")))
    own = F.filter(whole, lambda x: (x["n"] != "") & (x["at"] != "") & is_book_address(x["at"], code))
    place = F.position(F.concat(F.lit("/books/"), code), plain)
    begin = F.greatest(F.lit(1), place - NEAR)
    around = F.substr(plain, begin, place + NEAR - begin)
    return F.coalesce(F.get(own["n"], F.lit(0)), F.when(place > 0, _number_after(around, NUMBER_FIELD)), F.lit(""))


def _number_after(c: Column, field: str) -> Column:
    return F.regexp_extract(c, rf'"{field}"\s*:\s*(\d+)', 1)


def _string_after(c: Column, field: str) -> Column:
    return F.regexp_extract(c, rf'"{field}"\s*:\s*"([^"]+)"', 1)


def sign_on_address(terminal: Column, subfield: Column) -> Column:
    """The address that signs on at a catalogue's terminal for a book."""
    base = F.regexp_extract(urls.path(terminal), r"^(/terminal/\d+)", 1)
    return F.concat(urls.scheme(terminal), F.lit("://"), urls.netloc(terminal), F.when(base != "", base).otherwise(TERMINAL_PATH), F.lit(f"{SIGN_ON_PATH}?codigoSubcampo="), subfield)


def address_in_json(payload: Column) -> Column:
    """The first address in a JSON text's string values, however deep, in the order of the text; null if there is none.

    A JSON text is cut into its strings from the left, so marks inside strings are no bounds. A string before a colon is a
    key. Each value is read as JSON, so its escapes are gone before an address is looked for in it. A key that an object
    has twice makes it no JSON.
    """
    strings = F.regexp_extract_all(text(payload), F.lit(r'("(?:[^"\\]|\\.)*+"(?:\s*:)?)'), F.lit(1))
    values = F.filter(strings, lambda x: ~x.endswith(":") | x.rlike(r'^"(?:[^"\\]|\\.)*+"$'))
    read = F.transform(values, lambda x: urls.first_url(F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0))))
    return F.when(F.try_parse_json(payload).isNotNull(), F.get(F.filter(read, lambda x: x.isNotNull()), F.lit(0)))


def pressure_reason(message: Column) -> Column:
    """What a provider complains of, or null."""
    out = F
    for p in PRESSURE:
        out = out.when(message.contains(p), p)
    return out


def repair_type(errors: Column) -> Column:
    """format_repair if every error is one of form, else contextual_repair."""
    return F.when(F.forall(errors, lambda e: _any(e, FORMAT_ERRORS)), "format_repair").otherwise("contextual_repair")


def repair_route(kind: Column, own: Column, repair: Column, contextual: Column) -> Column:
    """The route of a repair: a contextual one has its own if there is one, else the repairs', else the stage's."""
    named = lambda c: F.nullif(text(c), F.lit(""))
    return F.coalesce(F.when(kind == "contextual_repair", named(contextual)), named(repair), own)


def retry_with_file(message: Column, source: Column, mode: Column) -> Column:
    """Whether a video that a model may not open by its address should be sent as a file."""
    return (mode == "external_uri") & (urls.in_domain(source, "youtube.com") | urls.in_domain(source, "youtu.be")) & (message.contains("PERMISSION_DENIED") | message.contains("403"))
