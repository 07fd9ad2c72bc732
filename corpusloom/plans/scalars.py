"""Queries of text, URL, time and hash expressions, and of gates, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import jsons, times, urls
from corpusloom.functions import text as X
from corpusloom.operators import gate
from corpusloom.plans.base import Tables, query

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+'))"
_TRIM = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


def _phrases(where: str, phrases: tuple[str, ...]) -> str:
    return f"regexp_matches({where}, '(?i)(^|[^a-z0-9_])(" + "|".join(phrases) + ")([^a-z0-9_]|$)')"


_FLAGS = f"""
with b as (select *, {_TRIM} as body from documents),
w as (select *, len(regexp_extract_all(body, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as words, chr(10) || coalesce(source, '') || chr(10) || left(body, 4000) as probe from b),
f as (select *, list_sort(list_filter([
  case when body = '' then 'empty_content' end, case when body <> '' and words < 150 then 'short_content' end, case when words > 35000 then 'very_long_content' end,
  case when len(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(')) > 150 then 'many_images' end,
  case when {_phrases("probe", gate.ERROR_PHRASES)} then 'looks_like_error_page' end, case when {_phrases("probe", gate.PAYWALL_PHRASES)} then 'possible_paywall' end,
  case when {_phrases("body", gate.BOILERPLATE_PHRASES)} then 'possible_boilerplate' end, case when {_phrases("probe", gate.BOT_WALL_PHRASES)} then 'possible_bot_wall' end,
  case when {_phrases("probe", gate.AUTH_WALL_PHRASES)} and words < 1200 then 'possible_auth_wall' end], lambda x: x is not null)) as flags from w)
"""


def _flagged(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return gate.with_flags(t.documents.select("doc_id", "lang", "source", "text"), "text", F.col("source"), none, none).select("doc_id", "lang", "source", "flags")


@query(_FLAGS + "select lang, case when len(flags) > 0 then 'passed_with_warnings' else 'passed' end as status, count(*) as n_docs, cast(count(*) filter (where list_contains(flags, 'short_content')) as bigint) as n_short from f group by 1, 2")
def corpus_gate_summary(t: Tables) -> DataFrame:
    status = gate.status_of(F.array(), F.col("flags"))
    return _flagged(t).groupBy("lang", status.alias("status")).agg(F.count("*").alias("n_docs"), F.count_if(F.array_contains("flags", "short_content")).alias("n_short"))


@query(_FLAGS + "select doc_id, array_to_string(flags, ',') as flags from f")
def suspicious_flags(t: Tables) -> DataFrame:
    return _flagged(t).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query(_FLAGS + "select value, count(*) as n from (select unnest(flags) as value from f) group by value")
def warning_histogram(t: Tables) -> DataFrame:
    return gate.histogram(_flagged(t), "flags")


@query("select source, count(*) as n_rows, cast(count(*) filter (where l.doc_id is not null and quality = 1) as bigint) as n_available from documents d left join labels l using (doc_id) group by source")
def source_mix(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return gate.mix_report(joined.withColumn("available", F.coalesce(F.col("quality") == 1, F.lit(False))), "source")


@query(f"""select doc_id, lang as type, case when l.doc_id is null then 'missing_acquisition_artifact' when quality = 0 then 'failed_gate' else 'passed' end as status,
  l.doc_id is not null and quality <> 0 and d.text is not null as available, {_WORDS} as word_count, cast(strlen(d.text) as bigint) as bytes, sha256(d.text) as sha256
  from documents d left join labels l using (doc_id)""")
def corpus_index(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("source").alias("title"))
    gates = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "failed_gate").otherwise("passed").alias("status"), none.alias("failures"), none.alias("warnings"))
    index = gate.corpus_index(rows, gates, t.documents.select(F.col("doc_id").alias("id"), "text"))
    blocked = index.withColumn("available", F.col("available") & (F.col("status") != "missing_acquisition_artifact"))
    return blocked.select(F.col("id").alias("doc_id"), "type", "status", "available", "word_count", "bytes", "sha256")


@query(f"""with g as (select page_id, html as content, regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1) as title from pages),
w as (select *, len(regexp_extract_all(coalesce(content, ''), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as word_count, title || chr(10) || left(coalesce(content, ''), 4000) as probe from g),
f as (select *, list_sort(list_filter([case when {_phrases("probe", gate.BOT_WALL_PHRASES)} then 'bot_wall_detected' end,
  case when {_phrases("probe", gate.AUTH_WALL_PHRASES)} and word_count < 1200 then 'auth_wall_detected' end,
  case when {_phrases("probe", gate.ERROR_PHRASES)} and word_count < 1000 then 'error_page_detected' end], lambda x: x is not null)) as fails from w)
select page_id, case when len(fails) > 0 then 'failed_gate' else 'passed_with_warnings' end as status, array_to_string(fails, ',') as failures,
  array_to_string(list_filter(['missing_screenshot', case when title <> '' and {_phrases("title", gate.ERROR_PHRASES)} then 'title_error_review' end], lambda x: x is not null), ',') as warnings, word_count from f""")
def page_gate(t: Tables) -> DataFrame:
    none = F.lit(None)
    pages = t.pages.select("page_id", F.col("html").alias("content"), F.regexp_extract(X.text("html"), r"(?is)<title>(.*?)</title>", 1).alias("title"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit("html").alias("strategy"), none.cast("boolean").alias("screenshot_blank"))
    return gate.gate(pages).select("page_id", "status", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"), "word_count")


@query(f"select doc_id, {_WORDS} as n_words, len(regexp_extract_all(coalesce(text, ''), '\\S+')) as n_space_words from documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.word_count("text").alias("n_words"), X.space_word_count("text").alias("n_space_words"))


@query(r"""with s as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '-') as p,
  rtrim(left(trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce(text, '')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), 90), '-') as a from documents)
select doc_id, sha256(case when p = '' then 'untitled' else p end) as plain_sha256, case when a = '' then 'source' else a end as ascii_slug from s""")
def doc_slugs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", jsons.sha256_text(X.plain_slug("text")).alias("plain_sha256"), X.ascii_slug("text", "source").alias("ascii_slug"))


@query(r"""select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as collapsed,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as normal,
  md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) as concept from documents""")
def text_normal_forms(t: Tables) -> DataFrame:
    digest = lambda c, n: F.md5(c.cast("binary")).alias(n)
    return t.documents.select("doc_id", digest(X.collapse_space("text"), "collapsed"), digest(X.normalize_text("text"), "normal"), digest(X.concept_text("text", fold=False), "concept"))


@query(r"""with l as (select doc_id, trim(regexp_replace(x, '\s+', ' ', 'g')) as v from documents, unnest(string_split(text, chr(10))) as t(x)),
c as (select doc_id, v, count(*) as n from l group by doc_id, v)
select doc_id, max(n) / sum(n) as repeat_ratio, cast(sum(n) as bigint) as n_values from c group by doc_id""")
def line_repeat_ratio(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return gate.dominant_repeat_ratio(lines, "doc_id", X.collapse_space("line"))


@query(r"""with q as (select page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', ['s', 'h', 'p', 'q', 'f']) as r from pages),
n as (select page_id, lower(r.h) as host, lower(r.s) as scheme, regexp_replace(r.p, '/{2,}', '/', 'g') as p, array_to_string(list_sort(list_filter(string_split(r.q, '&'), lambda x: x <> '')), '&') as query, r.f as fragment, url from q)
select page_id, regexp_replace(host, ':\d*$', '') as host, query as sorted_query, fragment, scheme || '://' || host || case when p in ('', '/') then '/' else regexp_replace(p, '/+$', '') end || case when query <> '' then '?' || query else '' end as normalized from n""")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.host("url").alias("host"), urls.sorted_query("url").alias("sorted_query"), urls.fragment("url").alias("fragment"), urls.normalize("url").alias("normalized"))


@query(r"""with q as (select page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', ['s', 'h', 'p']) as r from pages)
select lower(r.s) || '://' || lower(r.h) || r.p as address, count(*) as n_pages, min(page_id) as first_page from q group by 1""")
def url_dedupe(t: Tables) -> DataFrame:
    address = F.concat(urls.scheme("url"), F.lit("://"), urls.netloc("url"), urls.path("url"))
    return t.pages.groupBy(address.alias("address")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query(r"""select kind, count(*) as n from (select case when coalesce(title, '') ilike '%video%' or coalesce(title, '') ilike '%vídeo%' or regexp_matches(lower(url), '^[a-z]+://[^/]*(youtube\.com|youtu\.be|vimeo\.com|ted\.com)') then 'video' else 'article' end as kind
  from (select url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title from pages)) group by kind""")
def source_routes(t: Tables) -> DataFrame:
    title = F.regexp_extract(X.text("html"), r"(?is)<title>(.*?)</title>", 1)
    return t.pages.groupBy(urls.route("url", title, F.lit("")).alias("kind")).agg(F.count("*").alias("n"))


@query("select page_id, len(regexp_extract_all(html, '(?i)<a\\b[^>]*href')) as n_links, len(regexp_extract_all(html, '(?i)<img\\b')) as n_images from pages")
def page_link_counts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_count("html", F.lit(r"(?i)<a\b[^>]*href")).cast("bigint").alias("n_links"), F.regexp_count("html", F.lit(r"(?i)<img\b")).cast("bigint").alias("n_images"))


@query("""with e as (select event_id, cast(floor(epoch(ts)) as bigint) % 20000 as s from events)
select event_id, case when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) else printf('%02d:%02d', s // 60, s % 60) end as label, printf('%02d:%02d:%02d.000', s // 3600, s % 3600 // 60, s % 60) as section, printf('%d.000s', s) as at from e""")
def timestamp_labels(t: Tables) -> DataFrame:
    e = t.events.select("event_id", (F.unix_seconds(F.col("ts").cast("timestamp")) % 20000).cast("double").alias("s"))
    return e.select("event_id", times.timestamp_label("s").alias("label"), times.section_timestamp("s").alias("section"), times.seconds_offset("s").alias("at"))


@query("select o_orderkey, strftime(o_orderdate::date, '%Y-%m-%d') as iso, strftime(o_orderdate::date, '%Y-%m-%d') as slug from orders")
def date_forms(t: Tables) -> DataFrame:
    shown = F.date_format("o_orderdate", "dd/MM/yyyy")
    return t.orders.select("o_orderkey", times.date_iso(shown).alias("iso"), times.date_slug(shown).alias("slug"))


@query("select p_partkey, sha256('{\"brand\":' || to_json(p_brand) || ',\"name\":' || to_json(p_name) || '}') as compact, sha256('{\"brand\": ' || to_json(p_brand) || ', \"name\": ' || to_json(p_name) || '}') as spaced from part")
def stable_hashes(t: Tables) -> DataFrame:
    fields = {"name": F.col("p_name"), "brand": F.col("p_brand")}
    return t.part.select("p_partkey", jsons.stable_hash(True, **fields).alias("compact"), jsons.stable_hash(False, **fields).alias("spaced"))


@query("""select p_partkey, 'concept-' || rtrim(left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 90), '-') || '-' ||
  left(sha1(p_name || chr(10) || p_type || chr(10) || '[' || to_json(p_brand) || ']' || chr(10) || '["' || p_partkey || '"]'), 8) as concept_id from part""")
def concept_hash_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", jsons.concept_id("p_name", "p_type", F.array("p_brand"), F.array(F.col("p_partkey").cast("string"))).alias("concept_id"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, case when cast(json_extract_string(props, '$.k') as bigint) >= 1 then cast(json_extract_string(props, '$.k') as bigint) end as at_least_one from events")
def json_fields(t: Tables) -> DataFrame:
    k = F.try_variant_get(jsons.parsed("props"), "$.k", "bigint")
    return t.events.select("event_id", k.alias("k"), jsons.optional_int(k).alias("at_least_one"))
