"""Queries of what is kept between runs: numbers over whole tables, interpretations, fingerprints and cache keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import labels, ordinals
from corpusloom.plans.base import Tables, query
from corpusloom.sources import files


@query("""with r as (select case when l_partkey % 3 = 0 then l_returnflag || '-' || l_orderkey when l_partkey % 3 = 1 then '00' || l_orderkey else l_orderkey::varchar end as id from lineitem)
select id, count(*) as n, min(o) as first, max(o) as last from (select id, row_number() over (order by case when regexp_matches(id, '^[0-9]+$') then 0 else 1 end, case when regexp_matches(id, '^[0-9]+$') then id::bigint end, id) as o from r) group by id""")
def ordered_results(t: Tables) -> DataFrame:
    """Results numbered over the whole table, numeric ids by number before all others; where each id's numbers begin and end."""
    k, kind = F.col("l_orderkey"), F.col("l_partkey") % 3
    rows = t.lineitem.select(F.when(kind == 0, F.concat("l_returnflag", F.lit("-"), k)).when(kind == 1, F.concat(F.lit("00"), k)).otherwise(k.cast("string")).alias("id"))
    return ordinals.batch_results(rows).groupBy("id").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def _interpreted(t: Tables) -> DataFrame:
    contexts = t.part.select(F.concat("p_brand", F.lit(" "), "p_type").alias("label"), "p_partkey", "p_size")
    now = labels.digests(contexts)
    old = now.where(F.length("label") % 2 == 0).select("label", F.lit("lesson_cluster").alias("pattern"), F.lit("high").alias("confidence"), F.when(F.col("context_count") % 5 != 0, "kept").otherwise("").alias("rationale"), F.when(F.col("context_count") % 3 == 0, "old").when(F.col("context_count") % 3 == 1, F.col("digest")).alias("digest"))
    gone = t.part.select(F.concat(F.lit("gone "), "p_brand").alias("label"), F.lit("lesson_cluster").alias("pattern"), F.lit("high").alias("confidence"), F.lit("r").alias("rationale"), F.lit(None).cast("string").alias("digest")).distinct()

    def classify(left: DataFrame) -> DataFrame:
        by = left.groupBy("label").agg(F.max("p_size").alias("_m"))
        return by.where("_m > 10").select("label", F.when(F.col("_m") % 2 == 0, "prerequisite_hint").otherwise("application_adjacent_signal").alias("pattern"), F.lit("low").alias("confidence"), F.concat(F.lit("largest is "), "_m").alias("rationale"))

    return labels.interpreted(contexts, old.unionByName(gone), classify)


_LABELS = """with c as (select p_brand || ' ' || p_type as label, count(*) as n, max(p_size) as m from part where p_brand || p_type <> '' group by 1),
i as (select label, n, m, length(label) % 2 = 0 and n % 5 <> 0 and n % 3 <> 0 as reused from c)"""


@query(_LABELS + """ select label, case when reused then 'lesson_cluster' when m <= 10 then 'ignored_ambiguous' when m % 2 = 0 then 'prerequisite_hint' else 'application_adjacent_signal' end as pattern, case when reused then 'high' when m <= 10 then 'stubbed' else 'low' end as confidence,
  case when reused then 'kept' when m <= 10 then '' else 'largest is ' || m end as rationale, reused, n as context_count from i""")
def label_interpretations(t: Tables) -> DataFrame:
    """Labels of which half were stored before: used again while their contexts are the same, classified anew else; stored ones without contexts are gone."""
    return _interpreted(t).drop("digest")


@query(_LABELS + """ select count(*) as unique_label_count, count_if(reused) as reused_count, count_if(not reused) as classified_count, count_if(not reused and m > 10 and m % 2 = 0) as prerequisite_hint_count, count_if(reused) as lesson_cluster_count,
  count_if(not reused and m > 10 and m % 2 = 1) as application_adjacent_signal_count, count_if(not reused and m <= 10) as ignored_ambiguous_count from i""")
def interpretation_counts(t: Tables) -> DataFrame:
    return labels.interpretation_summary(_interpreted(t))


@query(r"""with i as (select url, arg_min(html, page_id) as html from pages where page_id % 3 = 0 and html is not null group by url),
f as (select page_id, case when page_id % 3 < 2 and i.url is not null then '{"kind":"local_file","path":' || to_json(p.url) || ',"sha256":"' || sha256(i.html) || '","size_bytes":' || strlen(i.html) || '}' when page_id % 3 < 2 and regexp_matches(p.url, '^https?://', 'i') then '{"kind":"remote_video_url","url":' || to_json(regexp_replace(p.url, '#.*$', '')) || '}'
  else '{"kind":"unresolved_source","source":' || coalesce(to_json(case when page_id % 3 < 2 then p.url else 'é ' || left(p.html, 300) end), 'null') || '}' end as fingerprint from pages p left join i using (url))
select page_id, fingerprint, sha256('{"audio_pass_version":"audio_grounding_v1","preferred_languages":["pt","en"],"source":' || fingerprint || ',"whisper_extra_args":[],"whisper_model":"large.bin"}') as key from f""")
def source_fingerprints(t: Tables) -> DataFrame:
    """Fingerprints of sources that are files, addresses or neither, and the keys made of them. An address of which there is a file is that file;
    of several pages at one address the file is that of the smallest page_id."""
    k = F.col("page_id")
    files_of = t.pages.where((k % 3 == 0) & F.col("html").isNotNull()).groupBy(F.col("url").alias("path")).agg(F.min_by("html", "page_id").alias("html"))
    index = files_of.select("path", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").alias("length"))
    sources = t.pages.select("page_id", F.when(k % 3 < 2, F.col("url")).otherwise(F.concat(F.lit("é "), F.left("html", F.lit(300)))).alias("source"))
    found = files.fingerprints(sources, index)
    key = files.audio_key(F.col("fingerprint"), F.array(F.lit("pt"), F.lit("en")), F.lit("/m/large.bin"), F.array().cast("array<string>"))
    return found.select("page_id", "fingerprint", key.alias("key"))


@query(r"""with p as (select p_partkey, p_name, p_brand, p_size, 'https://api.firecrawl.dev/v2/scrape' as e, to_json(p_name) as n from part),
j as (select *, '{"endpoint":"' || e || '","request_params":{"formats":["markdown",{"size":' || p_size || ',"type":"x"}]' as head, ',"onlyMain":' || case when p_size % 2 = 0 then 'true' else 'false' end as only_, ',"url":' || n || '},"strategy":"' || p_brand || '"}' as tail from p)
select p_partkey, sha256(head || only_ || tail) as key, sha256(head || ',"maxAge":' || p_size || only_ || ',"timeout":' || case when p_size % 4 = 0 then 120000 else p_partkey end || tail) as exact,
  case when p_size % 4 = 0 or p_partkey in (120000, 240000) then 3 else 4 end::integer as n_keys, sha256('{"book_id": "' || p_partkey || '", "capture_version": "browserbase_book_capture_v2", "resource_code": ' || case when p_size % 5 = 0 then 'null' else to_json(p_brand) end || ', "scope": {"kind": "pages", "status": "ok", "value": ' || n || '}, "scope_prompt_version": "book_scope_deepseek_v1", "url": "http://b/' || p_size || '"}') as book from j""")
def cache_keys(t: Tables) -> DataFrame:
    """Keys of pages' requests, with and without what passes, and of books' captures."""
    size, k = F.col("p_size"), F.col("p_partkey")
    name = F.regexp_replace(F.to_json(F.array("p_name")), r"^\[|\]$", "")
    params = F.concat(F.lit('{"url": '), name, F.lit(', "timeout": '), F.when(size % 4 == 0, 120000).otherwise(k), F.lit(', "onlyMain": '), F.when(size % 2 == 0, "true").otherwise("false"), F.lit(', "maxAge": '), size, F.lit(', "formats": ["markdown", {"type": "x", "size": '), size, F.lit("}]}"))
    book = files.book_key(k.cast("string"), F.when(size % 5 != 0, F.col("p_brand")), F.concat(F.lit("http://b/"), size), F.lit("ok"), F.lit("pages"), F.col("p_name"))
    return t.part.select("p_partkey", files.request_key(params, F.col("p_brand")).alias("key"), files.request_key(params, F.col("p_brand"), True).alias("exact"), F.size(files.request_keys(params, F.col("p_brand"))).alias("n_keys"), book.alias("book"))


@query(r"""with s as (select 'nation-' || s_nationkey || '/s' || s_suppkey as scope, s_suppkey, s_name, s_nationkey from supplier)
select scope, 'supplier.json' as name, sha256('{' || chr(10) || '  "list": [' || chr(10) || '    ' || s_suppkey || ',' || chr(10) || '    {' || chr(10) || '      "a": null,' || chr(10) || '      "b": ' || to_json(s_name) || chr(10) || '    }' || chr(10) || '  ],' || chr(10) || '  "nation": ' || s_nationkey || chr(10) || '}' || chr(10)) as sha256 from s
union all select scope, 'attempt_1.txt', sha256('raw answer of ' || s_name || chr(10) || ' in lines') from s where s_suppkey % 3 = 0""")
def artifact_files(t: Tables) -> DataFrame:
    """Artifacts and raw answers of all suppliers, written as files, all or none, and read back."""
    import uuid

    from corpusloom.session import shared_dir
    from corpusloom.sources import sinks

    scope = F.concat(F.lit("nation-"), "s_nationkey", F.lit("/s"), "s_suppkey")
    name = F.regexp_replace(F.to_json(F.array("s_name")), r"^\[|\]$", "")
    payload = F.concat(F.lit('{"nation": '), "s_nationkey", F.lit(', "list": ['), "s_suppkey", F.lit(', {"b": '), name, F.lit(', "a": null}]}'))
    rows = t.supplier.select(scope.alias("scope"), F.lit("supplier.json").alias("name"), payload.alias("payload"))
    raw = t.supplier.where("s_suppkey % 3 = 0").select(scope.alias("scope"), F.lit("attempt_1.txt").alias("name"), F.concat(F.lit("raw answer of "), "s_name", F.lit("\n in lines")).alias("payload"))
    path = f"{shared_dir(t.spark)}/artifacts-{uuid.uuid4().hex}"
    sinks.write_files(rows.unionByName(raw), path, sort=True)
    return sinks.read_files(t.spark, path).select("scope", "name", F.sha2(F.col("payload").cast("binary"), 256).alias("sha256"))


@query("""with m as (select user_id::varchar as key, ts as time, event_id, case event_type when 'view' then 'start' when 'error' then 'error' when 'purchase' then 'returned' end as kind from events where event_type in ('view', 'error', 'purchase') and user_id is not null and ts is not null),
n as (select *, lead(kind) over w as k, lead(time) over w as t from m window w as (partition by key order by time, event_id)),
s as (select *, case when k is not null and k <> 'start' and epoch_us(t) - epoch_us(time) <= 86400000000 then k else 'lost' end as outcome from n where kind = 'start'),
d as (select *, coalesce(sum((outcome = 'returned')::int) over (partition by key order by time, event_id rows between unbounded preceding and 1 preceding), 0) as done from s)
select key, epoch_us(time) as started, case when outcome <> 'lost' then epoch_us(t) end as ended, case when outcome <> 'lost' then (epoch_us(t) - epoch_us(time)) / 1e6 end as elapsed_seconds, outcome, row_number() over (partition by key, done order by time, event_id) as attempt from d""")
def call_pairs(t: Tables) -> DataFrame:
    """Calls of users (a view starts one, a purchase or an error ends it) with their ends, times and attempts; streaming.calls gives the same as a stream."""
    from corpusloom.streaming import calls

    kind = F.col("event_type")
    rows = calls.marked(t.events, F.col("user_id"), F.col("ts"), F.col("event_id"), kind == "view", kind == "purchase", kind == "error")
    return calls.paired(rows, 24 * 3600).withColumns({c: F.unix_micros(c) for c in ("started", "ended")})
