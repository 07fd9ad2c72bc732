"""Queries of gates of books and videos, rendering, checks of candidates, and stand-ins for models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import decisions, media, models, rendering
from corpusloom.plans.base import Tables, query


@query()
def page_markdown(t: Tables) -> DataFrame:
    return t.pages.select("page_id", rendering.html_to_markdown("html").alias("markdown"))


@query("""select conv_id, case when n_words < 0.25 * n * 60 then 'failed_gate' else 'passed_with_warnings' end as status from (select conv_id, count(*) as n, sum(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{N}_]+'))) as n_words from conversations group by 1)""")
def conversation_pace(t: Tables) -> DataFrame:
    from corpusloom.functions.text import word_count

    g = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(word_count("text")).alias("w"))
    return g.select("conv_id", F.when(F.col("w") < 0.25 * F.col("n") * 60, "failed_gate").otherwise("passed_with_warnings").alias("status"))


@query("""with p as (select l_orderkey as book_id, list(l_linenumber order by l_linenumber, l_partkey) as got, count(*) filter (where l_partkey % 50 = 0) as n_missing, count(*) filter (where l_quantity < 20) as n_low from lineitem group by 1),
f as (select o_orderkey as book_id, list_filter([case when got is null then 'empty_page_manifest' end, case when n_missing > 0 then 'missing_reader_pageid' end, case when got is distinct from [1, 2, 3] then 'page_coverage_mismatch' end], lambda x: x is not null) as fails, coalesce(n_low, 0) as n_low from orders left join p on book_id = o_orderkey)
select book_id, array_to_string(fails, ',') as failures, case when len(fails) > 0 then 'failed_gate' when n_low > 0 then 'passed_with_warnings' else 'passed' end as status from f""")
def book_gates(t: Tables) -> DataFrame:
    captures = t.lineitem.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("page_index"), F.col("l_linenumber").cast("string").alias("label"), F.when(F.col("l_partkey") % 50 == 0, "").otherwise("p").alias("pageid"), F.col("l_quantity").alias("words"))
    requested = t.orders.select(F.col("o_orderkey").alias("book_id"), F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("labels"))
    return media.book_gate(captures, requested).select("book_id", F.array_join("failures", ",").alias("failures"), "status")


@query("""with r as (select p_brand as video_id, split_part(p_type, ' ', 1) as language, p_partkey as pos, case when p_partkey % 3 = 0 then 'json3' when p_partkey % 3 = 1 then 'vtt' else 'odd' end as ext, 'u' || p_partkey as url, p_partkey % 2 = 0 as translated from part)
select video_id, language, ext, url from (select *, row_number() over (partition by video_id order by translated, case when language = 'SMALL' then 0 when language = 'PROMO' then 2 else 4 end, language, case ext when 'vtt' then 1 when 'json3' then 3 else 99 end, pos) as k from r) where k = 1""")
def caption_tracks(t: Tables) -> DataFrame:
    n = F.col("p_partkey") % 3
    tracks = t.part.select(F.col("p_brand").alias("video_id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("language"), F.col("p_partkey").alias("pos"), F.when(n == 0, "json3").when(n == 1, "vtt").otherwise("odd").alias("ext"), F.concat(F.lit("u"), F.col("p_partkey")).alias("url"), (F.col("p_partkey") % 2 == 0).alias("translated"))
    return media.caption_track(tracks, ("SMALL", "PROMO"))


@query("select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as usage from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def usage_totals(t: Tables) -> DataFrame:
    chunks = t.events.select("user_id", F.create_map("event_type", F.lit(1)).alias("usage"))
    found = media.usage_totals(chunks, "user_id", "usage")
    return found.select("user_id", F.array_join(F.transform(F.map_entries("usage"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("usage"))


@query("select count(*) || 'x ' || event_type as text from events group by event_type")
def error_summary(t: Tables) -> DataFrame:
    return media.error_summary(t.events, "event_type")


@query("select case when quality = 0 then 'failed_gate' else 'passed' end as status, count(*) as n, sha256(string_agg(doc_id::varchar, ',' order by doc_id)) as ids_sha256 from labels group by 1")
def run_summary(t: Tables) -> DataFrame:
    gates = t.labels.select("doc_id", F.when(F.col("quality") == 0, "failed_gate").otherwise("passed").alias("status"))
    return media.run_summary(gates, "doc_id").select("status", "n", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"))


@query("""select p_partkey::varchar as concept_id, case when regexp_matches(lower(p_name || ' ' || p_type), '\\b(apply|applied|application|project|case)\\b') then 'applied'
  when regexp_matches(lower(p_name || ' ' || p_type), '\\b(how to|step|steps|procedure|implement|build|code)\\b') then 'procedural' when regexp_matches(lower(p_name || ' ' || p_type), '\\b(date|history|name|fact|facts)\\b') then 'factual' else 'conceptual' end as knowledge_type, 0.8::double as confidence from part""")
def stand_in_classification(t: Tables) -> DataFrame:
    return models.stand_in_classification(t.part.select(F.col("p_partkey").cast("string").alias("concept_id"), F.col("p_name").alias("label"), F.col("p_type").alias("description")))


@query("select cast(0 as bigint) as n_violations, (select count(*) from part) as n_accepted")
def stand_in_reduction(t: Tables) -> DataFrame:
    inputs = t.part.select(F.col("p_brand").alias("scope_id"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_name").alias("label"), F.col("p_type").alias("description"))
    accepted, sources, assignments = models.stand_in_reduction(inputs)
    found = decisions.decision_violations(accepted, sources, assignments, inputs).select(F.lit(1).alias("v"), F.lit(0).alias("a"))
    both = found.unionByName(accepted.select(F.lit(0).alias("v"), F.lit(1).alias("a")))
    return both.agg(F.sum("v").alias("n_violations"), F.sum("a").alias("n_accepted"))
