"""Queries of normal forms of audits and classifications, of what prompts are told, and of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import answers, models, pages, stages
from corpusloom.plans.base import Tables, query


def _json(c):
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _said(*parts):
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


@query("""select p_partkey as scope_id, case when p_size % 7 = 0 then null when p_size % 3 = 0 then '{}' else '{"a":' || p_size || ',"b":' || to_json(p_name) || '}' end as scores, case when p_size % 7 <> 0 and p_size % 5 <> 0 then p_type end as reliability,
  case when p_size % 7 <> 0 then p_name || '|{"k":' || p_partkey || '}|' || p_size end as findings, case when p_size % 7 = 0 then null when p_size % 2 = 0 then '{"candidate":"' || p_brand || '"}' else '' end as plan, case when p_size % 7 <> 0 then p_brand end as flags,
  case when p_size % 7 = 0 then 'knowledge type quality audit output must be a JSON object' end as problem from part""")
def quality_audit_answers(t: Tables) -> DataFrame:
    """Audits' answers of any size in one form; those that are no object say so."""
    size = F.col("p_size")
    scores = F.when(size % 3 == 0, F.lit("[1]")).otherwise(_said('{"b":', _json(F.col("p_name")), ', "a" : ', size, "}"))
    whole = _said('{"scores":', scores, F.when(size % 5 != 0, _said(',"reliability":', _json(F.col("p_type")))).otherwise(""), ',"findings":[', _json(F.col("p_name")), ',{"k": ', F.col("p_partkey"), "},", size, "]", F.when(size % 2 == 0, _said(',"repair_plan":[{"candidate" : ', _json(F.col("p_brand")), "}]")).otherwise(',"repair_plan":"none"'), ',"flags":[', _json(F.col("p_brand")), "]}")
    rows = t.part.select(F.col("p_partkey").alias("scope_id"), F.when(size % 7 == 0, _json(F.col("p_name"))).otherwise(whole).alias("answer"))
    found = answers.quality_audits(rows, "knowledge type", with_flags=True)
    return found.select("scope_id", "scores", "reliability", F.array_join("findings", "|").alias("findings"), F.array_join("repair_plan", "|").alias("plan"), F.array_join("flags", "|").alias("flags"), "problem")


@query("""select p_brand as scope_id, count(*) as n, string_agg(p_partkey || ':' || lower(p_type) || ':' || p_name || ':' || case when p_size % 3 = 0 then 'null' when p_size % 3 = 1 then p_size::varchar else '"high"' end, ';' order by p_partkey) as classifications from part where p_size % 4 <> 0 group by 1""")
def type_answers(t: Tables) -> DataFrame:
    """Classifications of a brand's parts, one answer a brand; items that are no objects are left out."""
    size = F.col("p_size")
    sure = F.when(size % 3 == 0, ',"confidence":null').when(size % 3 == 1, _said(',"confidence":', size)).otherwise(',"confidence":"high"')
    item = F.when(size % 4 == 0, _json(F.col("p_name"))).otherwise(_said('{"concept_id":" ', F.col("p_partkey"), '","knowledge_type":', _json(_said(F.col("p_type"), " ")), ',"rationale":', _json(F.col("p_name")), sure, "}"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))), lambda x: x["i"])
    rows = t.part.groupBy(F.col("p_brand").alias("scope_id")).agg(listed.alias("_l")).select("scope_id", _said('```json\n{"classifications":[', F.array_join("_l", ","), "]}\n```").alias("_a"))
    found = answers.type_classifications(rows.select("scope_id", F.regexp_replace("_a", "```(json)?", "").alias("answer")))
    shown = F.transform("classifications", lambda x: F.concat_ws(":", x["concept_id"], x["knowledge_type"], x["rationale"], F.coalesce(x["confidence"], F.lit("null"))))
    return found.select("scope_id", F.size("classifications").cast("bigint").alias("n"), F.array_join(shown, ";").alias("classifications")).where("n > 0")


@query("""select p_brand as scope_id, p_partkey as ord, case when p_size % 3 <> 0 then 'c' || (select min(q.p_partkey) from part q where q.p_brand = part.p_brand and q.p_name = part.p_name and q.p_size % 3 <> 0) end as candidate_id, p_type as pruning_reason, 'for ' || p_name as explanation from part""")
def pruned_refs(t: Tables) -> DataFrame:
    """Pruned candidates by the short ids that the registry has for their references (a part's name in its brand)."""
    ref = lambda known: F.struct(F.lit("p").alias("artifact_path"), F.when(known, F.col("p_name")).otherwise(F.concat("p_name", F.lit("?"))).alias("candidate_id"))
    known = F.col("p_size") % 3 != 0
    entries = t.part.where(known).groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("k")).select(F.col("p_brand").alias("scope_id"), F.concat(F.lit("c"), "k").alias("compact_id"), ref(F.lit(True)).alias("candidate_ref"))
    items = t.part.select(F.col("p_brand").alias("scope_id"), F.col("p_partkey").alias("ord"), ref(known).alias("candidate_ref"), F.col("p_type").alias("pruning_reason"), F.concat(F.lit("for "), "p_name").alias("explanation"))
    return stages.refs_with_reason(items, entries)


@query("""with o as (select o_custkey as s, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n, o_orderpriority as p from orders)
select s as subject_id, 'lr' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as namespace, 'L' || k as lesson_id, p as title, 2 as n_candidates, 'r' || k || ':1,3|r:2' as candidates, k % 5 = 0 as blocked from o where k % 3 <> 0""")
def subject_candidate_sources(t: Tables) -> DataFrame:
    """Customers' orders as lessons, two of three with a result: its candidates with their anchors, under the lesson's number."""
    lesson = F.concat(F.lit("L"), "o_orderkey")
    order = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    lessons = t.orders.select(F.col("o_custkey").alias("subject_id"), order.alias("ord"), lesson.alias("lesson_id"), F.col("o_orderpriority").alias("title"))
    evidence = lambda *n: F.array(*(F.struct((F.array(F.struct(F.lit(x).alias("at"))) if x else F.lit(None).cast("array<struct<at:int>>")).alias("anchors")) for x in n))
    concept = lambda i, *n: F.struct(i.alias("reconciled_candidate_id"), F.lit("l").alias("label"), evidence(*n).alias("evidence"))
    concepts = F.array(concept(F.concat(F.lit("r"), "o_orderkey"), 1, 0, 3), concept(F.lit("r"), 2))
    made = t.orders.where("o_orderkey % 3 <> 0").select(lesson.alias("lesson_id"), F.lit("p").alias("artifact_path"), F.when(F.col("o_orderkey") % 5 != 0, "lesson_reconciliation").otherwise("other").alias("artifact_type"), concepts.alias("concepts"))
    shown = F.array_join(F.transform("candidates", lambda x: F.concat(x["candidate_id"], F.lit(":"), F.array_join(F.transform(x["source_anchors"], lambda a: a["at"].cast("string")), ","))), "|")
    return stages.subject_sources(lessons, made).select("subject_id", "namespace", "lesson_id", F.col("source_metadata.lesson_title").alias("title"), F.size("candidates").alias("n_candidates"), shown.alias("candidates"), "blocked")


@query("""select p_partkey as self_study_id, sha256('{"candidate_concepts":[{"candidate_id":"metadata-candidate-' || p_partkey || '-001","label":' || to_json(p_name) || ',"description":"Deterministic workbook-metadata candidate for offline pipeline smoke runs.","coverage_criteria":["Student can summarize the main teaching signal from the workbook row."],"evidence_type":"workbook_metadata","metadata_anchors":[{"kind":"workbook_title","locator":"Title"}],"extraction_reason":{"metadata_grounded_rationale":"Offline fixture preserves the workbook row as a candidate.","granularity_rationale":"One candidate keeps the fixture small while exercising the stage contract."}}]}') as answer_sha256, p_name as label from part""")
def metadata_candidates(t: Tables) -> DataFrame:
    """What the stand-in answers to metadata alone, and what the normal form reads of it."""
    made = models.stand_in_metadata(t.part.select(F.col("p_partkey").alias("self_study_id"), F.col("p_name").alias("title")))
    found = answers.extractions(made, metadata_only=True)
    return found.select("self_study_id", F.sha2(F.col("answer").cast("binary"), 256).alias("answer_sha256"), F.get("candidates", F.lit(0))["label"].alias("label"))


_HEAD = r"""'---' || chr(10) || 'id: "' || page_id || '"' || chr(10) || 'title: ' || to_json(left(html, 200)) || chr(10)"""


@query(rf"""select page_id, sha256({_HEAD} || 'source_url: ' || to_json(url) || chr(10) || 'fetch_url: ' || to_json(url || '#f') || chr(10) || 'resolved_url: ' || case when page_id % 3 = 0 then 'null' else to_json(url) end || chr(10) || 'firecrawl_title: null' || chr(10) || 'description: "d"' || chr(10)
  || 'fetched_at: "2024-01-01"' || chr(10) || 'provider: "firecrawl"' || chr(10) || 'strategy: "direct"' || chr(10) || 'cache_key: "k"' || chr(10) || 'firecrawl_status_code: ' || 200 + page_id % 5 || chr(10) || 'firecrawl_content_type: null' || chr(10) || 'word_count: ' || len(regexp_extract_all(html, '[\p{{L}}\p{{N}}_]+')) || chr(10)
  || 'char_count: ' || length(html) || chr(10) || 'content_sha256: "' || sha256(html) || '"' || chr(10) || 'image_count: ' || page_id % 4 || chr(10) || 'link_count: 0' || chr(10) || case when page_id % 2 = 0 then 'warnings:' || chr(10) || '  - "w ' || page_id || '"' || chr(10) || '  - "x"' else 'warnings: []' end || chr(10)
  || 'gate_status: "ok"' || chr(10) || 'gate_failures: []' || chr(10) || 'route_notes: []' || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(html, '\s+$', '') || chr(10)) as sha256 from pages""")
def article_pages(t: Tables) -> DataFrame:
    """Pages as stored articles: every page's text behind its front matter."""
    k, no = F.col("page_id"), F.lit(None).cast("string")
    found = F.struct(F.when(k % 3 == 1, F.col("url")).otherwise("").alias("url"), F.when(k % 3 != 0, F.col("url")).alias("sourceURL"), no.alias("title"), F.lit("d").alias("description"), (200 + k % 5).alias("statusCode"), no.alias("contentType"))
    many = "array<string>"
    rows = t.pages.select(
        "page_id", k.cast("string").alias("id"), F.left("html", F.lit(200)).alias("title"), "url", F.concat("url", F.lit("#f")).alias("fetch_url"), F.lit("direct").alias("strategy"), F.array().cast(many).alias("notes"), F.lit("k").alias("cache_key"), F.lit("2024-01-01").alias("fetched_at"), F.col("html").alias("content"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("w "), k), F.lit("x"))).alias("warnings"), F.lit("ok").alias("gate_status"), F.array().cast(many).alias("gate_failures"), found.alias("metadata"), (k % 4).alias("n_images"), F.lit(None).cast("int").alias("n_links"),
    )
    return pages.articles(rows).select("page_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("sha256"))
