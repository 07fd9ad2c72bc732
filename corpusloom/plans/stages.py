"""Queries of stages' inputs, caches, addresses and failures, made of whole tables by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import access, joins, stages, transcripts
from corpusloom.plans.base import Tables, query
from corpusloom.sources import artifacts

_STRINGS = "array<string>"


@query("""select s.stage, o_orderkey::varchar as scope_id, case when o_orderkey % 3 = 0 or s.stage = 'merge' then 'missing required input artifact' else 'input artifact is not valid JSON' end as problem from orders, (values ('ledger'), ('merge')) as s(stage) where o_orderkey % 3 = 0 or s.stage = 'merge' or o_orderkey % 5 = 0""")
def required_artifacts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    made = t.orders.where(k % 3 != 0).select(F.lit("ledger").alias("stage"), k.cast("string").alias("scope_id"), F.when(k % 5 == 0, "{broken").otherwise('{"a":1}').alias("payload"))
    return artifacts.required(made, ("ledger", "merge"), t.orders.select(k.cast("string").alias("scope_id")))


def _cache(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    requests = t.customer.select(k.alias("id"), F.concat(F.lit("e"), k).alias("exact"), F.concat(F.lit("n"), "c_nationkey").alias("loose"))
    exact = t.customer.where(k % 4 == 0).select(F.concat(F.lit("e"), k).alias("cache_key"), F.explode(F.array(F.struct(F.lit("old").alias("payload"), F.lit(1).alias("s")), F.struct(F.col("c_name").alias("payload"), F.lit(2).alias("s")))).alias("_x"))
    loose = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("cache_key"), F.struct(F.col("n_name").alias("payload"), F.lit(1).alias("s")).alias("_x"))
    return requests, exact.unionByName(loose).select("cache_key", "_x.payload", F.timestamp_seconds("_x.s").alias("fetched_at"))


@query("""select c_custkey as id, case when c_custkey % 4 = 0 then c_name when n_nationkey % 2 = 0 then n_name end as payload, case when c_custkey % 4 = 0 then 'exact' when n_nationkey % 2 = 0 then 'loose' end as hit from customer left join nation on n_nationkey = c_nationkey""")
def cached_answers(t: Tables) -> DataFrame:
    return artifacts.cached(*_cache(t), ("exact", "loose")).select("id", "payload", "hit")


@query("select c_custkey as id from customer left join nation on n_nationkey = c_nationkey where c_custkey % 4 <> 0 and coalesce(n_nationkey % 2, 1) <> 0")
def pending_requests(t: Tables) -> DataFrame:
    return artifacts.pending(*_cache(t), ("exact", "loose")).select("id")


@query("select event_id as cache_key, 0 as pos, event_type as text, value as start_seconds from events where event_id % 3 = 0 union all select event_id, 1, '', null from events where event_id % 3 = 0")
def cached_transcripts(t: Tables) -> DataFrame:
    one = F.struct(F.array(F.struct(F.col("event_type").alias("text"), F.col("value").alias("start_seconds"))).alias("segments"))
    whole = F.replace(F.to_json(one), F.lit("}]}"), F.lit('},{"start_seconds":"odd"}]}'))
    payload = F.when(F.col("event_id") % 3 == 0, whole).when(F.col("event_id") % 3 == 1, "[1]").otherwise("{broken")
    return artifacts.transcripts_of(t.events.select(F.col("event_id").alias("cache_key"), payload.alias("payload"))).select("cache_key", "pos", "text", "start_seconds")


@query("select o_orderkey::varchar as scope_id from orders where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0")
def whole_bundles(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda name, ok: t.orders.select(F.lit(name).alias("stage"), k.cast("string").alias("scope_id"), F.when(ok, '{"a":1}').otherwise("[1]").alias("payload"))
    return artifacts.whole_bundles(part("result", k % 3 != 0).unionByName(part("pages", k % 5 != 0)), ("result", "pages"))


@query("""select page_id, case when host like '%.example.com' or host = 'example.com' then 'com' when host like '%.net' then 'net' end as value from (select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host from pages)""")
def host_settings(t: Tables) -> DataFrame:
    settings = t.region.limit(0).select(F.lit("").alias("host"), F.lit("").alias("value"))
    for host, value in (("example.com", "com"), ("net", "net")):
        settings = settings.unionByName(t.spark.range(1).select(F.lit(host).alias("host"), F.lit(value).alias("value")))
    return access.host_settings(t.pages.select("page_id", "url"), "url", settings).select("page_id", "value")


@query("""select p_partkey, p_partkey % 6 in (0, 1) as book, p_partkey % 6 = 0 as reader, p_partkey % 6 = 2 as terminal, p_partkey % 6 in (0, 1, 3) as handoff, p_partkey % 6 = 4 as login from part""")
def reader_addresses(t: Tables) -> DataFrame:
    k, code = F.col("p_partkey"), F.concat(F.lit("B"), F.col("p_partkey"))
    at = lambda *p: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in p))
    url = (
        F.when(k % 6 == 0, at("https://integrada.minhabiblioteca.com.br/reader/books/", code, "/pageid/3")).when(k % 6 == 1, at("https://integrada.minhabiblioteca.com.br/books/", code))
        .when(k % 6 == 2, F.lit("https://philos.sophia.com.br/terminal/9418/x")).when(k % 6 == 3, F.lit("https://jigsaw.minhabiblioteca.com.br/auth/redirects/1")).when(k % 6 == 4, F.lit("https://login.vitalsource.com/x")).otherwise(at("https://other.com/books/", code))
    )
    return t.part.select("p_partkey", access.is_book_address(url, code).alias("book"), access.is_reader_page(url, code).alias("reader"), access.is_terminal(url).alias("terminal"), access.may_hand_over(url, code).alias("handoff"), access.is_login(url).alias("login"))


@query("""select p_partkey, case p_partkey % 3 when 0 then p_partkey::varchar when 1 then p_size::varchar else '' end as code, 'https://philos.sophia.com.br/terminal/' || case when p_partkey % 2 = 0 then '77' else '9418' end || '/IntegracaoDigital/ExecutarSingleSignOn?codigoSubcampo=' || p_partkey as address from part""")
def catalogue_codes(t: Tables) -> DataFrame:
    k, code = F.col("p_partkey"), F.concat(F.lit("B"), F.col("p_partkey"))
    item = F.concat(F.lit('{&quot;Codigo&quot;: '), k, F.lit(',&quot;URL&quot;:&quot;https://integrada.minhabiblioteca.com.br/books/'), code, F.lit("&quot;}"))
    loose = F.concat(F.repeat(F.lit("x"), F.lit(900)), F.lit(' "Codigo" : '), "p_size", F.lit(" and /books/"), code)
    html = F.when(k % 3 == 0, F.concat(F.lit('<a>{"Codigo":5,"URL":"https://x.y/books/'), code, F.lit('"}'), item)).when(k % 3 == 1, loose).otherwise("nothing")
    terminal = F.when(k % 2 == 0, "https://philos.sophia.com.br/terminal/77/y").otherwise("https://philos.sophia.com.br/start")
    return t.part.select("p_partkey", access.subfield_code(html, code).alias("code"), access.sign_on_address(terminal, k.cast("string")).alias("address"))


@query("""select event_id, case when event_id % 3 = 0 then 'https://a.b/' || event_id end as address, case event_id % 4 when 0 then 'DeepSeek HTTP 429' when 1 then 'DeepSeek request timed out' end as reason, case when event_id % 2 = 0 then 'format_repair' else 'contextual_repair' end as kind,
  case when event_id % 2 = 1 and event_id % 5 <> 0 then 'deep' when event_id % 7 <> 0 then 'quick' else 'own' end as route, event_id % 4 = 2 as with_file from events""")
def failures(t: Tables) -> DataFrame:
    k = F.col("event_id")
    payload = F.when(k % 3 == 0, F.concat(F.lit('{"https://key":[1,{"b":"see https:\\/\\/a.b\\/'), k, F.lit('."}]}'))).when(k % 3 == 1, "[1]").otherwise("https://c.d")
    message = F.when(k % 4 == 0, "x DeepSeek HTTP 429 y").when(k % 4 == 1, "DeepSeek request timed out").when(k % 4 == 2, "PERMISSION_DENIED").otherwise("odd")
    errors = F.when(k % 2 == 0, F.array(F.lit("JSON parse error at 1"), F.lit("a must be a JSON object"))).otherwise(F.array(F.lit("JSON parse error"), F.lit("b.id is required")))
    kind = access.repair_type(errors)
    route = access.repair_route(kind, F.lit("own"), F.when(k % 7 != 0, "quick"), F.when(k % 5 != 0, "deep"))
    return t.events.select("event_id", access.address_in_json(payload).alias("address"), access.pressure_reason(message).alias("reason"), kind.alias("kind"), route.alias("route"), access.retry_with_file(message, F.lit("https://youtu.be/abcdef1"), F.lit("external_uri")).alias("with_file"))


@query("""select conv_id, turn, case conv_id % 5 when 0 then 'empty' when 1 then 'very_low_word_count,language_mismatch' when 2 then 'repeated_lines' when 3 then 'repeated_phrase' else '' end as reasons from conversations""")
def unusable_transcripts(t: Tables) -> DataFrame:
    k = F.col("conv_id") % 5
    said = F.when(k == 0, " - \n").when(k == 1, "Thanks for watching!").when(k == 2, "one line here\nOne line here \none line here\none line here").when(k == 3, "Say it. say it! Say it? say it. More words").otherwise("this is a text. it has nothing odd. nor the same again")
    duration = F.when(k == 1, 300.0).when(k == 2, 30.0)
    return t.conversations.select("conv_id", "turn", F.array_join(transcripts.unusable_reasons(said, duration, F.when(k == 1, "pt-BR").otherwise("en")), ",").alias("reasons"))


@query("""with s as (select case when p_partkey % 5 = 0 then '' else p_brand end as lesson_id, p_partkey as k, p_partkey::varchar as id from part where p_brand is not null), r as (select lesson_id, k, id, 1 as p, 'c' || id || '_deep_seek' as ns, 'source_body' as kind from s where k % 2 = 0 and lesson_id <> ''
  union all select lesson_id, k, id, 2, 'c' || id || '_unknown', 'source_body' from s where k % 4 = 0 and lesson_id <> '' union all select lesson_id, k, id, 3, 'c' || id || '_metadata', 'metadata_only' from s where k % 3 = 0 and k % 2 = 1 and lesson_id <> '')
select lesson_id as scope_id, row_number() over (partition by lesson_id order by k, p)::integer as ord, ns as namespace, kind as evidence_type, id as self_study_id from r""")
def candidate_sources(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    studies = t.part.where(k % 5 != 0).select(F.col("p_brand").alias("lesson_id"), k.alias("ord"), k.cast("string").alias("self_study_id"))
    each = F.explode(F.array(F.struct(F.lit(1).alias("pass_ord"), F.lit("Deep-Seek").alias("model_route")), F.struct(F.lit(2).alias("pass_ord"), F.lit("?").alias("model_route"))))
    passes = t.part.where(k % 2 == 0).select(k.alias("_k"), k.cast("string").alias("self_study_id"), each.alias("_x"), F.lit("a").alias("artifact_path"), F.array("p_name").alias("candidates")).where("_x.pass_ord = 1 or _k % 4 = 0").select("self_study_id", "_x.pass_ord", "_x.model_route", "artifact_path", "candidates")
    metadata = t.part.where(k % 3 == 0).select(k.cast("string").alias("self_study_id"), F.lit("m").alias("model_route"), F.lit("b").alias("artifact_path"), (k % 2 == 0).alias("excluded"), F.array("p_type").alias("candidates"))
    return stages.candidate_sources(studies, passes, metadata).select("scope_id", "ord", "namespace", "evidence_type", "self_study_id")


@query("select case when p_partkey % 5 = 0 then '' else p_brand end as lesson_id, string_agg(p_partkey::varchar, ',' order by p_partkey) as ids from part group by 1")
def studies_by_lesson(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(F.when(k % 5 != 0, F.col("p_brand")).alias("lesson_id"), k.alias("ord"), k.cast("string").alias("self_study_id"))
    return stages.by_lesson(rows).select("lesson_id", F.array_join("self_study_ids", ",").alias("ids"))


@query("select p_brand as lesson_id, p_size as self_study_id, count(*) as n_passes, sum(p_partkey % 9) as n_candidates, string_agg('r' || p_partkey, ',' order by p_partkey) as passes from part group by 1, 2")
def extraction_sets(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    found = stages.extraction_sets(t.part.select(F.col("p_brand").alias("lesson_id"), F.col("p_size").alias("self_study_id"), k.alias("ord"), F.concat(F.lit("r"), k).alias("pass_id"), (k % 9).alias("n_candidates")))
    return found.withColumn("passes", F.array_join(F.transform("passes", lambda x: x["pass_id"]), ","))


@query("""select p_partkey, case when p_partkey % 11 = 0 then 'concept_id' when p_partkey % 7 = 0 then 'label' when p_partkey % 5 = 0 then 'teaching description' when p_partkey % 3 = 0 then 'Coverage Criteria' end as problem, case when p_partkey % 5 = 0 then '' when p_partkey % 2 = 0 then p_type else p_name end as teaching_description from part""")
def required_fields(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(
        F.when(k % 11 != 0, k.cast("string")).alias("concept_id"), F.when(k % 7 == 0, " ").otherwise(F.col("p_name")).alias("label"), F.when((k % 5 != 0) & (k % 2 == 0), F.concat(F.lit(" "), "p_type")).alias("teaching_description"),
        F.when(k % 5 == 0, " ").otherwise(F.col("p_name")).alias("description"), F.array(F.when(k % 3 == 0, " ").otherwise(F.concat("p_name", F.lit("#"), k))).alias("coverage_criteria"),
    )
    key = F.coalesce(F.col("concept_id").cast("bigint"), F.lit(None))
    found = stages.required_fields(rows.withColumn("concept_id", F.coalesce("concept_id", F.lit("")))).where("concept_id <> ''").withColumn("p_partkey", key)
    lost = t.part.where(k % 11 == 0).select("p_partkey", F.lit("concept_id").alias("problem"), F.when(k % 5 == 0, "").when(k % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("teaching_description"))
    return found.select("p_partkey", "problem", "teaching_description").unionByName(lost)


@query("""with g as (select l_orderkey as lesson_id, l_suppkey % 3 as s, list(distinct 'p' || l_partkey order by 'p' || l_partkey) as ids from lineitem where l_quantity > 10 group by 1, 2)
select row_number() over (order by lesson_id, s) as task, lesson_id, 's' || s as segment_id, array_to_string(ids, ',') as concept_ids, array_to_string(list_filter(ids, lambda x: x[2:]::bigint % 10 = 0), ',') as unknown from g""")
def classification_tasks(t: Tables) -> DataFrame:
    name = F.concat(F.lit("p"), F.col("l_partkey"))
    segments = t.lineitem.groupBy(F.col("l_orderkey").alias("lesson_id"), (F.col("l_suppkey") % 3).alias("segment_ord")).agg(F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 10, name))).alias("concept_ids")).withColumn("segment_id", F.concat(F.lit("s"), "segment_ord"))
    known = t.part.where("p_partkey % 10 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("concept_id"))
    found = stages.classification_tasks(segments, known)
    return found.select("task", "lesson_id", "segment_id", F.array_join("concept_ids", ",").alias("concept_ids"), F.array_join("unknown", ",").alias("unknown"))


@query("select p_name as label, p_partkey as ord from part where p_size % 4 = 1")
def labels_for_pattern(t: Tables) -> DataFrame:
    return stages.labels_for(t.part.select(F.col("p_name").alias("label"), (F.col("p_size") % 4).cast("string").alias("pattern"), F.col("p_partkey").alias("ord")), "1")


def _attempts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    one = lambda n, ids: F.struct(F.lit(n).alias("label"), ids.alias("source_candidate_ids"))
    two, none = F.array(F.lit("c1"), F.lit("c2")), F.lit(None).cast(_STRINGS)
    decisions = t.orders.select(k.alias("cluster_id"), F.when(k % 3 == 0, F.array(F.lit("c1"), F.lit(""))).otherwise(two).alias("input_candidate_ids"), F.when(k % 2 == 0, F.array(one("a", two))).otherwise(F.array(one("a", F.array(F.lit("c1"))), one("b", none))).alias("accepted"))
    return stages.merge_attempts(decisions, t.orders.where(k % 5 != 0).select(k.alias("cluster_id"), F.col("o_orderpriority").alias("label")))


@query("select o_orderkey as cluster_id, case when o_orderkey % 5 <> 0 then o_orderpriority end as cluster_label, case when o_orderkey % 2 = 0 then 'a' else 'a,b' end as accepted_labels, case when o_orderkey % 2 = 0 then 'merged' else 'kept_separate' end as outcome from orders where o_orderkey % 3 <> 0")
def merge_attempts(t: Tables) -> DataFrame:
    return _attempts(t).select("cluster_id", "cluster_label", F.array_join("accepted_labels", ",").alias("accepted_labels"), "outcome")


@query("""with p as (select p_partkey, p_brand, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-zA-ZÀ-ÖØ-öø-ÿ0-9]+'), lambda w: length(w) > 1 and w not in ('a','an','and','com','de','do','da','das','dos','e','em','for','in','o','of','os','the','to','um','uma','with'))) as t from part),
j as (select a.p_partkey as l, b.p_partkey as r, len(list_intersect(a.t, b.t)) as i, len(a.t) + len(b.t) as s from p a join p b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey)
(select 'same_fine_cluster_kept_separate' as signal, o_orderkey::varchar as subject, 'c1,c2' as detail from orders where o_orderkey % 3 <> 0 and o_orderkey % 2 = 1 order by o_orderkey limit 24) union all (select 'high_text_overlap_concept_pairs', l::varchar, r::varchar from j where i > 0 and i / (s - i) >= 0.35 order by i / (s - i) desc, l, r limit 24)""")
def review_signals(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", X.title_tokens("p_name").alias("tokens"))
    return stages.review_signals(_attempts(t), joins.most_similar(rows, "p_partkey", "tokens", 0.35, "p_brand"))


@query("""select p_brand as scope_id, count(*) as input_candidate_count, count(*) filter (where p_size % 2 = 0) as concept_count, count(*) filter (where p_size % 3 = 0) as pruned_candidate_count, count(*) filter (where p_size % 3 = 1) as review_candidate_count from part group by 1""")
def merge_summary(t: Tables) -> DataFrame:
    rows = t.part.withColumnRenamed("p_brand", "scope_id")
    status = F.when(F.col("p_size") % 3 == 0, "pruned").when(F.col("p_size") % 3 == 1, "review").otherwise("used_in")
    return stages.merge_summary(rows, rows.where("p_size % 2 = 0"), rows.select("scope_id", status.alias("status")))
