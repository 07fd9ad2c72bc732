"""Queries of joins, ordinals, windows, covers, audits and graphs over the star schema and the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import audit, cover, decisions, graph, joins, windows
from corpusloom.plans.base import Tables, query
from corpusloom.streaming import progress


@query("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_labels(t: Tables) -> DataFrame:
    return joins.unresolved(t.documents.select("doc_id"), "doc_id", t.labels)


@query("""with a as (select c_nationkey, c_mktsegment, arg_max(c_name, c_custkey) as v from customer group by 1, 2), b as (select c_nationkey, arg_max(c_name, c_custkey) as v from customer group by 1)
select s_suppkey, coalesce(a.v, b.v) as c_name, case when a.v is not null then 'exact' when b.v is not null then 'fallback' else 'none' end as matched_by
from (select s_suppkey, s_nationkey, case when s_suppkey % 3 = 0 then 'BUILDING' else 'OTHER' end as seg from supplier) s left join a on a.c_nationkey = s_nationkey and a.c_mktsegment = seg left join b on b.c_nationkey = s_nationkey""")
def ledger_two_step_lookup(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").otherwise("OTHER").alias("segment"))
    lookup = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_name", "c_custkey")
    return joins.two_step_lookup(rows, lookup, ["nation", "segment"], ["nation"], "c_name", "c_custkey").select("s_suppkey", "c_name", "matched_by")


@query("""select l_suppkey as supplier, count(distinct l_orderkey) as n_orders from lineitem group by 1""")
def nested_occurrences(t: Tables) -> DataFrame:
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("supplier"))).alias("items"))
    return joins.occurrences(orders, "l_orderkey", "items", "supplier").groupBy("supplier").agg(F.count("*").alias("n_orders"))


@query("""with x as (select trim(v) as label, 0 as g, p_partkey as o, i, cast(p_partkey as varchar) as context from part, unnest(string_split(p_type, ' ')) with ordinality as t(v, i)
  union all select c_mktsegment, 1, c_custkey, 1, cast(c_custkey as varchar) from customer)
select label, sha256(string_agg(context, ',' order by g, o, i)) as contexts_sha256, count(*) as n from x group by label""")
def label_contexts(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", X.split_labels(F.replace("p_type", F.lit(" "), F.lit(";"))).alias("labels"))
    customers = t.customer.select("c_custkey", F.array("c_mktsegment").alias("labels"))
    found = joins.label_contexts((parts, "labels", "p_partkey", "p_partkey"), (customers, "labels", "c_custkey", "c_custkey"))
    return found.select("label", F.sha2(F.array_join("contexts", ",").cast("binary"), 256).alias("contexts_sha256"), "n")


@query("select conv_id, turn, 'c' || conv_id || '_' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as compact_id from (select *, row_number() over (partition by conv_id order by turn) as n from conversations)")
def registry_ids(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id")).alias("namespace"))
    return cover.compact_ids(rows, "namespace", "turn").select("conv_id", "turn", "compact_id")


@query("select c_custkey, upper(left(regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g'), 6)) || '-' || case when k < 1000 then lpad(k::varchar, 3, '0') else k::varchar end as display_code from (select c_custkey, n_name, row_number() over (partition by n_name order by c_custkey) as k from customer join nation on c_nationkey = n_nationkey)")
def display_codes(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return windows.display_codes(rows, X.display_prefix("n_name"), "n_name", "c_custkey").select("c_custkey", "display_code")


@query("""with n as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as k from conversations)
select conv_id, k // 4 + 1 as batch, k % 4 + 1 as batch_pos, turn from n""")
def batches_of_four(t: Tables) -> DataFrame:
    return cover.batches(t.conversations.select("conv_id", "turn"), "conv_id", "turn", 4).select("conv_id", "batch", "batch_pos", "turn")


@query("""with n as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as k from conversations)
select conv_id, conv_id || '-S' || lpad((k // 4 + 1)::varchar, greatest(2, length((k // 4 + 1)::varchar))::integer, '0') as segment_code, min(turn)::varchar || case when count(*) > 1 then ' and related ideas' else '' end as label, count(*) as n_members from n group by conv_id, k // 4""")
def segments_of_four(t: Tables) -> DataFrame:
    found = windows.segments_by_size(t.conversations.select("conv_id", "turn", F.col("turn").alias("label")), "conv_id", "turn")
    return found.select("conv_id", "segment_code", "label", F.size("members").cast("bigint").alias("n_members"))


@query("select conv_id, turn, coalesce(lead(turn * 10.0::double) over (partition by conv_id order by turn), 1000.0::double) as section_end from conversations")
def section_ends(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", (F.col("turn") * 10).cast("double").alias("at"))
    return joins.with_next_start(rows, "conv_id", "at", "turn", F.lit(1000.0)).select("conv_id", "turn", "section_end")


_SPANS = "select user_id, epoch(max(ts)) - epoch(min(ts)) as d from events group by user_id"
_CHUNKS = f"""with recursive u as ({_SPANS}), w as (
  select user_id, d, 1 as i, 0.0::double as s, case when d - least(d, 86400.0) < 0 then d else least(d, 86400.0) end as e from u where d > 100000
  union all select user_id, d, i + 1, e - 7200, case when d - least(d, e - 7200 + 86400) < 30 then d else least(d, e - 7200 + 86400) end from w where e < d)
"""


@query(_CHUNKS + "select user_id, i::bigint as index, round(s, 3) as start_seconds, round(e, 3) as end_seconds from w union all select user_id, 1, null, null from u where d <= 100000")
def chunk_windows(t: Tables) -> DataFrame:
    return windows.chunk_windows(_spans(t), "user_id", "d", 100_000, 86_400, 7_200)


def _spans(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.groupBy("user_id").agg((F.max(at) - F.min(at)).alias("d"))


@query(_CHUNKS + """, o as (select user_id, min(epoch(ts)) as zero from events group by user_id), r as (select e.user_id, event_id, epoch(ts) - zero as rel from events e join o using (user_id))
select r.user_id, event_id, w.i::bigint as index from r join w on r.user_id = w.user_id and rel + 60 >= round(s, 3) and rel <= round(e, 3)""")
def window_overlap_join(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    zero = t.events.groupBy("user_id").agg(F.min(at).alias("zero"))
    segments = t.events.join(zero, "user_id").select("user_id", "event_id", (at - F.col("zero")).alias("start"), (at - F.col("zero") + 60).alias("end"))
    spans = windows.chunk_windows(_spans(t), "user_id", "d", 100_000, 86_400, 7_200).where("start_seconds is not null")
    return joins.overlapping(segments, spans, "user_id", "start", "end", "start_seconds", "end_seconds", 86_400.0).select("user_id", "event_id", "index")


@query("""with m as (select l_orderkey as scope_id, l_suppkey % 5 as cluster_ord, l_linenumber as pos, l_partkey as candidate_id from lineitem),
k as (select scope_id, candidate_id, min((cluster_ord, pos)) as first from m where candidate_id % 7 <> 0 group by 1, 2),
i as (select distinct scope_id, candidate_id from m where candidate_id % 7 <> 0 union select o_orderkey, -o_orderkey from orders),
a as (select scope_id, candidate_id, row_number() over (partition by scope_id order by candidate_id) as n from i anti join k using (scope_id, candidate_id))
select scope_id, 'c' || first[1] as cluster_id, candidate_id, 'kept' as origin from (select scope_id, candidate_id, [first[1], first[2]] as first from k)
union all select scope_id, 'added_' || lpad(n::varchar, 3, '0'), candidate_id, 'added' from a""")
def partition_repair(t: Tables) -> DataFrame:
    members, inputs = _cover_tables(t)
    return cover.repair(members, inputs).select("scope_id", "cluster_id", "candidate_id", "origin")


def _cover_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Order lines as memberships; every seventh part is unknown, and each order has one input that no cluster holds."""
    line = t.lineitem.select(F.col("l_orderkey").alias("scope_id"), F.col("l_partkey").alias("candidate_id"), (F.col("l_suppkey") % 5).alias("cluster_ord"), F.col("l_linenumber").alias("pos"))
    members = line.withColumn("cluster_id", F.concat(F.lit("c"), F.col("cluster_ord")))
    inputs = line.where("candidate_id % 7 <> 0").select("scope_id", "candidate_id", F.col("candidate_id").alias("ord"))
    return members, inputs.unionByName(t.orders.select(F.col("o_orderkey").alias("scope_id"), (-F.col("o_orderkey")).alias("candidate_id"), F.lit(-1).cast("bigint").alias("ord")))


@query("""with m as (select l_orderkey as scope_id, l_partkey as candidate_id, count(*) as n from lineitem group by 1, 2),
i as (select distinct l_orderkey as scope_id, l_partkey as candidate_id from lineitem where l_partkey % 7 <> 0 union select o_orderkey, -o_orderkey from orders)
select * from (select scope_id, candidate_id, case when i.candidate_id is null then 'unknown' when n is null then 'missing' when n > 1 then 'repeated' end as violation
  from m full join (select *, true as k from i) i using (scope_id, candidate_id)) where violation is not null""")
def exact_cover_violations(t: Tables) -> DataFrame:
    return cover.violations(*_cover_tables(t))


@query("""with f as (select l_orderkey, l_returnflag as v, min(l_linenumber) as o from lineitem group by 1, 2) select l_orderkey, string_agg(v, ',' order by o, v) as flags from f group by 1""")
def ordered_union(t: Tables) -> DataFrame:
    return joins.ordered_union(t.lineitem, "l_orderkey", "l_returnflag", "l_linenumber").select("l_orderkey", F.array_join("values", ",").alias("flags"))


@query("""with f as (select user_id, event_type as v, min(event_id) as o from events group by 1, 2) select user_id, string_agg(v, ',' order by o) as kinds from f group by 1""")
def stable_unique(t: Tables) -> DataFrame:
    return cover.stable_unique(t.events, "user_id", "event_type", "event_id").select("user_id", F.array_join("values", ",").alias("kinds"))


@query("""with r as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by event_id) as k from events)
select user_id, event_type, min(event_id) as first_repeat, count(*) + 1 as n from r where k > 1 group by 1, 2""")
def repeated_values(t: Tables) -> DataFrame:
    return cover.duplicates(t.events, "user_id", "event_type", "event_id")


@query("select user_id, cast(count(*) filter (where event_type = 'click') as bigint) as n_click, cast(count(*) filter (where event_type = 'view') as bigint) as n_view, cast(count(*) filter (where event_type = 'purchase') as bigint) as n_purchase, cast(count(*) filter (where event_type = 'error') as bigint) as n_error, count(*) as n from events group by 1")
def type_distribution(t: Tables) -> DataFrame:
    return audit.distribution(t.events, "user_id", "event_type", ("click", "view", "purchase", "error"))


@query("select user_id, arg_min(event_type, event_id) as chosen, count(distinct event_type) as n_values, count(distinct event_type) > 1 as conflict from events group by 1")
def classification_conflicts(t: Tables) -> DataFrame:
    return audit.conflicts(t.events, "user_id", "event_type", "event_id")


@query("""with d as (select l_suppkey, case when l_quantity > 40 then 'math' when l_quantity > 20 then 'application' else 'definition' end as v from lineitem)
select s_suppkey, case when count(v) = 0 then 'definition' when min(v) = max(v) then min(v) else 'mixed' end as depth from supplier left join d on s_suppkey = l_suppkey group by 1""")
def merged_depth(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    d = t.lineitem.select("l_suppkey", F.when(q > 40, "math").when(q > 20, "application").otherwise("definition").alias("v"))
    return audit.merged_depth(t.supplier.join(d, F.col("s_suppkey") == F.col("l_suppkey"), "left"), "s_suppkey", "v")


_AUDIT = """with a as (select l_orderkey % 500 as lesson_id, case when l_linestatus = 'O' and l_returnflag = 'N' then 'used_in' when l_returnflag = 'R' then 'pruned' when l_returnflag = 'A' and l_linenumber < 3 then 'merged_into' when l_returnflag = 'A' then 'review' else 'used_in' end as status,
  case when l_suppkey % 7 = 1 then 'near_duplicate' else 'incidental' end as reason, l_linenumber % 2 = 0 as body from lineitem),
g as (select lesson_id, count(*) as n, count(*) filter (where status = 'review') as n_review, count(*) filter (where status = 'pruned') as n_pruned, count(*) filter (where status = 'merged_into') as n_merged,
  count(*) filter (where status = 'pruned' and reason = 'near_duplicate') as near, count(*) filter (where body) as n_body from a group by 1),
c as (select o_orderkey % 500 as lesson_id, count(*) as n_accepted, max(1 + o_custkey % 6) as largest, sum(1 + o_custkey % 6) as n_src, count(*) filter (where o_custkey % 2 = 0) as n_meta, count(*) - count(distinct trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g'))) as n_same from orders group by 1),
m as (select g.*, coalesce(n_accepted, 0) as n_accepted, coalesce(largest, 0) as largest, coalesce(n_src, 0) as n_src, coalesce(n_meta, 0) as n_meta, coalesce(n_same, 0) as n_same,
  n_review / n as review_ratio, n_pruned / n as pruned_ratio, coalesce(n_accepted, 0) / n as accepted_ratio, n_merged / n as merged_ratio from g left join c using (lesson_id)),
f as (select *, list_sort(list_filter([case when n_review > 0 then 'review_needed' end, case when near > 0 and pruned_ratio >= 0.25 then 'questionable_prune' end, case when near > 0 and pruned_ratio >= 0.25 then 'granularity_loss' end,
  case when accepted_ratio < 0.15 and pruned_ratio > 0.5 then 'over_pruned' end, case when n >= 5 and accepted_ratio < 0.25 and pruned_ratio < 0.25 and (largest >= 5 or merged_ratio >= 0.5) then 'over_merged' end,
  case when n_same > 0 then 'fragmented_duplicates' end, case when n_body > 0 and n_meta >= 2 and n_meta / greatest(n_accepted, 1) >= 0.5 then 'metadata_overreach' end,
  case when n >= 6 and accepted_ratio >= 0.85 and pruned_ratio <= 0.05 and n_src > 1 then 'over_accepted' end], lambda x: x is not null)) as flags from m)
select lesson_id, array_to_string(flags, ',') as flags, review_ratio, pruned_ratio, accepted_ratio, merged_ratio,
  cast(case when review_ratio >= 0.2 or (pruned_ratio >= 0.5 and near > 0) then least(1, greatest(0, 3 - len(flags))) else greatest(0, 3 - len(flags)) end as integer) as net_score from f"""


@query(_AUDIT)
def lesson_quality_audit(t: Tables) -> DataFrame:
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    status = F.when((F.col("l_linestatus") == "O") & (flag == "N"), "used_in").when(flag == "R", "pruned").when((flag == "A") & (n < 3), "merged_into").when(flag == "A", "review").otherwise("used_in")
    assignments = t.lineitem.select(
        (F.col("l_orderkey") % 500).alias("lesson_id"), F.col("l_partkey").alias("candidate_id"), status.alias("status"), F.when(F.col("l_suppkey") % 7 == 1, "near_duplicate").otherwise("incidental").alias("reason"),
        F.lit("because").alias("explanation"), F.when(n % 2 == 0, "source_body").otherwise("metadata").alias("evidence"),
    )
    accepted = t.orders.select(
        (F.col("o_orderkey") % 500).alias("lesson_id"), F.col("o_orderkey").alias("concept_id"), F.col("o_orderpriority").alias("label"), F.lit("an order").alias("description"),
        (1 + F.col("o_custkey") % 6).alias("n_sources"), (F.col("o_custkey") % 2 == 0).alias("metadata_only"),
    )
    return audit.lesson_audit(assignments, accepted).select("lesson_id", F.array_join("flags", ",").alias("flags"), "review_ratio", "pruned_ratio", "accepted_ratio", "merged_ratio", "net_score")


def _decision(t: Tables) -> dict[str, DataFrame]:
    """Orders as scopes: lines are inputs, those with a discount cite a concept, some have assignments."""
    line = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("l_discount"), F.min("l_returnflag").alias("l_returnflag"))
    line = line.select(F.col("l_orderkey").alias("scope_id"), F.col("l_linenumber").cast("bigint").alias("ord"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("candidate_id"), "l_discount", "l_returnflag")
    none = F.array().cast("array<string>")
    named = line.where("l_returnflag <> 'N'").select("scope_id", "ord", "candidate_id", F.when(F.col("l_returnflag") == "R", "pruned").otherwise("review").alias("status"), none.alias("accepted_ids"), F.lit(None).cast("string").alias("merged_into"), F.lit("incidental").alias("reason"), F.lit("too small").alias("explanation"))
    sources = line.where("l_discount > 0.05").select("scope_id", F.lit("k1").alias("accepted_id"), F.col("ord").alias("pos"), "candidate_id")
    accepted = sources.select("scope_id").distinct().select("scope_id", F.lit(1).alias("ord"), F.lit("k1").alias("id"), F.lit("discounted").alias("label"), F.lit("lines").alias("description"), F.array(F.lit("any")).alias("coverage_criteria"), F.lit("same").alias("merge_rationale"))
    return {"inputs": line.select("scope_id", "ord", "candidate_id"), "assignments": named, "sources": sources, "accepted": accepted}


@query("""select l_orderkey as scope_id, 'c' || l_linenumber as candidate_id, case when l_returnflag = 'R' then 'pruned' when l_returnflag = 'A' then 'review' when l_discount > 0.05 then 'used_in' else 'review' end as status,
  case when l_returnflag = 'N' and l_discount > 0.05 then 'k1' else '' end as accepted_ids from (select l_orderkey, l_linenumber, max(l_discount) as l_discount, min(l_returnflag) as l_returnflag from lineitem group by 1, 2)""")
def canonical_assignments(t: Tables) -> DataFrame:
    d = _decision(t)
    found = decisions.canonical_assignments(d["assignments"], d["sources"], d["inputs"])
    return found.select("scope_id", "candidate_id", "status", F.array_join("accepted_ids", ",").alias("accepted_ids"))


@query("""select l_orderkey as scope_id, 'c' || l_linenumber as subject, 'candidate has no assignment' as violation from (select l_orderkey, l_linenumber, max(l_discount) as l_discount, min(l_returnflag) as l_returnflag from lineitem group by 1, 2) where l_returnflag = 'N'
  union all select l_orderkey, 'c' || l_linenumber, 'dropped candidate is used as evidence' from (select l_orderkey, l_linenumber, max(l_discount) as l_discount, min(l_returnflag) as l_returnflag from lineitem group by 1, 2) where l_returnflag <> 'N' and l_discount > 0.05""")
def decision_violations(t: Tables) -> DataFrame:
    d = _decision(t)
    return decisions.decision_violations(d["accepted"], d["sources"], d["assignments"], d["inputs"])


@query("""select o_orderkey as lesson_id, case when s is null then 'no_segments' else 'segmented' end as status, coalesce(s, '') as members from orders left join
  (select l_orderkey, string_agg(x, ';' order by l_suppkey % 3) as s from (select l_orderkey, l_suppkey % 3 as l_suppkey, string_agg('p' || l_partkey, ',' order by l_linenumber, l_partkey) as x from lineitem where l_quantity > 10 group by 1, 2) group by 1) on l_orderkey = o_orderkey""")
def lesson_segments(t: Tables) -> DataFrame:
    kept = t.lineitem.where("l_quantity > 10")
    segments = kept.select(F.col("l_orderkey").alias("lesson_id"), (F.col("l_suppkey") % 3).alias("segment_ord"), F.lit("s").alias("label"), F.struct("l_linenumber", "l_partkey").alias("concept_ord"), F.concat(F.lit("p"), F.col("l_partkey")).alias("concept_id"))
    lessons = graph.build_lessons(t.orders.select(F.col("o_orderkey").alias("lesson_id")), segments)
    members = F.array_join(F.transform("segments", lambda s: F.array_join(s["concept_ids"], ",")), ";")
    return lessons.select("lesson_id", "status", F.coalesce(members, F.lit("")).alias("members"))


@query("""with p as (select p_partkey, p_name, p_type, p_brand, row_number() over (partition by p_brand order by p_partkey) as k from part)
select '{"concept_id":"p' || p_partkey || '","display_code":"' || left(regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g'), 6) || '-' || case when k < 1000 then lpad(k::varchar, 3, '0') else k::varchar end || '","label":' || to_json(p_name) || ',"knowledge_type":"factual","description":' || to_json(p_type)
  || ',"coverage_criteria":[],"dependencies":{"blocking":[],"hard":[],"soft":[]}}' as concept from p""")
def runtime_graph(t: Tables) -> DataFrame:
    rows = windows.display_codes(t.part, X.display_prefix("p_brand"), "p_brand", "p_partkey")
    found = rows.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("concept_id"), "display_code", F.col("p_name").alias("label"), F.lit("factual").alias("knowledge_type"), F.col("p_type").alias("description"), F.array().cast("array<string>").alias("coverage_criteria"))
    r = graph.runtime(found)
    return r.select(F.to_json(F.struct(*r.columns)).alias("concept"))


@query("""with c as (select 'p' || p_partkey as id, case when p_partkey % 10 = 0 then null when p_partkey % 11 = 0 then 'odd' else 'factual' end as k from part)
select 'classification_missing' as code, id as subject from c where k is null union all select 'classification_unknown_type', id from c where k = 'odd'
union all select 'segment_unknown_concept', 'p' || -n_nationkey from nation where n_nationkey > 0 union all select 'warn_lesson_without_segments', r_regionkey::varchar from region where r_regionkey not in (select n_regionkey from nation where n_nationkey > 0)""")
def graph_input_findings(t: Tables) -> DataFrame:
    found = t.part.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("concept_id"))
    kind = F.when(F.col("p_partkey") % 11 == 0, "odd").otherwise("factual")
    classified = t.part.where("p_partkey % 10 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("concept_id"), kind.alias("knowledge_type"))
    segments = t.nation.where("n_nationkey > 0").select(F.col("n_regionkey").alias("lesson_id"), F.concat(F.lit("p"), -F.col("n_nationkey")).alias("concept_id"))
    return graph.input_findings(found, classified, segments, t.region.select(F.col("r_regionkey").alias("lesson_id")))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n_events from events group by 1, 2")
def progress_counts(t: Tables) -> DataFrame:
    return progress.counts_by_window(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
