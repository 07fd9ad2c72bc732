"""Queries of models' answers, their checks, and the assembly of results, made of whole tables by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import answers, assembly, verdicts
from corpusloom.plans.base import Tables, query

_STRINGS = "array<string>"


def _lines(t: Tables) -> DataFrame:
    """(o, ns): the numbers of each order's lines, once each, ascending."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("ns"))


def _ids(ns: Column, prefix: str = "c") -> Column:
    return F.transform(ns, lambda x: F.concat(F.lit(prefix), x))


_LINES = "with g as (select l_orderkey as o, list(distinct l_linenumber order by l_linenumber) as ns from lineitem group by 1), c as (select o, ns, list_transform(list_filter(ns, lambda x: x % 2 = 1), lambda x: 'c' || x) as odd, list_transform(list_filter(ns, lambda x: x % 2 = 0), lambda x: 'c' || x) as even from g)\n"


@query(_LINES + """select o as scope_id, 1 as cluster_ord, 'k' || o as cluster_id, 'odd ones' as label, 'because' as rationale, array_to_string(odd, ',') as candidate_ids from c where o % 5 <> 0
union all select o, 2, 'cluster_002', 'cluster_002', '', array_to_string(even, ',') from c where o % 5 <> 0""")
def cluster_answers(t: Tables) -> DataFrame:
    g, o = _lines(t), F.col("o")
    first = F.struct(F.concat(F.lit("k"), o).alias("id"), F.lit("").alias("label"), F.lit("odd ones").alias("name"), F.lit("because").alias("reason"), _ids(F.filter("ns", lambda x: x % 2 == 1)).alias("candidates"))
    second = F.struct(_ids(F.filter("ns", lambda x: x % 2 == 0)).alias("candidate_ids"))
    answer = F.when(o % 10 == 0, "[1]").when(o % 5 == 0, '{"clusters":3}').otherwise(F.concat(F.lit('{"clusters":['), F.to_json(first), F.lit(","), F.to_json(second), F.lit(',"odd"]}')))
    found = answers.clusters(g.select(o.alias("scope_id"), answer.alias("answer")))
    return found.select("scope_id", "cluster_ord", "cluster_id", "label", "rationale", F.array_join("candidate_ids", ",").alias("candidate_ids"))


def _half(ns: Column, k: int) -> Column:
    return _ids(F.filter(ns, lambda x: x % 2 == k))


def _plan(ns: Column) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("label"), _half(ns, k).alias("concept_ids")) for n, k in (("odd", 1), ("even", 0))))


@query(_LINES + """, n as (select *, list_transform(ns, lambda x: 'c' || x) as every from c)
select o as lesson_id, 'd.segments[0].label is required' as error from n where o % 3 = 0
union all select o, 'd.segments[0].concept_ids must not be empty' from n where len(odd) = 0 union all select o, 'd.segments[1].concept_ids must not be empty' from n where len(even) = 0 and o % 4 <> 0 and o % 7 <> 0
union all select o, 'd.segments[1].concept_ids references unknown Concept ID: zz' from n where o % 4 = 0 union all select o, 'd.segments include extra Concept IDs: zz' from n where o % 4 = 0
union all select o, 'd.segments repeat Concept IDs: ' || every[1] from n where o % 7 = 0
union all select o, 'd.segments are missing Concept IDs: x9' from n where o % 11 = 0""")
def segment_errors(t: Tables) -> DataFrame:
    o, every = F.col("o"), _ids(F.col("ns"))
    odd, even = _half(F.col("ns"), 1), _half(F.col("ns"), 0)
    none = F.array().cast(_STRINGS)
    more = F.concat(even, F.when(o % 4 == 0, F.array(F.lit("zz"))).otherwise(none), F.when(o % 7 == 0, F.slice(every, 1, 1)).otherwise(none))
    answer = F.to_json(F.struct(F.array(F.struct(F.when(o % 3 == 0, " ").otherwise(" a ").alias("label"), odd.alias("concept_ids")), F.struct(F.lit("b").alias("label"), more.alias("concept_ids"))).alias("segments")))
    found = answers.segments(_lines(t).select(o.alias("lesson_id"), answer.alias("answer"), F.concat(every, F.when(o % 11 == 0, F.array(F.lit("x9"))).otherwise(none)).alias("expected_concept_ids")))
    return verdicts.each_error(verdicts.segment_errors(found, "d"), "lesson_id")


@query(_LINES + """select o as lesson_id, 'd must preserve Segment count' as error from c where o % 5 = 0 union all select o, 'd.segments are missing Concept IDs: ' || array_to_string(even, ', ') from c where o % 5 = 0 and len(even) > 0
union all select o, 'd.segments[0].concept_ids must not be empty' from c where case when o % 3 = 0 and o % 5 <> 0 then len(even) = 0 else len(odd) = 0 end union all select o, 'd.segments[1].concept_ids must not be empty' from c where o % 5 <> 0 and case when o % 3 = 0 then len(odd) = 0 else len(even) = 0 end
union all select o, 'd.segments[' || i || '].concept_ids must preserve the planner Segment membership' from c, (values (0), (1)) as t(i) where o % 3 = 0 and o % 5 <> 0
union all select o, 'd.segments[1].label must preserve the planner label' from c where o % 7 = 0 and o % 5 <> 0""")
def orderer_errors(t: Tables) -> DataFrame:
    o, plan = F.col("o"), _plan(F.col("ns"))
    one, two = F.get(plan, F.lit(0)), F.get(plan, F.lit(1))
    turn = lambda x: F.reverse(x["concept_ids"])
    made = lambda label, ids: F.struct(label.alias("label"), ids.alias("concept_ids"))
    last = F.when(o % 7 == 0, "other").otherwise("even")
    segments = F.when(o % 5 == 0, F.array(made(F.lit("odd"), turn(one)))).when(o % 3 == 0, F.array(made(F.lit("odd"), turn(two)), made(last, turn(one)))).otherwise(F.array(made(F.lit("odd"), turn(one)), made(last, turn(two))))
    return verdicts.orderer_errors(_lines(t).select(o.alias("lesson_id"), segments.alias("segments"), plan.alias("planned")), "d").select("lesson_id", F.explode("errors").alias("error"))


@query(_LINES + """, a as (select o, n, row_number() over (partition by o order by n) - 1 as i from (select o, unnest(ns) as n from c) where n % 5 <> 0)
select o as scope_id, 'candidate_assignments[' || i || '].status must not be review' as error from a where n % 5 = 4 union all select o, 'candidate_assignments[' || i || '] references unknown accepted concept k9' from a where n % 5 = 2
union all select o, 'candidate_assignments[' || i || '].reason must be a controlled pruning reason' from a where n % 5 = 3 and o % 2 = 0
union all select o, 'd must assign every target candidate: c5' from c where list_contains(ns, 5) union all select o, 'candidate_assignments[' || (select count(*) from a where a.o = c.o) || '].candidate_id must be one of the target candidates' from c where o % 3 = 0
union all select o, 'candidate_assignments[' || (select count(*) from a where a.o = c.o) || '].status must be used_in, merged_into, or pruned' from c where o % 3 = 0
union all select o, 'new_accepted_concepts[0].label is required' from c where o % 7 = 0 union all select o, 'new_accepted_concepts[0].source_candidate_ids must contain target candidate IDs' from c where len(odd) = 0 and o % 4 <> 0 union all select o, 'new_accepted_concepts[0].source_candidate_ids must only contain target candidate IDs' from c where o % 4 = 0""")
def repair_errors(t: Tables) -> DataFrame:
    o, g = F.col("o"), _lines(t)
    none = F.lit(None).cast("string")
    row = lambda id_, status, ids, into, reason: F.struct(id_.alias("candidate_id"), status.alias("status"), ids.alias("accepted_ids"), into.alias("merged_into"), reason.alias("reason"))
    each = F.transform(F.filter("ns", lambda x: x % 5 != 0), lambda x: row(F.concat(F.lit("c"), x), F.when(x % 5 == 1, "used_in").when(x % 5 == 2, "merged_into").when(x % 5 == 3, "pruned").otherwise("review"), F.when(x % 5 == 1, F.array(F.lit("k1"))), F.when(x % 5 == 2, "k9"), F.when(x % 5 == 3, F.when(o % 2 == 0, "whim").otherwise("incidental"))))
    every = F.concat(each, F.when(o % 3 == 0, F.array(row(F.lit("zz"), F.lit("odd"), F.lit(None).cast(_STRINGS), none, none))).otherwise(F.array().cast("array<struct<candidate_id:string,status:string,accepted_ids:array<string>,merged_into:string,reason:string>>")))
    own = F.concat(_ids(F.filter("ns", lambda x: x % 2 == 1)), F.when(o % 4 == 0, F.array(F.lit("zz"))).otherwise(F.array().cast(_STRINGS)))
    concept = F.struct(F.lit("k1").alias("id"), F.when(o % 7 == 0, " ").otherwise("l").alias("label"), F.lit("d").alias("description"), F.lit("m").alias("merge_rationale"), F.array(F.lit("can")).alias("coverage_criteria"), own.alias("source_candidate_ids"))
    answer = F.to_json(F.struct(F.array(concept).alias("accepted_concepts"), every.alias("candidate_assignments")))
    found = answers.repairs(g.select(o.alias("scope_id"), _ids(F.col("ns")).alias("target_candidate_ids"), F.array(F.lit("old")).alias("existing_ids"), answer.alias("answer")))
    return verdicts.each_error(verdicts.repair_errors(found, "d"), "scope_id")


def _audits(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.array().cast(_STRINGS)
    plan = F.struct(F.when(k % 5 == 0, "residual_duplicate").when(k % 5 == 1, "provenance_loss").otherwise("whim").alias("reason"), F.array(F.lit("c1"), F.lit(""), F.lit("c1")).alias("candidate_ids"), F.when(k % 2 == 0, " why ").otherwise("").alias("explanation"))
    missed = F.struct(F.array(F.lit("c1"), F.when(k % 3 == 0, "c9").otherwise("c1")).alias("candidate_ids"), F.lit("HIGHEST").alias("confidence"))
    scores = F.struct((k % 6 - 1).alias("identity_correctness"), F.lit("2").alias("subject_coherence"))
    flags = F.when(k % 7 == 0, F.array(F.lit("granularity_violation"), F.lit("odd"), F.lit("repair_unstable"), F.lit("granularity_violation"))).otherwise(none)
    answer = F.to_json(F.struct(flags.alias("flags"), F.array(plan).alias("repair_plan"), F.array(missed).alias("missed_merge_candidates"), F.when(k % 4 == 0, "reliable").otherwise("?").alias("reliability"), scores.alias("scores")))
    return answers.subject_audits(t.orders.select(k.alias("scope_id"), F.when(k % 13 == 0, "broken").otherwise(answer).alias("answer")))


_AUDITS = """with a as (select o_orderkey as k, o_orderkey % 13 = 0 as broken, case when o_orderkey % 13 = 0 then null when o_orderkey % 5 = 0 then 'residual_duplicate' when o_orderkey % 5 = 1 then 'provenance_loss' end as reason, o_orderkey % 13 <> 0 and o_orderkey % 3 = 0 as missed, o_orderkey % 13 <> 0 and o_orderkey % 7 = 0 as gran from orders),
f as (select *, list_filter([case when gran then 'granularity_violation' when reason is not null then reason end, case when missed then 'missed_obvious_merge' end], lambda x: x is not null) as flags from a),
s as (select *, len(flags) > 0 or reason is not null as wrong, case when broken then case when len(flags) > 0 then 1 else 3 end else greatest(0, least(3, k % 6 - 1)) end as identity, case when len(flags) > 0 then 1 else 3 end as usual from f)
"""


@query(_AUDITS + "select k as scope_id, array_to_string(flags, ',') as flags, coalesce(reason || ':c1', '') as plan, case when wrong then 'repair_required' else 'reliable' end as reliability, identity::integer as identity, usual::integer as coherence, (case when len(flags) > 0 then least(identity, usual) else usual end)::integer as net, broken from s")
def subject_audits(t: Tables) -> DataFrame:
    plan = F.array_join(F.transform("repair_plan", lambda x: F.concat(x["repair_reason"], F.lit(":"), F.array_join(x["candidate_ids"], "+"))), ",")
    return _audits(t).select("scope_id", F.array_join("flags", ",").alias("flags"), plan.alias("plan"), "reliability", F.col("scores.identity_correctness").alias("identity"), F.col("scores.subject_coherence").alias("coherence"), F.col("scores.net_phase5_benefit").alias("net"), F.col("problem").isNotNull().alias("broken"))


@query(_AUDITS + """select k as scope_id, 'a.repair_plan[0].candidate_ids must contain at least two IDs for residual_duplicate' as error from s where reason = 'residual_duplicate'
union all select k, 'a.repair_plan[0].candidate_ids references unknown candidates: c1' from s where reason is not null and k % 2 = 0 union all select k, 'a.repair_plan[0].explanation is required' from s where reason is not null and k % 2 = 1""")
def subject_audit_errors(t: Tables) -> DataFrame:
    known = t.orders.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("scope_id"), F.array(F.lit("c1")).alias("candidate_ids"))
    return verdicts.subject_audit_errors(_audits(t), known, "a").select("scope_id", F.explode("errors").alias("error"))


@query("""select p_partkey as concept_id, case when p_partkey % 4 = 0 then 'applied' else 'factual' end as knowledge_type, case when p_partkey % 4 = 0 then p_type else p_name end as rationale, case when p_partkey % 8 = 0 then 0.9 else 0.5 end::double as confidence,
  case when p_partkey % 4 = 0 then 'quality_repair' else 'model' end as source, case when p_partkey % 4 = 0 then 'r.json' end as repair_decision_artifact from part""")
def repaired_classifications(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    classified = t.part.select(k.alias("concept_id"), F.lit("factual").alias("knowledge_type"), F.col("p_name").alias("rationale"), F.lit(0.5).alias("confidence"), F.lit("model").alias("source"))
    repaired = t.part.where(k % 4 == 0).select(k.alias("concept_id"), F.lit("applied").alias("knowledge_type"), F.col("p_type").alias("rationale"), F.when(k % 8 == 0, 0.9).alias("confidence"))
    return verdicts.repaired_classifications(classified, repaired, "r.json")


def _guarded(t: Tables) -> DataFrame:
    audits = t.customer.groupBy(F.col("c_nationkey").alias("scope_id")).agg(F.lit("reliable").alias("reliability"), F.array(F.lit("x")).alias("flags"), F.array(F.lit("p0"), F.lit("p2")).alias("planned_concept_ids"))
    conflicts = t.part.where("p_size % 3 = 0").select((F.col("p_partkey") % 20).cast("int").alias("scope_id"), F.concat(F.lit("p"), F.col("p_size") % 5).alias("concept_id"))
    return verdicts.guarded(audits, conflicts)


_GUARDED = """with a as (select distinct c_nationkey as s from customer), f as (select (p_partkey % 20)::integer as s, list(distinct 'p' || p_size % 5 order by 'p' || p_size % 5) as c from part where p_size % 3 = 0 group by 1),
r as (select a.s, c, case when c is null then ['p0', 'p2'] else list_concat(['p0', 'p2'], list_filter(c, lambda x: x not in ('p0', 'p2'))) end as planned from a left join f using (s))
"""


@query(_GUARDED + "select s as scope_id, case when c is null then 'reliable' else 'repair_required' end as reliability, case when c is null then 'x' else 'x,cross_segment_conflict' end as flags, array_to_string(planned, ',') as planned, coalesce(array_to_string(c, ','), '') as findings from r")
def guarded_audits(t: Tables) -> DataFrame:
    return _guarded(t).select("scope_id", "reliability", F.array_join("flags", ",").alias("flags"), F.array_join("planned_concept_ids", ",").alias("planned"), F.array_join("findings", ",").alias("findings"))


@query(_GUARDED + "select s as scope_id, array_to_string(list_filter(planned, lambda x: x <> 'p2'), ',') as concept_ids from r")
def repair_targets(t: Tables) -> DataFrame:
    known = t.nation.select(F.col("n_nationkey").alias("scope_id"), F.explode(F.array(*(F.lit(f"p{i}") for i in (0, 1, 3, 4)))).alias("concept_id"))
    return verdicts.repair_targets(_guarded(t), known).select("scope_id", F.array_join("concept_ids", ",").alias("concept_ids"))


@query(_LINES + "select o as scope_id, o % 3 = 0 and o % 5 <> 0 and o % 7 <> 0 as confirmed from c")
def confirmed_repairs(t: Tables) -> DataFrame:
    o, g = F.col("o"), _lines(t)
    audits = g.select(o.alias("scope_id"), F.array(F.lit("over_pruned")).alias("flags_before"), F.when(o % 3 == 0, F.array(F.lit("over_pruned"))).otherwise(F.array(F.lit("over_pruned"), F.lit("x"))).alias("flags_after"))
    assigned = F.transform("ns", lambda x: F.struct(F.concat(F.lit("c"), x).alias("candidate_id"), F.when(o % 5 == 0, "review").otherwise("pruned").alias("status"), F.when(o % 7 == 0, "too_broad").otherwise("unrelated").alias("reason")))
    decisions = g.select(o.alias("scope_id"), F.lit("over_pruned").alias("repair_reason"), _ids(F.col("ns")).alias("target_candidate_ids"), assigned.alias("candidate_assignments"))
    return verdicts.confirmed_repairs(audits, decisions)


# ---- assembly ------------------------------------------------------------------------------------------------------


def _reduction(t: Tables) -> dict[str, DataFrame]:
    """Brands as scopes, parts as candidates, sizes modulo 5 as the concepts that cite them; every seventh part is unknown."""
    k = F.col("p_partkey")
    c = F.concat(F.lit("c"), k)
    kind = F.col("p_size") % 5
    entries = t.part.where(k % 7 != 0).select(
        F.col("p_brand").alias("scope_id"), c.alias("compact_id"), F.array(F.col("p_type"), F.lit("primary")).alias("source_roles"), F.when(k % 2 == 0, "body").otherwise("").alias("evidence_type"), F.struct(c.alias("candidate_id")).alias("candidate_ref"),
        F.col("p_name").alias("label"), F.col("p_type").alias("description"), F.array(F.struct(F.lit("page").alias("kind"), F.col("p_size").cast("string").alias("locator"))).alias("anchors"),
    )
    sources = t.part.where(kind < 4).select(F.col("p_brand").alias("scope_id"), F.concat(F.lit("k"), kind).alias("accepted_id"), k.alias("pos"), c.alias("candidate_id"))
    accepted = sources.groupBy("scope_id", F.col("accepted_id").alias("id")).agg(F.lit("m").alias("merge_rationale")).select("scope_id", F.expr("cast(substr(id, 2) as int)").alias("ord"), "id", F.col("id").alias("label"), F.col("scope_id").alias("description"), F.lit(None).cast(_STRINGS).alias("coverage_criteria"), "merge_rationale")
    status = F.when(kind == 4, F.when(k % 2 == 0, "pruned").otherwise("review")).when(k % 3 == 0, "merged_into").otherwise("used_in")
    into = F.when((kind < 4) & (k % 3 == 0), F.when(k % 2 == 0, F.concat(F.lit("k"), kind)).otherwise("nowhere"))
    assignments = t.part.select(F.col("p_brand").alias("scope_id"), k.alias("ord"), c.alias("candidate_id"), status.alias("status"), F.lit(None).cast(_STRINGS).alias("accepted_ids"), into.alias("merged_into"), F.lit("incidental").alias("reason"), F.lit("x").alias("explanation"))
    return {"entries": entries, "sources": sources, "accepted": accepted, "assignments": assignments}


_RED = """with p as (select p_brand as scope_id, p_partkey as k, 'c' || p_partkey as c, p_size % 5 as kind, p_type, p_partkey % 7 <> 0 as known, p_name, p_size from part),
a as (select scope_id, kind, row_number() over (partition by scope_id order by kind) as n from (select distinct scope_id, kind from p where kind < 4)),
f as (select scope_id, kind, 'reconciled-candidate-' || scope_id || '-' || lpad(n::varchar, 3, '0') as final_id from a)
"""


@query(_RED + """, r as (select scope_id, kind, v, min((k, i)) as o from (select scope_id, kind, k, unnest([p_type, 'primary']) as v, unnest([1, 2]) as i from p where known and kind < 4) group by 1, 2, 3)
select f.scope_id, final_id as reconciled_candidate_id, coalesce((select string_agg(c, ',' order by k) from p where p.scope_id = f.scope_id and p.kind = f.kind and known), '') as sources, coalesce((select string_agg(v, ',' order by o) from r where r.scope_id = f.scope_id and r.kind = f.kind), '') as roles,
  case when exists (select 1 from p where p.scope_id = f.scope_id and p.kind = f.kind and known and k % 2 = 0) then 'body' else '' end as kinds from f""")
def reconciled_candidates(t: Tables) -> DataFrame:
    d = _reduction(t)
    found = assembly.reconciled(d["accepted"], d["sources"], d["entries"])
    return found.select("scope_id", "reconciled_candidate_id", F.array_join("source_candidate_ids", ",").alias("sources"), F.array_join("source_roles", ",").alias("roles"), F.array_join("evidence_types", ",").alias("kinds"))


@query(_RED + """select p.scope_id, c as candidate_id, case when p.kind = 4 then case when k % 2 = 0 then 'pruned' else 'review' end when k % 3 = 0 then 'merged_into' else 'used_in' end as status, case when p.kind < 4 and k % 3 = 0 then final_id end as final_id, case when p.kind = 4 and k % 2 = 0 then 'incidental' end as reason, case when p.kind = 4 then 'x' end as explanation
  from p left join f on f.scope_id = p.scope_id and f.kind = p.kind where known""")
def dispositions(t: Tables) -> DataFrame:
    d = _reduction(t)
    found = assembly.reconciled(d["accepted"], d["sources"], d["entries"])
    return assembly.dispositions(d["assignments"], found, d["entries"]).drop("ord", "candidate_ref")


@query(_RED + """select scope_id, count(*) filter (where known) as input_candidate_count, count(distinct kind) filter (where kind < 4) as reconciled_candidate_count, count(*) filter (where known and kind = 4 and k % 2 = 0) as pruned_candidate_count, count(*) filter (where known and kind = 4 and k % 2 = 1) as review_candidate_count from p group by 1 having count(*) filter (where known) > 0""")
def reconciliation_summary(t: Tables) -> DataFrame:
    d = _reduction(t)
    found = assembly.reconciled(d["accepted"], d["sources"], d["entries"])
    return assembly.reconciliation_summary(d["entries"], found, assembly.dispositions(d["assignments"], found, d["entries"]))


@query(_RED + """, m as (select scope_id, kind, max(k) as m from p where kind < 4 group by 1, 2)
select scope_id, 'k' || kind as accepted_id, k as pos, c as candidate_id from p where kind < 4 union all select scope_id, 'k' || kind, m + i, 'new' || i from m, (values (1), (2)) as t(i)""")
def added_candidates(t: Tables) -> DataFrame:
    d = _reduction(t)
    each = d["sources"].select("scope_id", "accepted_id").distinct()
    added = each.select("scope_id", "accepted_id", F.explode(F.expr("array(named_struct('ord', 5, 'id', 'new1'), named_struct('ord', 9, 'id', 'new2'), named_struct('ord', 7, 'id', 'new1'))")).alias("_x")).select("scope_id", "accepted_id", "_x.ord", F.col("_x.id").alias("candidate_id"))
    again = d["sources"].select("scope_id", "accepted_id", F.lit(1).alias("ord"), "candidate_id")
    return assembly.with_candidates(d["sources"], added.unionByName(again))


@query(_RED + "select scope_id, 'phase5b_standalone_' || c as id, p_name as label, c as candidate_id from p where known and k % 5 = 0")
def standing_alone(t: Tables) -> DataFrame:
    d = _reduction(t)
    k = F.col("p_partkey")
    plans = t.part.groupBy(F.col("p_brand").alias("scope_id")).agg(F.lit("assignment_incomplete").alias("repair_reason"), F.collect_list(F.concat(F.lit("c"), k)).alias("candidate_ids"))
    assigned = t.part.where(k % 5 != 0).select(F.col("p_brand").alias("scope_id"), F.concat(F.lit("c"), k).alias("candidate_id"))
    return assembly.standing_alone(plans, d["entries"], assigned).drop("description")


@query(_RED + "select scope_id, c as candidate_id, c || '|' || case when k % 2 = 0 then 'body' else '' end || '|' || p_type || ',primary|' || p_size as ref from p where known")
def evidence_refs(t: Tables) -> DataFrame:
    r = F.col("evidence_ref")
    shown = F.concat_ws("|", r["candidate_ref"]["candidate_id"], r["evidence_type"], F.array_join(r["source_roles"], ","), F.array_join(r["anchors"], ","))
    return assembly.refs(_reduction(t)["entries"]).select("scope_id", "candidate_id", shown.alias("ref"))


@query("""select p_partkey as concept_id, p_name as label, case when p_partkey % 2 = 0 then p_type || '.' else left(p_type || repeat(' x', 200), 280) end as description, (p_size % 4)::integer as n_sources, (p_size % 3)::integer as n_lessons from part""")
def compact_concepts(t: Tables) -> DataFrame:
    n = lambda m: F.transform(F.sequence(F.lit(0), F.col("p_size") % m), lambda x: x.cast("string"))
    description = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_type", F.lit(".  More. ")))
    description = description.otherwise(F.concat("p_type", F.repeat(F.lit(" x"), F.lit(200))))
    less = lambda m: F.slice(n(m), F.lit(1), F.col("p_size") % m)
    found = t.part.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("label"), description.alias("description"), F.array().cast(_STRINGS).alias("coverage_criteria"), less(4).alias("source_candidate_ids"), less(3).alias("lesson_ids"))
    return assembly.compact_concepts(found).drop("coverage_criteria")


@query(_LINES + """select o as lesson_id, '' as title, array_to_string(list_transform(ns, lambda n: 's' || n || '/' || case when n % 2 = 0 then 'practice' else 'teach' end || '/' || case when n % 3 = 0 then '' else 'l' || n end || '/' || case when n % 5 = 0 then '' else 'c' || n end), ';') as segments from c""")
def runtime_lessons(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    segment = F.transform("ns", lambda n: F.struct(F.concat(F.lit("s"), n).alias("segment_id"), none.alias("display_code"), F.when(n % 3 != 0, F.concat(F.lit("l"), n)).alias("label"), F.when(n % 2 == 0, "practice").otherwise("").alias("instructional_role"), F.when(n % 5 != 0, F.array(F.concat(F.lit("c"), n))).alias("concept_ids"), none.alias("teaching_notes")))
    lessons = _lines(t).select(F.col("o").alias("lesson_id"), none.alias("display_code"), none.alias("date"), none.alias("title"), none.alias("description"), segment.alias("segments"))
    shown = F.transform("segments", lambda s: F.concat_ws("/", s["segment_id"], s["instructional_role"], s["label"], F.array_join(s["concept_ids"], ",")))
    return assembly.runtime_lessons(lessons).select("lesson_id", "title", F.array_join(shown, ";").alias("segments"))


@query("""with c as (select case when c_nationkey % 5 = 0 then 'COM' else c_mktsegment end as s, case when c_custkey % 4 = 0 then ' ' else 'P' || c_custkey % 9 end as p, c_custkey as k from customer), f as (select s, p, min(k) as o from c where trim(p) <> '' group by 1, 2)
select s as subject_id, case s when 'COM' then 'Computacao' else s end as title, 'pt-BR' as language, coalesce((select string_agg(p, ',' order by o) from f where f.s = x.s), '') as professors from (select distinct s from c) x""")
def subject_metadata(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    lessons = t.customer.select(F.when(F.col("c_nationkey") % 5 == 0, "COM").otherwise(F.col("c_mktsegment")).alias("subject"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit(" P"), k % 9)).alias("professor"), k.alias("workbook_row_number"))
    return assembly.subject_metadata(lessons, "subject").withColumn("professors", F.array_join("professors", ","))


@query("select 'parse' as stage, o_orderkey as scope_id, case when o_orderkey % 3 = 0 then 'missing' when o_orderkey % 3 = 1 then 'invalid' else 'complete' end as status from orders")
def completion_audit(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    expected = t.orders.select(F.lit("parse").alias("stage"), k.alias("scope_id"))
    made = t.orders.where(k % 3 != 0).select(F.lit("parse").alias("stage"), k.alias("scope_id"), F.explode(F.array(F.lit(0), F.when(k % 3 == 1, 2).otherwise(0))).alias("n_errors"))
    return assembly.completion(expected, made)


@query("select s_suppkey, case when s_suppkey % 5 > 0 then floor(abs(s_acctbal) * (32 + 0.5 * 66))::bigint end as low, case when s_suppkey % 5 > 0 then floor(abs(s_acctbal) * (32 + 0.5 * 258))::bigint end as full_ from supplier")
def video_tokens(t: Tables) -> DataFrame:
    seconds = F.when(F.col("s_suppkey") % 5 > 0, F.abs("s_acctbal"))
    return t.supplier.select("s_suppkey", assembly.video_input_tokens(seconds, 0.5, True).alias("low"), assembly.video_input_tokens(seconds, 0.5, False).alias("full_"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'u' || p_partkey else 'v' end as original_url, case p_partkey % 4 when 0 then 'important' when 1 then 'unavailable' when 2 then 'not_important' else 'unavailable' end as pedagogical_importance, case when p_partkey % 4 = 3 then '' else p_name end as description from part where p_partkey % 4 <> 3 or p_partkey % 3 = 0
union all select p_partkey, 'u' || p_partkey, 'unavailable', '' from part where p_partkey % 4 = 3 and p_partkey % 3 <> 0""")
def image_analyses(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    said = F.struct(F.when(k % 3 == 0, " ").otherwise("v").alias("original_url"), F.when(k % 4 == 0, " Important").when(k % 4 == 1, "maybe").otherwise("not_important").alias("pedagogical_importance"), F.concat(F.lit(" "), "p_name").alias("description"))
    rows = t.part.select("p_partkey", F.concat(F.lit("u"), k).alias("url"), F.when(k % 4 == 3, "no answer").otherwise(F.to_json(said)).alias("answer"))
    return answers.image_analyses(rows).select("p_partkey", "original_url", "pedagogical_importance", "description")


@query("""select p_partkey as self_study_id, case when p_partkey % 3 = 0 then 'model output must include candidate_concepts' when p_partkey % 3 = 1 then 'model output must be a JSON object' else 'none' end as problem, case when p_partkey % 3 = 2 then 2 else 0 end as n_candidates, case when p_partkey % 3 = 2 then p_name || ':primary|x:' else '' end as candidates, p_partkey % 3 <> 1 and p_partkey % 2 = 0 as excluded from part""")
def extraction_answers(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    one = F.struct(F.col("p_name").alias("label"), F.array(F.lit("Main"), F.lit("primary")).alias("source_roles"))
    whole = F.concat(F.lit('{"candidate_concepts":['), F.to_json(one), F.lit(',{"label":"x"}],"excluded":'), (k % 2 == 0).cast("string"), F.lit("}"))
    answer = F.when(k % 3 == 0, F.concat(F.lit('{"excluded":'), (k % 2 == 0).cast("string"), F.lit("}"))).when(k % 3 == 1, "7").otherwise(whole)
    found = answers.extractions(t.part.select(k.alias("self_study_id"), answer.alias("answer")))
    shown = F.array_join(F.transform("candidates", lambda c: F.concat(c["label"], F.lit(":"), F.array_join(c["source_roles"], ","))), "|")
    return found.select("self_study_id", F.coalesce("problem", F.lit("none")).alias("problem"), F.greatest(F.lit(0), "n_candidates").alias("n_candidates"), F.coalesce(shown, F.lit("")).alias("candidates"), "excluded")
