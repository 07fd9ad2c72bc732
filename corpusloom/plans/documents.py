"""Queries of the source ledger and of whole decision documents, made of whole tables by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import ledger, reduction
from corpusloom.plans.base import Tables, query

_BOOK = """with r as (select p_partkey as k, p_partkey + 2 as n, p_partkey % 10 as d, p_partkey - p_partkey % 10 as c, p_name, p_type, p_size from part),
s as (select n::varchar as self_study_id, k, d, 'lesson-2024-03-' || lpad((c % 28 + 1)::varchar, 2, '0') || '-class-' || c as lesson_id, case when d in (1, 2, 3) then 'usable_source_body' when d = 7 then 'excluded_activity_only_self_study' else 'unavailable_source_body' end as status, p_name, p_size from r where d > 0)
"""


def _book(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every tenth part is a class, the others its self-studies; some name another date, some are mere activities."""
    k = F.col("p_partkey")
    d, c = k % 10, k - k % 10
    day = lambda x: F.concat(F.lpad((x % 28 + 1).cast("string"), 2, "0"), F.lit("/03/2024"))
    none = F.lit(None).cast("string")
    rows = t.part.select(
        (k + 2).alias("workbook_row_number"), F.when(d == 0, "Class").otherwise("Self-study").alias("row_type"),
        F.when(d == 0, F.concat(F.lit("Class "), k)).when(d == 7, F.concat(F.lit("Atividade: "), "p_name")).otherwise(F.col("p_name")).alias("title"), F.when(d == 0, day(k)).alias("date"), none.alias("professor"), none.alias("axis"),
        F.concat_ws(";", "p_type", "p_brand").alias("related_subjects"), F.when(d == 7, " ").otherwise(F.col("p_type")).alias("description"), F.lit(1).alias("week"), (d + 0).alias("sort"), F.when(d == 7, "").otherwise("http://x").alias("url"), F.lit("").alias("resource_code"),
        F.when(d < 5, " Yes ").otherwise("no").alias("required"), F.col("p_size").cast("string").alias("grade_weight"), F.when(d > 0, F.concat(F.lit("Class "), c)).alias("parent_class"), F.when(d == 3, "31/12/2024").otherwise(day(c)).alias("class_date"),
    )
    texts = F.array().cast("array<string>")
    index = t.part.where((d > 0) & (d < 5)).select(
        (k + 2).cast("string").alias("id"), (d < 4).alias("available"), F.lit("passed").alias("status"), F.lit("article").alias("type"), F.concat(F.lit("out/"), k, F.lit(".md")).alias("path"), F.sha2(k.cast("string").cast("binary"), 256).alias("sha256"),
        F.when(d == 2, 0).otherwise(F.col("p_size")).cast("bigint").alias("word_count"), F.col("p_size").cast("bigint").alias("bytes"), none.alias("source_markdown"), none.alias("artifact_dir"), texts.alias("warnings"), F.when(d == 4, F.array(F.lit("auth_wall_detected"))).otherwise(texts).alias("failures"),
    )
    return rows, index


@query(_BOOK + """select self_study_id, lesson_id, status as source_body_status, status = 'unavailable_source_body' as metadata_only_candidate, case when d = 7 then 'activity_only_without_teaching_signal' end as exclusion_reason, case when d = 3 then 'workbook_parent_class_date_mismatch' else '' end as warnings,
  case when d = 4 then 'auth_wall_detected' when d > 4 then 'missing_extraction_index_record' else '' end as failures, d < 5 as required, p_size::double as grade_weight, case when d < 5 then 'out/' || k || '.md' end as path from s""")
def source_ledger(t: Tables) -> DataFrame:
    rows, index = _book(t)
    s = ledger.self_studies(rows, ledger.lessons(rows), index)
    return s.select("self_study_id", "lesson_id", "source_body_status", "metadata_only_candidate", "exclusion_reason", F.array_join("ledger_warnings", ",").alias("warnings"), F.array_join("source_body.availability_failures", ",").alias("failures"), "workbook_metadata.required", "workbook_metadata.grade_weight", "source_body.path")


@query(_BOOK + """select count(*) as self_study_count, count(*) filter (where d in (1, 2, 3)) as available_count, count(*) filter (where d in (4, 5, 6, 8, 9)) as unavailable_count, count(*) filter (where d = 7) as excluded_count from s""")
def ledger_summary(t: Tables) -> DataFrame:
    rows, index = _book(t)
    return ledger.summary(ledger.self_studies(rows, ledger.lessons(rows), index))


@query(_BOOK + """select self_study_id, 'source_body.word_count is required for usable source bodies' as error from s where d = 2
  union all select self_study_id, 'source_body.path does not exist: out/' || k || '.md' from s where d = 1 and k % 3 = 0 union all select self_study_id, 'source_body.sha256 does not match file: out/' || k || '.md' from s where d = 3 and k % 3 = 1
  union all select self_study_id, 'self_study_id is duplicated' from s where d = 5 union all select self_study_id, 'lesson_id must reference a lesson' from s where d = 6 and k % 100 >= 50""")
def ledger_errors(t: Tables) -> DataFrame:
    rows, index = _book(t)
    found = ledger.lessons(rows)
    s = ledger.self_studies(rows, found, index)
    s = s.unionByName(s.where("cast(self_study_id as int) % 10 = 7"))
    k = F.col("self_study_id").cast("int") - 2
    s = s.withColumn("lesson_id", F.when((k % 10 == 6) & (k % 100 >= 50), "lesson-nowhere").otherwise(F.col("lesson_id")))
    p = F.col("p_partkey")
    files = t.part.where(~((p % 10 == 1) & (p % 3 == 0))).select(F.concat(F.lit("out/"), p, F.lit(".md")).alias("path"), F.sha2(F.when((p % 10 == 3) & (p % 3 == 1), F.lit("changed")).otherwise(p.cast("string")).cast("binary"), 256).alias("sha256"))
    return ledger.ledger_errors(s, found, files)


def _documents(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as scopes, the numbers of their lines as candidates; what is wrong follows from the numbers."""
    o, n = F.col("o"), F.col("n")
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("ns"))
    name = lambda x: F.concat(F.lit("c"), x)
    ids = F.transform("ns", name)
    odd, even = F.transform(F.filter("ns", lambda x: x % 2 == 1), name), F.transform(F.filter("ns", lambda x: x % 2 == 0), name)
    plus = F.concat(odd, F.when(o % 5 == 0, F.array(F.lit("zz"))).otherwise(F.array().cast("array<string>")), F.when((o % 7 == 0) & (F.size(odd) > 0), F.slice(odd, 1, 1)).otherwise(F.array().cast("array<string>")))
    concept = lambda label, sources: F.struct(F.lit("k1").alias("id"), label.alias("label"), F.lit("d").alias("description"), F.lit("m").alias("merge_rationale"), F.array(F.when(o % 4 == 0, " ").otherwise("can")).alias("coverage_criteria"), sources.alias("source_candidate_ids"))
    accepted = F.concat(F.array(concept(F.when(o % 3 == 0, " ").otherwise("l"), plus)), F.when(o % 17 == 0, F.array(concept(F.lit("b"), even))).otherwise(F.array().cast(f"array<{reduction.CONCEPT}>")))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    assignment = lambda id_, status, ids, into, reason, explanation: F.struct(id_.alias("candidate_id"), status.alias("status"), ids.alias("accepted_ids"), into.alias("merged_into"), reason.alias("reason"), explanation.alias("explanation"))
    kind = lambda x: F.when(x % 5 == 1, "used_in").when(x % 5 == 2, "merged_into").when(x % 5 == 3, "pruned").otherwise("review")
    each = F.transform(F.filter("ns", lambda x: x % 5 != 0), lambda x: assignment(name(x), kind(x), F.when(x % 5 == 1, F.array(F.lit("k1"))).otherwise(empty), F.when(x % 5 == 2, "k9"), F.when(x % 5 == 3, "incidental"), F.when(x % 5 == 3, "x").otherwise("")))
    extra = F.array(assignment(F.lit("c1"), F.lit("odd"), empty, none, none, none))
    asg = F.concat(each, F.when(o % 6 == 0, extra).otherwise(F.array().cast(f"array<{reduction.ASSIGNMENT}>")))
    pruned = F.transform(F.filter("ns", lambda x: (x % 5 == 3) & (o % 9 != 0)), lambda x: F.struct(name(x).alias("candidate_id")))
    long = lambda c: F.size(c).cast("bigint")
    d = g.select("o", "ns", ids.alias("ids"), accepted.alias("accepted_concepts"), asg.alias("candidate_assignments"), pruned.alias("pruned"))
    summary = F.struct(long("ids").alias("input_candidate_count"), (long("accepted_concepts") + F.when(o % 10 == 0, 1).otherwise(0)).alias("accepted_count"), long("pruned").alias("pruned_count"), long("candidate_assignments").alias("candidate_assignment_count"), long(F.filter("candidate_assignments", lambda x: x["status"] == "review")).alias("review_count"))
    documents = d.select(o.cast("string").alias("scope_id"), F.when(o % 19 == 0, "odd").otherwise(reduction.ARTIFACT_TYPE).alias("artifact_type"), F.lit(reduction.SCHEMA_VERSION).alias("schema_version"), F.col("ids").alias("input_candidate_ids"), "accepted_concepts", F.col("accepted_concepts").alias("accepted"), "candidate_assignments", "pruned", summary.alias("summary"))
    registries = g.where("o % 13 <> 0").select(o.cast("string").alias("scope_id"), F.when(o % 11 == 0, F.filter(ids, lambda x: x != "c1")).otherwise(ids).alias("candidate_ids"))
    return documents, registries


_DOCS = """with l as (select distinct l_orderkey as o, l_linenumber as n from lineitem), g as (select o, list(n order by n) as ns, min(n) filter (where n % 2 = 1) as first_odd, count(*) filter (where n % 2 = 0) as n_even, bool_or(n = 1) as has1, bool_or(n % 5 = 3) as has3 from l group by 1),
src as (select o, n from l where n % 2 = 1 union select o, n from l where n % 2 = 0 and o % 17 = 0),
last as (select o, n from l join g using (o) where case when o % 17 = 0 and n_even > 0 then n % 2 = 0 else n % 2 = 1 end),
e as (
  select o, 'semantic_reduce_decision.artifact_type must be ''semantic_reduce_decision''' as error from g where o % 19 = 0
  union all select o, 'semantic_reduce_decision.scope_id must match registry.scope_id' from g where o % 13 = 0
  union all select o, 'semantic_reduce_decision.input_candidate_ids references unknown candidates: ' || array_to_string(list_sort(list_transform(ns, lambda x: 'c' || x)), ', ') from g where o % 13 = 0
  union all select o, 'semantic_reduce_decision.input_candidate_ids references unknown candidates: c1' from g where o % 11 = 0 and o % 13 <> 0 and has1
  union all select o, 'accepted_concepts[0].label is required' from g where o % 3 = 0
  union all select o, 'accepted_concepts[0].coverage_criteria must contain at least one string' from g where o % 4 = 0
  union all select o, 'accepted_concepts[0].source_candidate_ids must contain candidate IDs' from g where first_odd is null and o % 5 <> 0
  union all select o, 'accepted_concepts[0].source_candidate_ids references unknown candidate zz' from g where o % 5 = 0
  union all select o, 'accepted_concepts[0].source_candidate_ids contains duplicates: c' || first_odd from g where o % 7 = 0 and first_odd is not null
  union all select o, 'accepted_concepts[1].id is duplicated' from g where o % 17 = 0
  union all select o, 'accepted_concepts[1].coverage_criteria must contain at least one string' from g where o % 17 = 0 and o % 4 = 0
  union all select o, 'accepted_concepts[1].source_candidate_ids must contain candidate IDs' from g where o % 17 = 0 and n_even = 0
  union all select o, 'candidate_assignments[' || (k - 1) || ']' || case when n % 5 = 2 then ' references unknown accepted concept k9' else '.candidate_id must appear in accepted_concepts source_candidate_ids for k1' end
    from (select o, n, row_number() over (partition by o order by n) as k from l where n % 5 <> 0) left join last using (o, n) where n % 5 = 2 or n % 5 = 1 and last.n is null
  union all select o, 'candidate_assignments[' || (k - 1) || '].explanation is required' from (select o, n, row_number() over (partition by o order by n) as k from l where n % 5 <> 0) where n % 5 = 4
  union all select o, 'candidate_assignments[' || (k - 1) || '].candidate_id cannot ' || case when n % 5 = 3 then 'be pruned' else 'require review' end || ' because it is used as accepted evidence' from (select o, n, row_number() over (partition by o order by n) as k from l where n % 5 <> 0) join src using (o, n) where n % 5 in (3, 4)
  union all select o, 'candidate_assignments[' || len(list_filter(ns, lambda x: x % 5 <> 0)) || '].candidate_id references unknown candidate c1' from g where o % 6 = 0 and not has1
  union all select o, 'candidate_assignments[' || len(list_filter(ns, lambda x: x % 5 <> 0)) || '].status must be one of merged_into, pruned, review, used_in' from g where o % 6 = 0
  union all select o, 'semantic_reduce_decision.candidate_assignments candidate_id values are duplicated: c1' from g where o % 6 = 0 and has1
  union all select o, 'semantic_reduce_decision every input candidate must have one assignment: ' || array_to_string(list_transform(list_filter(ns, lambda x: x % 5 = 0), lambda x: 'c' || x), ', ') from g where len(list_filter(ns, lambda x: x % 5 = 0)) > 0
  union all select o, 'semantic_reduce_decision.pruned must match candidate_assignments with status pruned' from g where o % 9 = 0 and has3
  union all select o, 'semantic_reduce_decision.summary.accepted_count does not match accepted_concepts length' from g where o % 10 = 0)
"""


@query(_DOCS + "select o::varchar as scope_id, error from e")
def decision_errors(t: Tables) -> DataFrame:
    return reduction.validate_reduce_decision(*_documents(t)).select("scope_id", F.explode("errors").alias("error"))


@query("""select l_orderkey as scope_id, l_linenumber as ord, case l_linenumber % 4 when 0 then 'semantic reduce model output must be a JSON object' when 1 then 'semantic reduce model output must include accepted_concepts' when 2 then 'semantic reduce model output must include candidate_assignments' else 'none' end as problem,
  case when l_linenumber % 4 = 3 then 'c1:used_in:k1;c2:merged_into:;c3:pruned:' else '' end as assignments, case when l_linenumber % 4 = 3 then 'c3' else '' end as pruned from lineitem""")
def decision_answers(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 4
    whole = '{"accepted":[{"id":"k1"}],"candidate_assignments":[{"candidate_id":"c1","disposition":"used_in","used_in":"k1"},{"candidate_id":"c2","status":"merged_into","accepted_id":"k1"},{"candidate_id":"c3","status":"pruned","pruning_reason":"incidental"}]}'
    answer = F.when(k == 0, "[1]").when(k == 1, '{"candidate_assignments":[]}').when(k == 2, '{"accepted_concepts":[]}').otherwise(whole)
    rows = t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("scope_id"), F.array(F.lit("c1")).alias("input_candidate_ids"), answer.alias("answer"))
    found = reduction.normalize_decision(rows)
    named = F.transform("candidate_assignments", lambda x: F.concat_ws(":", x["candidate_id"], x["status"], F.array_join(F.coalesce(x["accepted_ids"], F.array().cast("array<string>")), ",")))
    ok = F.col("problem").isNull()
    return found.select("scope_id.l_orderkey", "scope_id.l_linenumber", F.coalesce("problem", F.lit("none")).alias("problem"), F.when(ok, F.array_join(named, ";")).otherwise("").alias("assignments"), F.when(ok, F.array_join(F.transform("pruned", lambda x: x["candidate_id"]), ",")).otherwise("").alias("pruned")).withColumnsRenamed({"l_orderkey": "scope_id", "l_linenumber": "ord"})


@query("""with c as (select p_brand as scope_id, p_partkey, p_size, row_number() over (partition by p_brand, p_size order by p_partkey) as k, row_number() over (partition by p_brand order by p_size, p_partkey) as n, p_name, p_type from part)
select scope_id, 's' || p_size || '_' || case when k < 1000 then lpad(k::varchar, 3, '0') else k::varchar end as id, n::integer as "order", p_name as label, case when p_partkey % 2 = 0 then 'body' else 'metadata' end as evidence_type, case when p_partkey % 3 = 0 then 'why=' || p_type else '' end as rationale, 'at ' || p_partkey as anchors from c""")
def candidate_registry(t: Tables) -> DataFrame:
    one = F.struct(
        F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_name").alias("label"), F.col("p_type").alias("description"), F.array("p_type").alias("coverage_criteria"), F.lit(None).cast("array<string>").alias("source_roles"),
        F.when(F.col("p_partkey") % 2 == 0, "body").otherwise("").alias("evidence_type"), F.lit(None).cast("array<struct<kind:string,locator:string>>").alias("source_anchors"),
        F.array(F.struct(F.lit("page").alias("kind"), F.concat(F.lit("at "), F.col("p_partkey")).alias("locator"))).alias("metadata_anchors"), F.create_map(F.lit("why"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(" ")).alias("extraction_reason"),
    )
    by_key = lambda a, b: F.sign(a["p_partkey"] - b["p_partkey"]).cast("int")  # noqa: E731  maps have no order
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("c"))), by_key), lambda x: x["c"])
    none = F.lit(None).cast("string")
    sources = t.part.groupBy(F.col("p_brand").alias("scope_id"), F.col("p_size").alias("ord")).agg(listed.alias("candidates"))
    sources = sources.select("scope_id", "ord", F.concat(F.lit("s"), F.col("ord")).alias("namespace"), none.alias("artifact_path"), none.alias("lesson_id"), none.alias("self_study_id"), none.alias("model_route"), F.lit("metadata").alias("evidence_type"), "candidates")
    v = reduction.compact_view(reduction.registry(sources))
    rationale = F.array_join(F.transform(F.map_entries("rationale"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return v.select("scope_id", "id", "order", "label", "evidence_type", rationale.alias("rationale"), F.array_join("anchors", ",").alias("anchors"))
