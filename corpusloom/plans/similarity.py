"""Queries of token overlap between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import joins, transcripts
from corpusloom.plans.base import Tables, query

_TITLE = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-zA-ZÀ-ÖØ-öø-ÿ0-9]+'), lambda w: length(w) > 1 and w not in ('a','an','and','com','de','do','da','das','dos','e','em','for','in','o','of','os','the','to','um','uma','with')))"


@query(f"""with p as (select p_partkey, p_brand, {_TITLE.format("p_name")} as t from part), j as (
  select a.p_partkey as left_key, b.p_partkey as right_key, len(list_intersect(a.t, b.t)) as i, len(a.t) + len(b.t) as s from p a join p b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey)
select left_key, right_key, i / (s - i) as overlap from j where i > 0 and i / (s - i) >= 0.35""")
def high_overlap_pairs(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", X.title_tokens("p_name").alias("tokens"))
    return joins.overlap_pairs(rows, "p_partkey", "tokens", 0.35, "p_brand")


@query(f"""with d as (select doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_'']+')) as t from documents where text is not null),
j as (select a.doc_id as left_key, b.doc_id as right_key, len(list_intersect(a.t, b.t)) as i, len(a.t) + len(b.t) as s from d a join d b on a.lang = b.lang and a.doc_id < b.doc_id and len(a.t) > 0 and len(b.t) > 0 and least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t)))
select left_key, right_key, i / (s - i) as overlap from j where i / (s - i) >= 0.8 order by overlap desc, left_key, right_key limit 24""")
def most_similar_documents(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", X.overlap_tokens("text").alias("tokens"))
    return joins.most_similar(rows, "doc_id", "tokens", 0.8, "lang")


@query(f"""select c_custkey, case when len(a) > 0 and len(b) > 0 then len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) else 0 end as similarity
  from (select c_custkey, {_TITLE.format("c_name || ' ' || c_mktsegment")} as a, {_TITLE.format("c_mktsegment || ' ' || c_nationkey")} as b from customer)""")
def title_similarity(t: Tables) -> DataFrame:
    a, b = X.title_tokens(F.concat_ws(" ", "c_name", "c_mktsegment")), X.title_tokens(F.concat_ws(" ", "c_mktsegment", "c_nationkey"))
    return t.customer.select("c_custkey", X.jaccard(a, b).alias("similarity"))


@query("""with k as (select conv_id, turn, text, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_'']+')) as t from conversations),
p as (select conv_id, turn, t, text, lag(t) over w as u, lag(text) over w as prev, lag(turn) over w is not null as has from k window w as (partition by conv_id order by turn)),
c as (select *, len(list_intersect(t, u)) as i from p where has)
select conv_id, turn, case when len(t) = 0 or len(u) = 0 then lower(trim(coalesce(text, ''))) = lower(trim(coalesce(prev, ''))) else i / least(len(t), len(u)) >= 0.9 or i / (len(t) + len(u) - i) >= 0.82 end as repeats from c""")
def repeated_turns(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "text", F.lag("text").over(w).alias("prev"), F.lag("turn").over(w).isNotNull().alias("has")).where("has")
    return rows.select("conv_id", "turn", transcripts.near_duplicate(F.col("text"), F.col("prev")).alias("repeats"))
