"""Queries of rules whose outcome the rows' own text and values decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import access, cover
from corpusloom.plans.base import Tables, query


@query(r"""with h as (select p_partkey, 'B' || p_partkey % 50 as code, '§ 1º ' || repeat(p_name || ' ', p_size) || '"Codigo": ' || p_partkey || ' ' || repeat(p_type || ' ', p_size) || '/books/B' || p_size || ' "Codigo" : 9' || p_size || case when p_size % 4 = 0 then '{"Codigo":' || p_size || ',"Name":"' || p_name || '","URL":"https://integrada.minhabiblioteca.com.br/reader/books/B' || p_partkey % 50 || '"}' else '' end as t from part),
a as (select *, strpos(t, '/books/' || code) as p from h)
select p_partkey, case when t like '%{%' then regexp_extract(t, '\{"Codigo":(\d+)', 1) when p = 0 then '' else regexp_extract(substr(t, greatest(1, p - 800), p + 800 - greatest(1, p - 800)), '"Codigo"\s*:\s*(\d+)', 1) end as number from a""")
def catalogue_numbers(t: Tables) -> DataFrame:
    """Numbers of books by items and by mentions, among paragraph signs and names of any length."""
    said = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    size, code = F.col("p_size"), F.concat(F.lit("B"), F.col("p_partkey") % 50)
    item = said('{&quot;Codigo&quot;:', size, ',"Name":"', F.col("p_name"), '","URL":"https://integrada.minhabiblioteca.com.br/reader/books/', code, '"}')
    html = said("§ 1º ", F.repeat(said(F.col("p_name"), " "), size), '"Codigo": ', F.col("p_partkey"), " ", F.repeat(said(F.col("p_type"), " "), size), "/books/B", size, ' "Codigo" : 9', size, F.when(size % 4 == 0, item).otherwise(""))
    return t.part.select("p_partkey", access.subfield_code(html, code).alias("number"))


@query(r"""with j as (select page_id, json_object('http://no.org/', page_id, 'a"b', json_array(null, case when page_id % 2 = 0 then html end, json_object('see http://no.com', case when page_id % 3 = 0 then 'say "' || url || '").' else 'none' end)), 'last', 'at http://end.org/' || page_id || ', and more') as j from pages),
v as (select page_id, t.id, regexp_replace(regexp_extract(t.value ->> '$', 'https?://[^\s"''<>]+'), '[),.;]+$', '') as address from j, json_tree(j) t where t.type = 'VARCHAR')
select page_id, min_by(address, id) as address from v where address <> '' group by page_id""")
def payload_addresses(t: Tables) -> DataFrame:
    """The first address among the values of each page's JSON: keys have addresses too, and values quotes and whole documents."""
    said = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('say "'), "url", F.lit('").'))).otherwise("none")
    inner = F.concat(F.lit('[null,'), F.coalesce(_quoted(F.when(F.col("page_id") % 2 == 0, F.col("html"))), F.lit("null")), F.lit(',{"see http:\\/\\/no.com":'), _quoted(said), F.lit("}]"))
    end = _quoted(F.concat(F.lit("at http://end.org/"), "page_id", F.lit(", and more")))
    payload = F.concat(F.lit('{"http://no.org/" : '), "page_id", F.lit(',"a\\"b": '), inner, F.lit(',"last":'), F.replace(end, F.lit("/"), F.lit("\\/")), F.lit("}"))
    return t.pages.select("page_id", access.address_in_json(payload).alias("address"))


def _quoted(c):
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


@query("""with m as (select o_orderpriority as scope_id, o_orderkey as candidate_id, o_custkey as n from orders where o_custkey % 4 = 0),
x as (select o_orderpriority as scope_id, o_orderkey as candidate_id, row_number() over (partition by o_orderpriority order by o_orderkey) as k from orders where o_custkey % 4 <> 0),
w as (select scope_id, unnest(range(1, (select max(o_custkey) + count(*) from orders)::bigint)) as n from (select distinct scope_id from x)),
f as (select scope_id, n, row_number() over (partition by scope_id order by n) as k from w anti join m using (scope_id, n))
select scope_id, format('added_{:03d}', n) as cluster_id, candidate_id, 'kept' as origin from m union all select scope_id, format('added_{:03d}', n), candidate_id, 'added' from x join f using (scope_id, k)""")
def generated_clusters(t: Tables) -> DataFrame:
    """Orders by priority: those of every fourth customer have clusters with names such as repair gives, the others get clusters of their own."""
    own = F.when(F.col("o_custkey") % 4 == 0, F.col("o_custkey"))
    rows = t.orders.select(F.col("o_orderpriority").alias("scope_id"), F.col("o_orderkey").alias("candidate_id"), own.alias("cluster_ord"), F.col("o_orderkey").alias("pos"), cover.generated("added_", own).alias("cluster_id"))
    return cover.repair(rows.where("cluster_ord is not null"), rows.select("scope_id", "candidate_id", F.col("candidate_id").alias("ord"))).select("scope_id", "cluster_id", "candidate_id", "origin")
