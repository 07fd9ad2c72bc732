"""Queries of small rules and of operators on records that no other query runs, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import urls
from corpusloom.operators import audit, decisions, extraction, graph, markdown, media, models, rendering, transcripts, windows
from corpusloom.plans.base import Tables, query
from corpusloom.sources import manifests

_STRINGS = "array<string>"


@query(r"""select p_partkey, p_partkey % 3 as n_links, p_name || '. ' as sentence, 'http://x/' || p_partkey as bare, lower(replace(p_type, ' ', '_')) || '_role' as token, case when p_partkey % 4 = 0 then p_size::varchar when p_partkey % 4 = 1 then p_size || '.5' else '' end as cell,
  case when p_partkey % 2 = 0 then p_name else 'f' || p_partkey || '.png' end as image_label, p_partkey % 5 = 0 as http, p_partkey % 5 = 1 as playlist from part""")
def text_rules(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    content = F.concat(F.lit("![a](b) "), F.repeat(F.lit("[c](d) "), (k % 3).cast("int")))
    cell = F.when(k % 4 == 0, F.col("p_size").cast("double")).when(k % 4 == 1, F.col("p_size") + 0.5)
    address = F.concat(F.lit("https://h/x/f"), k, F.lit(".png?q=1"))
    link = F.when(k % 5 == 0, "HTTPS://a.b").when(k % 5 == 1, "https://www.youtube.com/playlist?list=PL1").otherwise("ftp://a.b")
    return t.part.select(
        "p_partkey", X.markdown_links(content).alias("n_links"), F.concat(X.first_sentence(F.concat("p_name", F.lit(".  More here! And more"))), F.lit(" ")).alias("sentence"), X.strip_trailing_punctuation(F.concat(F.lit("http://x/"), k, F.lit(").,;"))).alias("bare"),
        X.role_token(F.concat(F.lit(" "), "p_type", F.lit("- Role "))).alias("token"), X.clean_cell(cell).alias("cell"), urls.image_label(F.when(k % 2 == 0, F.concat("p_name", F.lit(" "))).otherwise(" "), address).alias("image_label"),
        (urls.is_http(link) & (k % 5 == 0)).alias("http"), urls.is_youtube_playlist(link).alias("playlist"),
    )


@query("""select event_id, case event_id % 4 when 0 then 'login_url' when 1 then 'manual_message' when 2 then 'empty_page' end as manual, event_id % 3 = 0 as blank, case event_id % 5 when 0 then 'P' || event_id when 1 then 'Q' || event_id else left(sha256('http://r/' || event_id), 12) end as page,
  case when event_id % 2 = 0 then 'pt' else 'en' end as language, case event_id % 3 when 0 then (event_id % 100)::double when 1 then 30.0 end as wait, event_id % 7 < 2 as transient from events""")
def media_rules(t: Tables) -> DataFrame:
    k = F.col("event_id")
    url = F.when(k % 4 == 0, "https://x.y/login/").otherwise("https://x.y/z")
    said = F.when(k % 4 == 1, "Please sign in").when(k % 4 == 2, " ").otherwise("pages of text")
    page = F.when(k % 5 == 0, F.concat(F.lit("http://r/pageid/P"), k)).when(k % 5 == 1, F.concat(F.lit("http://r/?page=Q"), k)).otherwise(F.concat(F.lit("http://r/"), k))
    wait = F.when(k % 3 == 0, (k % 100).cast("string")).when(k % 3 == 1, "Fri, 01 Mar 2024 00:00:30 GMT").otherwise("soon")
    message = F.when(k % 7 == 0, "x HTTP 429").when(k % 7 == 1, "IncompleteRead(0)").otherwise("HTTP 500")
    return t.events.select(
        "event_id", media.needs_manual_access(said, url).alias("manual"), media.is_blank_page(F.when(k % 3 == 0, "This page is intentionally left blank").otherwise("text")).alias("blank"), media.reader_page_id(page).alias("page"),
        F.get(media.preferred_languages(F.when(k % 2 == 0, "Processamento de linguagem").otherwise("Trees")), F.lit(0)).alias("language"), media.retry_after(wait, F.timestamp_seconds(F.lit(1709251200))).alias("wait"), media.is_transient(message).alias("transient"),
    )


@query("select o_orderkey, (case when o_custkey % 70 >= 50 then 50 when o_custkey % 70 >= 20 then 20 when o_custkey % 70 >= 5 then 5 else 2 end)::integer as step, (case when o_custkey % 70 > 50 then 50 when o_custkey % 70 > 20 then 20 when o_custkey % 70 > 5 then 5 else 2 end)::integer as below from orders")
def nearest_steps(t: Tables) -> DataFrame:
    v = F.col("o_custkey") % 70
    return t.orders.select("o_orderkey", windows.nearest_step(v, (5, 20, 50)).alias("step"), windows.nearest_step(v, (5, 20, 50), below=True).alias("below"))


@query("""with s as (select p_brand as b, p_size % 3 as a, p_partkey as k from part), o as (select k, 'L' || k % 4 as l from s where k % 5 <> 0),
g as (select b, a, list(k order by k) as ks, list(l order by k) as ls from s join o using (k) group by 1, 2)
select b || '/' || a as label, array_to_string(list_transform(coalesce(ks, []), lambda x: 'c' || x), ',') as sources, coalesce((select string_agg(l, ',' order by f) from (select l, min(i) as f from (select unnest(ls) as l, generate_subscripts(ls, 1) as i) group by 1)), '') as lessons from (select distinct b, a from s) x left join g using (b, a)""")
def graph_concepts(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    key = F.concat("p_brand", F.lit("/"), F.col("p_size") % 3)
    accepted = t.part.select(key.alias("id")).distinct().select("id", F.lit(1).alias("ord"), F.col("id").alias("label"), F.lit("d").alias("description"), F.array("id").alias("coverage_criteria"))
    sources = t.part.select(key.alias("accepted_id"), k.alias("pos"), F.concat(F.lit("c"), k).alias("candidate_id"))
    places = t.part.where(k % 5 != 0).select(F.concat(F.lit("c"), k).alias("candidate_id"), F.concat(F.lit("L"), k % 4).alias("lesson_id"))
    return graph.concepts(accepted, sources, places).select("label", F.array_join("source_candidate_ids", ",").alias("sources"), F.array_join("lesson_ids", ",").alias("lessons"))


@query("""select p_brand as scope_id, p_brand || '__p' || p_partkey as id from part where p_partkey % 3 <> 0 union all select p_brand, 'new' || p_partkey from part where p_partkey % 3 = 0""")
def repaired_concepts(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    found = decisions.combine(t.part.select(F.col("p_brand").alias("scope_id"), F.concat(F.lit("p"), k).alias("id")))
    gone = t.part.where(k % 3 == 0).select(F.col("p_brand").alias("scope_id"), F.concat("p_brand", F.lit("__p"), k).alias("id"))
    return decisions.apply_repair(found, gone, t.part.where(k % 3 == 0).select(F.col("p_brand").alias("scope_id"), F.concat(F.lit("new"), k).alias("id")))


@query("select p_brand as scope_id, 'c' || p_partkey as candidate_id from part where p_partkey % 4 <> 0")
def remaining_sources(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("scope_id"), F.concat(F.lit("c"), F.col("p_partkey")).alias("candidate_id"))
    return decisions.without_candidates(rows, t.part.where("p_partkey % 4 = 0").select(F.col("p_brand").alias("scope_id"), F.concat(F.lit("c"), F.col("p_partkey")).alias("candidate_id")))


@query("select o_orderkey, least(3, greatest(0, o_orderkey % 7 - 2))::integer as clarity, case when o_orderkey % 3 = 0 then 0 else 2 end::integer as cover, least(least(3, greatest(0, o_orderkey % 7 - 2)), case when o_orderkey % 3 = 0 then 0 else 2 end)::integer as net_score from orders")
def held_scores(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return extraction.scores(t.orders.select("o_orderkey", (k % 7 - 2).cast("string").alias("clarity"), F.when(k % 3 == 0, "odd").otherwise("2").alias("cover")), ("clarity", "cover"))


@query("""select p_brand as id, p_partkey::varchar as label, 'missing' as problem from part where p_partkey % 2 = 0 union all select p_brand, 'x' || p_partkey, 'unknown' from part where p_partkey % 2 = 0""")
def compared_labels(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    expected = t.part.select(F.col("p_brand").alias("id"), k.cast("string").alias("label"))
    found = t.part.select(F.col("p_brand").alias("id"), F.when(k % 2 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("label"))
    return extraction.compare_labels(expected, found, "id")


@query("select o_orderkey as id, k as forbidden_key from orders, (values ('concepts'), ('graph')) as t(k) where k = 'graph' and o_orderkey % 2 = 0 or k = 'concepts' and o_orderkey % 3 = 0")
def forbidden_keys(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    answer = F.to_json(F.struct(F.when(k % 2 == 0, 1).alias("graph"), F.when(k % 3 == 0, 2).alias("concepts"), F.lit(3).alias("fine")))
    return extraction.forbidden_keys(t.orders.select(k.alias("id"), answer.alias("answer")), "id", "answer", ("graph", "concepts"))


@query("""select conv_id, string_agg('- ' || case when turn % 3 = 0 then '' else '[00:' || lpad((turn * 10 // 60)::varchar, 2, '0') || ':' || lpad((turn * 10 % 60)::varchar, 2, '0') || '.000] ' end || role, chr(10) order by case when turn % 3 = 0 then -1 else turn * 10 end, turn) as markdown from conversations group by 1""")
def transcript_bullets(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.col("turn").alias("cue"), F.when(F.col("turn") % 3 != 0, F.col("turn") * 10.0).alias("start_seconds"), F.col("role").alias("text"))
    return transcripts.as_bullets(rows, "conv_id")


@query("""select conv_id, string_agg('# ' || role, chr(10) || chr(10) order by turn) as markdown from conversations where turn % 3 <> 1 group by 1""")
def stitched_chunks(t: Tables) -> DataFrame:
    said = F.when(F.col("turn") % 3 != 1, F.concat(F.lit(" # "), "role"))
    rows = t.conversations.select("conv_id", "turn", F.coalesce(said, F.lit(" ")).alias("content"))
    return rendering.stitched(rows, "conv_id", "turn", "content").where("markdown <> ''")


@query("""select p_partkey, '# ' || p_name || chr(10) as markdown, '---' || chr(10) || 'title: ' || p_name || chr(10) || 'kind: "' || p_type || ': x"' || chr(10) || '---' || chr(10) as head, 'at ' || p_size as anchors from part""")
def rendered_pieces(t: Tables) -> DataFrame:
    said = F.concat(F.lit("```markdown\n# "), "p_name", F.lit(" \n```\n"))
    anchors = F.array(F.struct(F.lit("page").alias("kind"), F.concat(F.lit(" at "), "p_size").alias("locator")), F.struct(F.lit("page").alias("kind"), F.lit(" ").alias("locator")))
    return t.part.select("p_partkey", rendering.normalize_model_markdown(said).alias("markdown"), markdown.front_matter(title=F.col("p_name"), kind=F.concat("p_type", F.lit(": x"))).alias("head"), F.array_join(extraction.compact_anchors(anchors), ",").alias("anchors"))


@query("""select row_number::varchar as id, kind, title from (select p_partkey as row_number, p_name as title, case when p_partkey % 3 = 0 then 'book' when p_partkey % 3 = 1 then 'video' else 'article' end as kind, p_partkey from part where p_partkey % 7 <> 0 and p_partkey % 5 <> 0)""")
def exported_links(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(
        k.alias("row_number"), F.when(k % 7 == 0, "Class").otherwise(" Self-study").alias("Type"), F.concat(F.lit(" "), "p_name").alias("Title"), F.when(k % 5 == 0, " ").when(k % 3 == 1, "https://youtu.be/abcdef1").otherwise("https://a.b/c").alias("URL"),
        F.when((k % 3 == 0) & (k % 5 != 0), "B1").alias("Code"), F.lit("d").alias("Description"),
    )
    return manifests.export_links(rows).select("id", "kind", "title")


@query("""select 'article' as type, p_partkey::varchar as id from part where p_size in (3, 7) union all select 'book', s_suppkey::varchar from supplier""")
def united_sources(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("string").alias("id"), F.col("p_name").alias("title"))
    wanted, _ = manifests.only_ids(parts, " 3,7 , ,")
    articles = wanted.select(F.col("key").alias("id"), "title")
    return manifests.union_sources(article=articles, book=t.supplier.select(F.col("s_suppkey").cast("string").alias("id"))).select("type", "id")


@query("""with c as (select p_size as concept, p_partkey as k from part where p_partkey % 4 <> 0)
select 'assignment_incomplete' as flag, p_partkey as candidate_id from part where p_partkey % 4 = 0 or p_partkey % 6 = 0 union all select 'provenance_loss', k from c where concept % 5 = 0""")
def merge_guardrails(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    inputs = t.part.select(k.alias("candidate_id"))
    cited = t.part.where(k % 4 != 0).select(F.col("p_size").alias("concept_id"), k.alias("candidate_id"))
    lessons = t.part.select(k.alias("candidate_id"), (k % 3).alias("lesson_id"))
    of = cited.join(lessons, "candidate_id").where("concept_id % 5 <> 0").select("concept_id", "lesson_id")
    return audit.subject_guardrails(t.part.where(k % 6 != 0).select(k.alias("candidate_id")), cited, inputs, of, lessons)


@query("""select p_partkey, p_partkey % 3 = 0 as off_lesson, case p_partkey % 5 when 0 then 'limitation' when 1 then 'implementation' when 2 then 'math' when 3 then 'application' else 'definition' end as depth from part""")
def concept_depths(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    words = F.when(k % 5 == 0, "Drawback, less effective").when(k % 5 == 1, "with Keras").when(k % 5 == 2, "the gradient").when(k % 5 == 3, "a Pipeline").otherwise("an idea")
    return t.part.select("p_partkey", audit.is_off_lesson(F.when(k % 3 == 0, "pip install").otherwise("pipe"), F.col("p_type")).alias("off_lesson"), audit.depth(words, F.lit("x")).alias("depth"))


@query("select doc_id || '_001' as candidate_id, source as label, 'explains ' || source as criterion, 'primary' as role from documents where source is not null")
def stand_in_candidates(t: Tables) -> DataFrame:
    rows = t.documents.where("source is not null").select(F.col("doc_id").cast("string").alias("self_study_id"), F.col("source").alias("title"), "text")
    return models.stand_in_extraction(rows).select("candidate_id", "label", F.get("coverage_criteria", F.lit(0)).alias("criterion"), F.get("source_roles", F.lit(0)).alias("role"))


@query("""select p_partkey, case when p_partkey % 5 = 0 then null else '# ' || case when p_partkey % 2 = 0 then p_name else p_type end || chr(10) || chr(10) || case when p_partkey % 3 = 0 then 'about it' || chr(10) || chr(10) else '' end
  || '## 7. Exercise (' || p_brand || ')' || chr(10) || chr(10) || 'see **' || p_name || '** and [`x`](http://l)' || chr(10) || chr(10) || '- one' || chr(10) || '- twodeep' || chr(10) || '    - deep' || chr(10) || chr(10) || chr(10) || '```' || chr(10) || 'a = ' || p_size || chr(10) || '```' || chr(10) || chr(10) || '> quoted' || chr(10) || chr(10) || chr(10) || '![i](s)' || chr(10) end as markdown from part""")
def page_data(t: Tables) -> DataFrame:
    from corpusloom.operators import pagedata

    k = F.col("p_partkey")
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    said = lambda c: F.concat(F.lit('{"type":"text","value":'), F.regexp_replace(quoted(c), r'^\{"v":|\}$', ""), F.lit("}"))
    plain = lambda x: said(F.lit(x))

    def element(tag, *children, props="{}"):
        parts = [x if i % 2 == 0 else F.concat(F.lit(","), x) for i, x in enumerate(children)] if len(children) < 2 else [F.concat_ws(",", *children)]
        return F.concat(F.lit(f'{{"type":"element","tagName":"{tag}","properties":'), props if not isinstance(props, str) else F.lit(props), F.lit(',"children":['), *parts, F.lit("]}"))

    exercise = element(
        "exercise", element("p", plain("see "), element("strong", said(F.col("p_name"))), plain(" and "), element("a", element("code", plain("x")), props='{"href":"http://l"}')),
        element("ul", plain("\n"), element("li", plain("one")), element("li", plain("two"), element("ul", element("li", plain("deep"))))),
        element("pre", element("code", said(F.concat(F.lit("a = "), "p_size", F.lit("\n"))))), element("blockquote", element("p", plain("quoted"))), props=F.concat(F.lit('{"id":7,"type":"'), "p_brand", F.lit('"}')),
    )
    front = F.to_json(F.struct(F.when(k % 2 == 0, F.col("p_name")).alias("title"), F.when(k % 3 == 0, "about it").alias("description")))
    page = F.concat(F.lit('{"result":{"data":{"markdownRemark":{"frontmatter":'), front, F.lit(',"htmlAst":{"children":['), exercise, F.lit(","), element("img", props='{"src":"s","alt":"i"}'), F.lit("]}}}}}"))
    return t.part.select("p_partkey", pagedata.page_data_to_markdown(F.when(k % 5 != 0, page).otherwise("[1]"), "p_type").alias("markdown"))


@query("""select p_partkey, array_to_string(list_filter(['empty_content', case when p_partkey % 3 = 0 then 'ocr_pdf' end, case when p_partkey % 2 = 0 then 'rewritten_source_url' end], lambda x: x is not null), ',') as flags from part""")
def route_flags(t: Tables) -> DataFrame:
    from corpusloom.operators import gate

    k = F.col("p_partkey")
    notes = F.array_compact(F.array(F.when(k % 2 == 0, "github_blob_pdf_to_raw"), F.when(k % 3 == 0, "pdf_mode_ocr"), F.lit("pdf_mode")))
    found = gate.with_flags(t.part.select("p_partkey", F.lit(" ").alias("content"), notes.alias("notes")), "content", F.lit("a"), F.lit("b"), F.lit("pdf"), route_notes=F.col("notes"))
    return found.select("p_partkey", F.array_join("flags", ",").alias("flags"))


@query(r"""select p_partkey, p_partkey % 3 <> 0 as supported, case when p_partkey % 4 = 0 then 'mailto:X@y' else 'https://h.com/a/b' || case when p_partkey % 2 = 0 then '?a=' || p_size || '&b=1' else '' end end as remote, case when p_partkey % 2 = 0 then 'https://www.youtube.com/watch?v=abc' || p_partkey || 'xyz' else 'http://v/' || p_partkey end as media, p_partkey % 5 = 0 as translated,
  replace(p_brand, '#', '_') || '_' || p_size as folder, replace(p_brand, '#', '_') as fragment from part""")
def address_rules(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    image = F.concat(F.lit("http://i/x."), F.when(k % 3 == 0, F.when(k % 2 == 0, "SVG").otherwise("bmp")).otherwise("png"), F.lit("?v=.svg"))
    remote = F.when(k % 4 == 0, " mailto:X@y ").otherwise(F.concat(F.lit(" HTTPS://H.com//a///b"), F.when(k % 2 == 0, F.concat(F.lit("?b=1&a="), "p_size")).otherwise(""), F.lit("#f")))
    video = F.when(k % 2 == 0, F.concat(F.lit("https://youtu.be/abc"), k, F.lit("xyz?t=1"))).otherwise(F.concat(F.lit("http://v/"), k))
    track = F.concat(F.lit("http://c/?a=1"), F.when(k % 5 == 0, "&tlang=pt").otherwise("&tlang="))
    return t.part.select("p_partkey", urls.is_supported_image(image).alias("supported"), urls.normalize_remote(remote).alias("remote"), urls.media_source(video).alias("media"), urls.is_translated(track).alias("translated"), X.directory_name(F.concat(F.lit("._"), "p_brand", F.lit("_"), "p_size", F.lit("!?"))).alias("folder"), X.id_fragment(F.concat(F.lit("-"), "p_brand", F.lit("-"))).alias("fragment"))


@query("""select conv_id, turn, case turn % 4 when 0 then 'a' || chr(10) || '**Spoken content:**' || chr(10) || role || chr(10) || chr(10) || '**On-screen content:** x' when 1 then 'b' || chr(10) || '**Spoken content:**' || chr(10) || role || chr(10) || chr(10) || '**on-screen content:** y' when 2 then 'c' || chr(10) || '**Spoken content:**' || chr(10) || role || chr(10) else 'd' || chr(10) || chr(10) || '**Spoken content:**' || chr(10) || role || chr(10) end as section from conversations""")
def spoken_sections(t: Tables) -> DataFrame:
    k = F.col("turn") % 4
    section = F.when(k == 0, "a\n**spoken content:** old\n**On-screen content:** x").when(k == 1, "b\n**on-screen content:** y").when(k == 2, "c\n**Spoken Content:** old").otherwise("d \n ")
    return t.conversations.select("conv_id", "turn", rendering.replace_spoken(section, F.col("role")).alias("section"))


@query("""select event_id, array_to_string(list_filter([case event_id % 4 when 1 then 'auto_captions' when 2 then 'local_whisper_fallback' when 3 then 'video_ocr_fallback' end, case when event_id % 4 < 2 and event_id % 3 = 0 then 'caption_language_unknown' end, case when event_id % 5 = 0 or event_id % 7 = 0 then 'sparse_transcript' end], lambda x: x is not null), ',') as warnings from events""")
def video_warnings(t: Tables) -> DataFrame:
    k = F.col("event_id")
    source = F.when(k % 4 == 0, "manual_captions").when(k % 4 == 1, "auto_captions").when(k % 4 == 2, "local_whisper").otherwise("video_ocr")
    found = media.video_warnings(source, F.when(k % 3 != 0, "pt"), F.when(k % 5 == 0, 0).otherwise(9), F.when(k % 7 == 0, 20).otherwise(90), F.when(k % 2 == 0, 100.0).otherwise(300.0))
    return t.events.select("event_id", F.array_join(found, ",").alias("warnings"))


@query("""with l as (select p_brand as s, p_partkey as k, case when p_partkey % 11 = 0 then '' else p_name || p_partkey end as label, case p_partkey % 5 when 0 then 'odd' when 1 then 'lesson_cluster' else 'prerequisite_hint' end as pattern from part)
select s as scope_id, 'w.interpretations[].label is required' as error from l where label = '' union all select s, 'w label ''' || label || ''' has invalid pattern: odd' from l where pattern = 'odd' union all select s, 'w label ''' || label || ''' requires rationale' from l where k % 7 = 0
union all select s, 'w label ''' || label || ''' requires workbook context' from l where k % 13 = 0 union all select s, 'w.interpretations contains duplicate labels' from l group by s having count(*) <> count(distinct label) union all select s, 'active lesson cluster ''' || label || ''' is not classified as lesson_cluster' from l where k % 3 = 0 and label <> '' and pattern <> 'lesson_cluster'""")
def label_errors(t: Tables) -> DataFrame:
    from corpusloom.operators import verdicts

    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, "").otherwise(F.concat("p_name", k))
    rows = t.part.select(F.col("p_brand").alias("scope_id"), name.alias("label"), F.when(k % 5 == 0, "odd").when(k % 5 == 1, "lesson_cluster").otherwise("prerequisite_hint").alias("pattern"), F.when(k % 7 != 0, "why").alias("rationale"), F.when(k % 13 == 0, F.array().cast(_STRINGS)).otherwise(F.array("p_type")).alias("contexts"))
    listed = t.part.where((k % 3 == 0) & (k % 11 != 0)).select(F.col("p_brand").alias("scope_id"), F.lit("lesson_cluster").alias("pattern"), name.alias("label"))
    return verdicts.label_errors(rows, listed, "w")


@query("""select o_orderkey as scope_id, 'q.scores.clarity must be an integer from 0 to 3' as error from orders where o_orderkey % 5 = 4 or o_orderkey % 7 = 0 union all select o_orderkey, 'q.reliability must be reliable or repair_required' from orders where o_orderkey % 3 = 0
union all select o_orderkey, 'q.flags contains unknown flag: odd' from orders where o_orderkey % 2 = 0 union all select o_orderkey, 'q.findings must be a list' from orders where o_orderkey % 11 = 0 union all select o_orderkey, 'q.repair_required requires repair_plan' from orders where o_orderkey % 3 = 1 and o_orderkey % 4 = 0""")
def quality_audit_errors(t: Tables) -> DataFrame:
    from corpusloom.operators import verdicts

    k = F.col("o_orderkey")
    none = F.array().cast(_STRINGS)
    rows = t.orders.select(
        k.alias("scope_id"), F.struct(F.when(k % 7 != 0, k % 5).alias("clarity"), F.lit(3).alias("cover")).alias("scores"), F.when(k % 3 == 0, "?").when(k % 3 == 1, "repair_required").otherwise("reliable").alias("reliability"),
        F.when(k % 2 == 0, F.array(F.lit("known"), F.lit("odd"))).otherwise(none).alias("flags"), F.when(k % 11 != 0, none).alias("findings"), F.when(k % 4 == 0, none).otherwise(F.array(F.lit("x"))).alias("repair_plan"),
    )
    return verdicts.quality_audit_errors(rows, ("clarity", "cover"), "q", ("known",)).select("scope_id", F.explode("errors").alias("error"))


@query("""with c as (select p_brand as s, p_size % 3 as g, p_partkey as k, case p_size % 4 when 0 then 'math' when 1 then 'definition' else 'application' end as d from part), w as (select s, g, bool_or(d = 'definition') as plain from c group by 1, 2 having count(*) >= 2 and count(distinct d) > 1)
select s as scope_id, f as finding, k as candidate_id from c join w using (s, g), (values ('over_merged_group'), ('granularity_violation')) as t(f) where f = 'over_merged_group' or plain""")
def depth_findings(t: Tables) -> DataFrame:
    from corpusloom.operators import verdicts

    depth = F.when(F.col("p_size") % 4 == 0, "math").when(F.col("p_size") % 4 == 1, "definition").otherwise("application")
    return verdicts.depth_findings(t.part.select(F.col("p_brand").alias("scope_id"), (F.col("p_size") % 3).alias("concept_id"), F.col("p_partkey").alias("candidate_id"), depth.alias("depth")))


@query("""with g as (select l_orderkey as o, l_suppkey % 3 as s, count(*) as n from lineitem group by 1, 2), r as (select *, row_number() over (partition by o order by s) as i from g) select o as lesson_id, i::integer as segment_index, 's' || s as label, n::integer as concept_count from r where n >= 3""")
def segment_warnings(t: Tables) -> DataFrame:
    from corpusloom.operators import stages

    each = t.lineitem.groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("s")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("concept_ids"))
    rows = each.groupBy(F.col("l_orderkey").alias("lesson_id")).agg(F.array_sort(F.collect_list(F.struct("s", F.concat(F.lit("s"), "s").alias("label"), "concept_ids"))).alias("segments"))
    return stages.segment_warnings(rows, 3)
