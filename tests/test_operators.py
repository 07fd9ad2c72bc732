import json
import zipfile

from pyspark.sql import functions as F

from corpusloom.operators import audit, decisions, extraction, joins, markdown, media, models, rendering, transcripts, windows
from corpusloom.sources import manifests
from corpusloom.sources.workbook import WorkbookSource
from corpusloom.streaming import progress


def plain_windows(d, longer_than, chunk, overlap, fps=1.0):
    if d is None or d <= longer_than:
        return [(1, None, None)]
    size = max(60, chunk)
    step_back, tail, out, start = max(0, min(overlap, size // 3)), max(30.0, min(120.0, 2.0 / fps)), [], 0.0
    while True:
        end = min(d, start + size)
        if out and d - end < tail:
            end = d
        out.append((len(out) + 1, round(start, 3), round(end, 3)))
        if end >= d:
            return out
        start = end - step_back


def test_chunk_windows_for_many_durations(spark):
    durations = [None, 0.0, 59.0, 60.0, 61.0, 89.0, 90.0, 91.0, 119.0, 120.0, 149.9, 150.0, 150.1, 170.0, 200.0, 299.0, 300.5, 1000.0]
    spans = spark.createDataFrame(list(enumerate(durations)), "k int, d double")
    for longer, chunk, overlap in ((60, 60, 0), (60, 90, 20), (0, 100, 1000), (100, 30, 10)):
        got = {}
        for r in windows.chunk_windows(spans, "k", "d", longer, chunk, overlap).orderBy("k", "index").collect():
            got.setdefault(r.k, []).append((r["index"], r.start_seconds, r.end_seconds))
        want = {k: plain_windows(d, longer, chunk, overlap) for k, d in enumerate(durations)}
        assert got == want, (longer, chunk, overlap)


def test_overlap_join_meets_each_pair_once(spark):
    segments = spark.createDataFrame([(1, "a", 0.0, 25.0), (1, "b", 9.0, 10.0), (1, "c", None, None), (2, "d", 5.0, 5.0)], "k int, s string, start double, end double")
    w = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 10.0, 40.0), (2, 1, 5.0, 6.0)], "k int, w int, ws double, we double")
    pairs = lambda closed: sorted((r.k, r.s, r.w) for r in joins.overlapping(segments, w, "k", "start", "end", "ws", "we", 7.0, closed).collect())
    assert pairs(True) == [(1, "a", 1), (1, "a", 2), (1, "b", 1), (1, "b", 2), (1, "c", 1), (1, "c", 2), (2, "d", 1)]


def test_last_and_first_win(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert {(r.k, r.v) for r in joins.last_wins(rows, ["k"], "o").collect()} == {(1, "b"), (2, "c")}
    assert {(r.k, r.v) for r in joins.first_wins(rows, ["k"], "o").collect()} == {(1, "a"), (2, "c")}


def test_omitted_candidates_stand_for_themselves(spark):
    inputs = spark.createDataFrame([("s", 1, "c1"), ("s", 2, "c2"), ("s", 3, "c3")], "scope_id string, ord int, candidate_id string")
    sources = spark.createDataFrame([("s", "k", 0, "c2")], "scope_id string, accepted_id string, pos int, candidate_id string")
    schema = "scope_id string, ord int, candidate_id string, status string, accepted_ids array<string>, merged_into string, reason string, explanation string"
    assignments = spark.createDataFrame([("s", 1, "c1", "pruned", [], None, "incidental", "x"), ("s", 2, "c1", "review", [], None, None, "y")], schema)
    found = decisions.canonical_assignments(assignments, sources, inputs, "used_in")
    assert {(r.candidate_id, r.status, tuple(r.accepted_ids)) for r in found.collect()} == {("c1", "pruned", ()), ("c2", "used_in", ("k",)), ("c3", "used_in", ("standalone_c3",))}
    labels = inputs.select("scope_id", "candidate_id", F.lit("l").alias("label"), F.lit("d").alias("description"))
    assert [r.id for r in decisions.standalone(found, labels).collect()] == ["standalone_c3"]


def test_a_valid_decision_has_no_violations(spark):
    inputs = spark.createDataFrame([("s", 1, "c1"), ("s", 2, "c2")], "scope_id string, ord int, candidate_id string")
    sources = spark.createDataFrame([("s", "k", 0, "c1")], "scope_id string, accepted_id string, pos int, candidate_id string")
    accepted = spark.createDataFrame([("s", 1, "k", "l", "d", ["c"], "r")], "scope_id string, ord int, id string, label string, description string, coverage_criteria array<string>, merge_rationale string")
    schema = "scope_id string, ord int, candidate_id string, status string, accepted_ids array<string>, merged_into string, reason string, explanation string"
    ok = [("s", 1, "c1", "used_in", ["k"], None, None, None), ("s", 2, "c2", "pruned", [], None, "duplicate", "same")]
    found = lambda rows: {r.violation for r in decisions.decision_violations(accepted, sources, spark.createDataFrame(rows, schema), inputs).collect()}
    assert found(ok) == set()
    assert found([ok[0], ("s", 2, "c2", "merged_into", [], "nope", None, None)]) == {"referenced concept is unknown"}
    assert found([ok[0]]) == {"candidate has no assignment"}
    assert found([("s", 1, "c1", "pruned", [], None, "whim", ""), ok[1]]) == {"reason is unknown", "explanation is missing", "dropped candidate is used as evidence"}


def test_depth_and_markers(spark):
    t = spark.createDataFrame([("Gradient of a matrix",), ("Using a library",), ("Plain idea",), ("A drawback of using it",)], "t string")
    assert [r.d for r in t.select(audit.depth(F.col("t")).alias("d")).collect()] == ["math", "implementation", "definition", "limitation"]
    assert [r.d for r in spark.createDataFrame([("Pip install",), ("Pipeline",)], "t string").select(audit.is_off_lesson(F.col("t")).alias("d")).collect()] == [True, False]


def test_markdown(spark):
    pages = spark.createDataFrame([(1, 2, " b "), (1, 1, "a"), (1, 3, " "), (2, 1, None)], "k int, o int, c string")
    assert {r.k: r.markdown for r in markdown.combined(pages, "k", "o", "c").collect()} == {1: "a\n\nb", 2: ""}
    head = spark.range(1).select(markdown.front_matter(title=F.lit("A: b"), n=F.lit(3)).alias("v")).first().v
    assert head == '---\ntitle: "A: b"\nn: 3\n---\n'
    bullets = transcripts.as_bullets(spark.createDataFrame([(1, 0, 61.5, "x"), (1, 1, None, "y")], "k int, cue int, start_seconds double, text string"), "k").first().markdown
    assert bullets == "- y\n- [00:01:01.500] x"


def test_manifests(spark, tmp_path):
    assert manifests.read_manifest(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "title": " t ", "url": "http://u"}, {"id": "2", "title": "v", "url": "http://w"}]))
    rows = manifests.read_manifest(spark, f"{tmp_path}/a.json")
    assert [(r.id, r.title) for r in rows.orderBy("id").collect()] == [("1", "t"), ("2", "v")]
    some, missing = manifests.only_ids(rows, " 2, 12 ,")
    assert [r.id for r in some.collect()] == ["2"] and [r.id for r in missing.collect()] == ["12"]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/7-b.md").write_text("second")
    (tmp_path / "texts/7-a.md").write_text("first")
    assert [(r.id, r.text) for r in manifests.artifact_texts(spark, f"{tmp_path}/texts").collect()] == [("7", "first")]
    assert {r.type for r in manifests.union_sources(book=rows, video=rows).collect()} == {"book", "video"}


def workbook(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [
        f'<row r="1">{cell("A1", "Type")}{cell("B1", "Title")}{cell("C1", "URL")}{cell("D1", "Code")}{cell("E1", "Description")}{cell("F1", "Weight")}</row>',
        f'<row r="2">{cell("A2", "Self-study")}{cell("B2", "One")}{cell("C2", "https://youtu.be/abcdef12345")}<c r="F2"><v>3.0</v></c></row>',
        f'<row r="3">{cell("A3", " ")}</row>',
        f'<row r="4">{cell("A4", "Self-study")}{cell("B4", "Two")}{cell("D4", "ISBN 1")}</row>',
        f'<row r="5">{cell("A5", "Self-study")}{cell("B5", "None")}</row><row r="6">{cell("A6", "Class")}{cell("C6", "http://x")}</row>',
    ]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>')


def test_workbook_rows_and_routes(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    spark.dataSource.register(WorkbookSource)
    rows = spark.read.format("workbook").option("sheet", "S").option("path", str(tmp_path / "w.xlsx")).load()
    assert [r.row_number for r in rows.collect()] == [2, 4, 5, 6] and rows.first().Weight == "3"
    assert [(r.id, r.kind) for r in manifests.export_links(rows).orderBy("id").collect()] == [("2", "video"), ("4", "book")]


def test_events_stream_like_a_table(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"), F.concat(F.lit("k"), F.col("id") % 3).alias("event_type"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = progress.counts_by_window(progress.read_events(spark, f"{tmp_path}/in", rows.schema), "ts", "event_type", late="1 minute")
    progress.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    extra = spark.range(1).select(F.timestamp_seconds(F.lit(1_700_900_000)).alias("ts"), F.lit("k0").alias("event_type"))
    extra.write.mode("append").parquet(f"{tmp_path}/in")
    progress.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, progress.counts_by_window(rows, "ts", "event_type").collect()))


def test_rendering(spark):
    page = "<html><head><title>t</title></head><body><script>x</script><h2>A &amp; B</h2><p>One <b>two</b> <a href='u'>three</a><br>four</p><ol><li>x</li><li>y <img src='i' alt='z'></li></ol><ul><li>n</li></ul><pre>a\n  b</pre><blockquote>q</blockquote></body></html>"
    assert rendering.render(page) == "## A & B\n\nOne **two** [three](u) four\n\n1. x\n\n2. y ![z](i)\n\n- n\n\n```\na\n  b\n```\n\n> q"
    assert rendering.render(None) == "" and rendering.render("<p>open") == "open"
    table = "before\n| | |\n| --- | --- |\n| 1<br>2 | import x<br>y = &lt;1 |\nafter"
    got = spark.createDataFrame([(table,), (None,)], "t string").select(rendering.code_tables_to_fences("t").alias("v")).collect()
    assert [r.v for r in got] == ["before\n```python\nimport x\ny = <1\n```\nafter", None]


def test_reader_pages(spark):
    rows = spark.createDataFrame([("x", "https://login.site/x"), ("Please sign in", "https://a/b"), ("", "https://a/b"), ("text", "https://a/pageid/12")], "c string, u string")
    assert [r.v for r in rows.select(media.needs_manual_access(F.col("c"), F.col("u")).alias("v")).collect()] == ["login_url", "manual_message", "empty_page", None]
    assert rows.select(media.reader_page_id(F.col("u")).alias("v")).collect()[3].v == "12"


def test_stages_are_blocked_or_repaired(spark):
    import pytest

    prompts = spark.range(3)
    bad = lambda df: df.withColumn("v", F.lit(-1))
    good = lambda df: df.withColumn("v", F.col("id"))
    check = lambda df: df.where("v < 0")
    assert models.run_stage(prompts, bad, lambda d: d, check, good).count() == 3
    with pytest.raises(ValueError):
        models.run_stage(prompts, bad, lambda d: d, check)
    router = models.Router({"a": models.Route("a", "m")}, {"x": "a"})
    assert router.resolve("x").model == "m"
    with pytest.raises(KeyError):
        router.resolve("y")


def test_reordering_and_roles(spark):
    schema = "lesson_id int, segment_id string, label string, concept_ids array<string>"
    before = spark.createDataFrame([(1, "a", "A", ["x", "y"]), (1, "b", "B", ["z"])], schema)
    after = spark.createDataFrame([(1, "b", "B", ["z"]), (1, "a", "A", ["y", "x"])], schema)
    assert extraction.same_segments(before, after).count() == 0
    changed = spark.createDataFrame([(1, "b", "B2", ["z"]), (1, "c", "C", [])], schema)
    assert {(r.segment_id, r.problem) for r in extraction.same_segments(before, changed).collect()} == {("a", "missing"), ("b", "changed"), ("c", "unknown")}
    assert spark.range(1).select(extraction.canonical_roles(F.array(F.lit("Main"), F.lit("primary"), F.lit("ref"))).alias("v")).first().v == ["primary", "reference"]
    assert [r.forbidden_key for r in extraction.forbidden_keys(spark.createDataFrame([(1, '{"edges":1,"a":2}')], "id int, j string"), "id", "j", ("edges", "b")).collect()] == ["edges"]


def test_contexts_and_repeats(spark):
    schema = "k int, w int, cue int, start_seconds double, text string"
    rows = spark.createDataFrame([(1, 1, 0, 61.0, " a  b "), (1, 1, 1, None, "c"), (1, 2, 0, 5.0, "x" * 50), (1, 2, 1, 6.0, " ")], schema)
    got = {r.w: r.context for r in transcripts.context(rows, ["k", "w"], 30).collect()}
    assert got == {1: "[01:01] a b\nc", 2: "[00:05] " + "x" * 22 + transcripts.TRUNCATED}
    frames = spark.createDataFrame([(1, i, t) for i, t in enumerate(["one two three four five six seven eight nine ten", "One two three four five six seven eight nine", "else", "else", "", None, "one"])], "k int, o int, text string")
    assert sorted(r.o for r in transcripts.without_repeats(frames, "k", "o").collect()) == [0, 2, 4, 6]


def test_guardrails(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    cited = t([("k1", "a"), ("k1", "b"), ("k2", "c")], "concept_id string, candidate_id string")
    lessons = t([("a", "l1"), ("b", "l2"), ("c", "l3")], "candidate_id string, lesson_id string")
    ids = t([("a",), ("b",), ("c",), ("d",)], "candidate_id string")
    got = audit.subject_guardrails(ids, cited, ids, t([("k1", "l1"), ("k2", "l3")], "concept_id string, lesson_id string"), lessons)
    assert {(r.flag, r.candidate_id) for r in got.collect()} == {("assignment_incomplete", "d"), ("provenance_loss", "a"), ("provenance_loss", "b")}


def test_small_rules(spark):
    row = spark.range(1).select(
        media.preferred_languages(F.lit("Aprender Python"))[0].alias("a"), media.retry_after(F.lit("3.5"), F.current_timestamp()).alias("b"),
        media.retry_after(F.lit("Wed, 21 Oct 2015 07:28:10 GMT"), F.to_timestamp(F.lit("2015-10-21 07:28:00"))).alias("c"), media.is_transient(F.lit("X HTTP 429: wait")).alias("d"),
    ).first()
    assert tuple(row) == ("pt", 3.5, 10.0, True)
    from corpusloom.functions import urls

    row = spark.range(1).select(urls.page_data_url(F.lit("https://s.io/usage/x/")).alias("a"), urls.first_url(F.lit("see (https://a.b/c?d=1).")).alias("b")).first()
    assert tuple(row) == ("https://s.io/page-data/usage/x/page-data.json", "https://a.b/c?d=1")
