"""Plans and results that only larger tables would show to be wrong."""

import re

import pytest
from pyspark.sql import functions as F


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_segments_are_parsed_once_for_all_their_errors(spark):
    from corpusloom.operators import answers, verdicts

    rows = spark.createDataFrame([(1, '{"segments":[{"label":" ","concept_ids":["c1","c1","zz"]}]}', ["c1", "c2"]), (2, '{"segments":[{"label":"a","concept_ids":["c1"]}]}', ["c1"])], "lesson_id long, answer string, expected_concept_ids array<string>")
    found = verdicts.each_error(verdicts.segment_errors(answers.segments(rows), "d"), "lesson_id")
    assert planned(found).count("parseJson") == 1
    assert sorted(r.error for r in found.collect()) == [
        "d.segments are missing Concept IDs: c2", "d.segments include extra Concept IDs: zz", "d.segments repeat Concept IDs: c1", "d.segments[0].concept_ids references unknown Concept ID: zz", "d.segments[0].label is required",
    ]


def test_segment_errors_query_parses_once(spark, tmp_path):
    from corpusloom.plans import registry

    spark.range(20).select(F.col("id").alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert planned(registry.queries()["segment_errors"](spark, str(tmp_path))).count("parseJson") == 1


def assert_same_as_sql(spark, folder, name, **tables):
    """The rows of a query over small tables are those that DuckDB gives."""
    duckdb = pytest.importorskip("duckdb")
    from corpusloom.plans import registry
    from tests.test_queries import rows

    c = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        c.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, str(folder)), c.sql(registry.oracles()[name])
    found = rows(got.columns, got.collect())
    assert found == rows(want.columns, want.fetchall())
    return found


def test_books_pages_keep_their_order_beside_large_part_keys(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, 2_500_001, 30.0), (1, 2, 11, 30.0), (1, 3, 1_200_003, 30.0), (2, 2, 7, 30.0), (2, 3, 9, 30.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double")
    found = assert_same_as_sql(spark, tmp_path, "book_gates", lineitem=lines, orders=spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey long"))
    assert [r[2] for r in found] == ["passed", "failed_gate", "failed_gate"]


def test_keys_of_requests_with_a_limit_that_is_tried_anyway_come_once(spark, tmp_path):
    part = spark.createDataFrame([(k, f"n {k}", "Brand#1", size) for k, size in ((120_000, 1), (120_001, 1), (120_002, 4), (240_000, 2), (240_000_000, 3))], "p_partkey long, p_name string, p_brand string, p_size int")
    found = assert_same_as_sql(spark, tmp_path, "cache_keys", part=part)
    assert {r[-1]: r[3] for r in found} == {"120000": "3", "120001": "4", "120002": "3", "240000": "3", "240000000": "4"}


def test_an_address_of_several_pages_has_one_file(spark, tmp_path):
    at = "http://a.example/x"
    pages = spark.createDataFrame([(9, at, "later"), (3, at, "first"), (4, at, "other"), (5, at, "none"), (1, "http://a.example/y", "remote"), (6, "http://a.example/z", None), (12, None, "nowhere")], "page_id long, url string, html string")
    found = {r[-1]: r[0] for r in assert_same_as_sql(spark, tmp_path, "source_fingerprints", pages=pages)}
    assert found["9"] == found["3"] == found["4"] and '"size_bytes":5' in found["3"] and '"kind":"local_file"' in found["3"]
    assert '"kind":"remote_video_url"' in found["1"] and '"kind":"remote_video_url"' in found["6"] and '"kind":"unresolved_source"' in found["5"]


def test_candidates_of_a_subject_stand_where_they_first_come(spark, tmp_path):
    kept = [k for k in range(1880, 3600, 200) if k % 9]
    part = spark.createDataFrame([(k, "Brand#22", f"n{k}", "SMALL TIN", 7) for k in reversed(kept)], "p_partkey long, p_brand string, p_name string, p_type string, p_size int")
    found = assert_same_as_sql(spark, tmp_path, "residual_duplicates", part=part)
    assert [r[0] for r in found] == [",".join(f"c{k}" for k in kept)]


def test_repairs_are_parsed_once_for_all_their_errors(spark):
    from corpusloom.operators import answers, verdicts

    answer = '{"accepted_concepts":[{"id":"k1","label":" ","description":"d","merge_rationale":"m","coverage_criteria":["x"],"source_candidate_ids":["c1"]},"odd"],"candidate_assignments":[{"candidate_id":"c1","status":"used_in","accepted_ids":["k1","k9"]},{"candidate_id":"c1","status":""}]}'
    rows = spark.createDataFrame([(1, ["c1", "c2"], ["old"], answer), (2, [], [], '{"candidate_assignments":[]}')], "scope_id long, target_candidate_ids array<string>, existing_ids array<string>, answer string")
    found = verdicts.each_error(verdicts.repair_errors(answers.repairs(rows), "d"), "scope_id")
    assert planned(found).count("parseJson") == 1
    assert sorted(r.error for r in found.collect()) == [
        "candidate_assignments[0] references unknown accepted concept k9", "candidate_assignments[1].status must be used_in, merged_into, or pruned", "d assigns candidates more than once: c1", "d must assign every target candidate: c2", "new_accepted_concepts[0].label is required",
    ]


def test_repair_errors_query_parses_once(spark, tmp_path):
    from corpusloom.plans import registry

    spark.range(20).select(F.col("id").alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert planned(registry.queries()["repair_errors"](spark, str(tmp_path))).count("parseJson") == 1


def test_slugs_look_for_wide_characters_by_a_few_ranges(spark):
    import unicodedata

    from corpusloom.functions import text as X

    texts = ["½ cup, é " + "ab, " * 10_000, "日本語 " * 3000 + "ﬁn É", "й" * 600 + " - " * 300 + "Straße № 5 " * 80, "-" * 1000, "", None, "x" * 89 + "--" + "y" * 600, "😀™ " * 200 + "Ångström", "…" * 600]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: (r.a, r.f) for r in rows.select("i", X.ascii_slug("t", "source").alias("a"), X.fold_accents("t").alias("f")).collect()}
    assert max(c.count("\\x{") for c in re.findall(r"\[[^\[\]]*\]", planned(rows.select(X.fold_accents("t"))))) in range(1, 200)
    for i, t in enumerate(texts):
        folded = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode()
        slug = re.sub("[^a-z0-9]+", "-", folded.lower()).strip("-")[:90].rstrip("-")
        assert found[i] == (slug or "source", folded)


def test_entries_travel_once_to_their_concepts_provenance(spark):
    from corpusloom.operators import changes

    entries = spark.createDataFrame([(1, "c1", "l1", "t", "a", "p", "o1", ["s1"], None, ["body"], [([("page", 1)],), (None,)], "definition")], "scope_id int, candidate_id string, lesson_id string, title string, label string, artifact_path string, original_candidate_id string, source_candidate_ids array<string>, source_roles array<string>, evidence_types array<string>, evidence array<struct<anchors:array<struct<kind:string,at:int>>>>, depth string")
    found = changes.provenance(spark.createDataFrame([(1, "k", 1, "c1")], "scope_id int, concept_id string, pos bigint, candidate_id string"), entries)
    below = planned(found).partition("Aggregate [")[2].partition("\n")[2]
    assert below and "flatten(" not in below and "struct(" not in below
    (one,) = found.collect()
    assert one.refs[0].anchors == [("page", 1)] and one.refs[0].source_candidate_ids == one.occurrences[0].source_candidate_ids == ["s1"] and one.occurrences[0].source_roles == []
