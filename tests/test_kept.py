"""Sinks, call pairs as a stream, numbers over whole tables, kept interpretations, file indexes and keys."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import labels, ordinals
from corpusloom.sources import files, sinks
from corpusloom.streaming import calls


def seen(folder):
    return sorted(os.path.relpath(f"{d}/{n}", folder) for d, _, names in os.walk(folder) for n in names)


def test_files_are_written_all_or_none(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [("a/b", "x.json", '{"b": 1, "a": ["é", null]}'), ("a", "y.txt", "plain\n"), (None, "top.json", "[]"), ("a", "z.txt", None)]
    table = lambda rs: spark.createDataFrame(rs, sinks.FILES).repartition(3)
    sinks.write_files(table(rows), path, sort=True)
    assert seen(tmp_path / "out") == ["a/b/x.json", "a/y.txt", "a/z.txt", "top.json"]
    assert (tmp_path / "out/a/b/x.json").read_text() == json.dumps({"b": 1, "a": ["é", None]}, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    back = {(r.scope, r.name): r.payload for r in sinks.read_files(spark, path).collect()}
    assert back[("a", "y.txt")] == "plain\n" and back[("", "top.json")] == "[]\n" and len(back) == 3
    for bad in ([("n", f"{i}.txt", "t") for i in range(30)] + [("n", "bad.json", "{")], [("n", "same.txt", "1")] * 2, [("../n", "x.txt", "1")], [("n", None, "1")]):
        with pytest.raises(Exception):  # noqa: B017
            sinks.write_files(table(bad), path)
        assert seen(tmp_path / "out") == ["a/b/x.json", "a/y.txt", "a/z.txt", "top.json"]
    sinks.write_files(table([("a", "y.txt", "new")]), path)
    assert (tmp_path / "out/a/y.txt").read_text() == "new"


@pytest.mark.parametrize("given", ["{}", "{}/", "file:{}", "file://{}"])
def test_files_are_found_however_their_folder_is_given(spark, tmp_path, given):
    path = given.format(tmp_path / "o.u+t é 1")
    rows = {("a/b", "x.txt", "1"), ("c", "y.txt", "2"), ("", "z.txt", "3")}
    sinks.write_files(spark.createDataFrame(sorted(rows), sinks.FILES), path)
    assert {tuple(r) for r in sinks.read_files(spark, path).collect()} == rows


def test_a_commit_whose_driver_is_lost_is_finished(tmp_path):
    base = tmp_path / "out"
    (base / "_staging/j/0-1/s").mkdir(parents=True)
    (base / "_commits").mkdir()
    (base / "s").mkdir()
    (base / "_staging/j/0-1/s/b.json").write_text("2")
    (base / "s/a.json").write_text("1")  # moved already
    assert sinks.recover(f"file://{base}") == []
    (base / "_commits/j.json").write_text(json.dumps({"s/a.json": "_staging/j/0-1/s/a.json", "s/b.json": "_staging/j/0-1/s/b.json"}))
    assert sinks.recover(f"file://{base}") == ["j"] and seen(base) == ["s/a.json", "s/b.json"] and (base / "s/b.json").read_text() == "2"


def test_files_of_a_stage(spark):
    results = spark.createDataFrame([("l1", "{}")], "id string, artifact string")
    log = spark.createDataFrame([("l1", 1, None, "x"), ("l1", 2, "format_repair", "{}"), ("l2", 1, None, None)], "id string, attempt int, repair_type string, raw string")
    got = {tuple(r) for r in sinks.stage_files(results, log, "st", "out.json").collect()}
    assert got == {("l1", "out.json", "{}"), ("l1/raw_model_outputs/st", "attempt_1.txt", "x"), ("l1/raw_model_outputs/st", "attempt_2_format_repair.txt", "{}")}


def plain_pairs(events, limit):
    out, state = [], {}
    for key, at, kind in events:
        began, attempt = state.get(key, (None, 1))
        if began is not None and (kind == "start" or at - began > limit):
            out.append((key, began, None, "lost", attempt))
            began, attempt = None, attempt + 1
        if kind == "start":
            began = at
        elif began is not None:
            out.append((key, began, at, kind, attempt))
            began, attempt = None, 1 if kind == "returned" else attempt + 1
        state[key] = (began, attempt)
    return sorted(str(x) for x in out + [(k, b, None, "lost", n) for k, (b, n) in state.items() if b is not None])


def test_stream_and_table_pair_the_same_calls(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((rng.choice("abc"), 1000 + rng.randint(0, 40_000), rng.choice(["start", "start", "returned", "error"])) for _ in range(300))
    rows = sorted(set(rows), key=lambda r: (r[1], r[0]))
    rows = list({(k, t): (k, t, kind) for k, t, kind in rows}.values())
    schema = "key string, time timestamp, order bigint, kind string"
    table = spark.createDataFrame([(k, t, i, kind) for i, (k, t, kind) in enumerate(rows)], "key string, t bigint, order bigint, kind string").select("key", F.timestamp_seconds("t").alias("time"), "order", "kind")
    line = lambda r: str((r.key, r.s, r.e, r.outcome, r.attempt))
    shown = lambda df: sorted(line(r) for r in df.select("key", F.unix_seconds("started").alias("s"), F.unix_seconds("ended").alias("e"), "outcome", "attempt").collect())
    want = plain_pairs(rows, 600)
    assert shown(calls.paired(table, 600)) == want
    # As files that come one by one, each in disorder.
    parts = table.withColumn("f", F.ntile(4).over(Window.orderBy("time")))
    for k in range(1, 5):
        parts.where(f"f = {k}").drop("f").orderBy(F.rand(k)).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    for k in (5, 6):
        spark.createDataFrame([("end", 10**9 + k, k, "error")], "key string, t bigint, order bigint, kind string").select("key", F.timestamp_seconds("t").alias("time"), "order", "kind").coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        calls.paired_stream(stream, 600, "1 hour").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.unset(provider)
    assert shown(spark.read.parquet(f"{tmp_path}/out")) == want


def test_numbers_without_a_task_that_holds_all(spark):
    ids = ["10", "9", "007", "x", "", "1" * 60, "2" + "0" * 59, "b10", "٣", None] + [str(i) for i in range(100, 2000)]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").repartition(5)
    got = [r.id for r in ordinals.batch_results(rows).orderBy("ordinal").collect()]
    plain = sorted(ids, key=lambda x: (0, int(x), "") if x and x.isascii() and x.isdigit() else (1, 0, x or ""))
    assert [x or "" for x in got] == [x or "" for x in plain]
    found = ordinals.batch_results(rows)
    assert sorted(r.ordinal for r in found.collect()) == list(range(1, len(ids) + 1)) and "SinglePartition" not in found._jdf.queryExecution().toString()
    assert ordinals.batch_results(rows.where("id = 'none'")).count() == 0


def test_only_labels_whose_contexts_changed_are_interpreted(spark):
    asked = []

    def classify(left):
        asked.append(sorted({r.label for r in left.collect()}))
        return left.select("label", F.lit("lesson_cluster").alias("pattern"), F.lit("low").alias("confidence"), F.lit("new").alias("rationale")).distinct()

    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("", 9), (None, 9)], "label string, at int")
    none = spark.createDataFrame([], labels.STORED)
    stored = labels.interpreted(first, none, classify).select("label", "pattern", "confidence", "rationale", "digest")
    second = spark.createDataFrame([("a", 2), ("a", 1), ("c", 3)], "label string, at int")
    third = spark.createDataFrame([("a", 2), ("a", 3), ("c", 3)], "label string, at int")
    assert {r.label: r.reused for r in labels.interpreted(second, stored, classify).collect()} == {"a": True, "c": False}
    assert {r.label: r.reused for r in labels.interpreted(third, stored, classify).collect()} == {"a": False, "c": False}
    assert asked == [["a", "b"], ["c"], ["a", "c"]]
    odd = spark.createDataFrame([("a", "no pattern", "h", "r", None), ("c", "lesson_cluster", None, "r", None), ("a", "lesson_cluster", "h", "", None)], labels.STORED)
    got = {r.label: (r.reused, r.confidence) for r in labels.interpreted(second, odd, classify).collect()}
    assert got == {"a": (False, "low"), "c": (True, "existing")}


def test_unchanged_files_are_not_read_again(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    (tmp_path / "in/sub").mkdir(parents=True)
    content = {"a.bin": b"x" * (3 << 20), "sub/b.bin": b"b", "c.bin": bytes(range(256))}
    for n, data in content.items():
        (tmp_path / "in" / n).write_bytes(data)
    first = files.file_index(spark, path).collect()
    name = lambda r: r.path.split("/in/")[1]
    assert {name(r): (r.sha256, r.bytes_read) for r in first} == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in content.items()}
    known = spark.createDataFrame(first, files.INDEX)
    assert {r.bytes_read for r in files.file_index(spark, path, known).collect()} == {0}
    (tmp_path / "in/c.bin").write_bytes(b"other")
    os.remove(tmp_path / "in/sub/b.bin")
    again = {name(r): (r.sha256, r.bytes_read) for r in files.file_index(spark, path, known).collect()}
    assert again == {"a.bin": (hashlib.sha256(content["a.bin"]).hexdigest(), 0), "c.bin": (hashlib.sha256(b"other").hexdigest(), 5)}


def test_keys_are_hashes_of_sorted_json(spark):
    compact = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    spaced = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    params = {"url": "http://é/\"q\"\x1f\n", "timeout": 5, "z": [1, {"b": None, "a": True}], "maxAge": 0, "formats": ["markdown"]}
    frame = spark.createDataFrame([(json.dumps(params), "s", "b1", None, "u\x0b")], "params string, strategy string, id string, code string, url string")
    c = F.col
    row = frame.select(
        files.request_key(c("params"), c("strategy")).alias("key"), files.request_keys(c("params"), c("strategy")).alias("keys"), files.book_key(c("id"), c("code"), c("url"), F.lit("ok"), F.lit(None).cast("string"), F.lit("1")).alias("book"),
        files.audio_key(F.lit('{"kind":"x"}'), F.array(F.lit("pt")), F.lit(None).cast("string"), F.array(F.lit("-t"), F.lit("4"))).alias("audio"),
    ).first()
    request = lambda p: compact({"endpoint": files.SCRAPE_URL, "request_params": p, "strategy": "s"})
    less = {k: v for k, v in params.items() if k not in files.PASSING}
    assert row.key == request(less) and row["keys"] == [request(less), request(params), request(params | {"timeout": 120_000}), request(params | {"timeout": 240_000})]
    assert row.book == spaced({"book_id": "b1", "resource_code": None, "url": "u\x0b", "scope": {"status": "ok", "kind": None, "value": "1"}, "scope_prompt_version": files.SCOPE_PROMPT_VERSION, "capture_version": files.CAPTURE_VERSION})
    assert row.audio == compact({"audio_pass_version": files.AUDIO_PASS_VERSION, "source": {"kind": "x"}, "preferred_languages": ["pt"], "whisper_model": "", "whisper_extra_args": ["-t", "4"]})
    sources = spark.createDataFrame([("file:/v/a.mp4",), ("https://Youtu.be/abc?b=2&a=1#t",), ("http://x//y",), ("odd",), (None,)], "source string")
    index = spark.createDataFrame([("file:/v/a.mp4", 5, None, "ff", 0)], files.INDEX)
    got = {r.source: json.loads(r.fingerprint) for r in files.fingerprints(sources, index).collect()}
    assert got["file:/v/a.mp4"] == {"kind": "local_file", "path": "file:/v/a.mp4", "sha256": "ff", "size_bytes": 5}
    assert got["https://Youtu.be/abc?b=2&a=1#t"] == {"kind": "youtube_url", "url": "https://youtu.be/abc?a=1&b=2"} and got["http://x//y"]["url"] == "http://x/y" and got[None] == {"kind": "unresolved_source", "source": None}
