from decimal import Decimal

import pytest
from tests.llm.helpers import ODD, docs

from corpusloom.llm import sharding
from corpusloom.llm.common import scratch


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_rows_come_back_whole_through_appends_and_merges(spark):
    data = docs(spark, [*ODD, *((i, f"text {i} " * 50) for i in range(100, 400))])
    columns = [c for c in data.columns if dict(data.dtypes)[c] != "void"]
    data = data.select(*columns).repartition(6, "doc_id")
    store = sharding.ShardStore(spark, scratch(spark, "store"), target_bytes=20_000, base_bytes=1000, least_runs=3)
    for k in range(3):
        store.append(data.where(f"coalesce(doc_id, 0) % 3 = {k}"))
    before = store.manifest()
    n_before, files = before.count(), store.version()
    assert rows_of(store.read(), columns) == rows_of(data, columns)
    while store.compact() != files:
        files = store.version()
    now = store.manifest()
    assert now.count() < n_before and rows_of(store.read(), columns) == rows_of(data, columns)
    assert now.agg({"rows": "sum"}).first()[0] == data.count()
    open_tiers = now.where(f"bytes < {sharding.FINISHED * 20_000}").groupBy("tier").count().where("count >= 3")
    assert open_tiers.isEmpty()
    assert rows_of(store.read(1), columns) == rows_of(data.where("coalesce(doc_id, 0) % 3 = 0"), columns)  # older versions stay
    store.vacuum()
    assert store.versions() == [files] and rows_of(store.read(), columns) == rows_of(data, columns)


def test_a_version_is_committed_once(spark):
    a = sharding.ShardStore(spark, scratch(spark, "store"))
    b = sharding.ShardStore(spark, a.root)
    a.append(docs(spark, [(1, "a")]).select("doc_id", "text"))
    manifest = b.manifest()
    with pytest.raises(sharding.CommitConflict):
        b._commit(manifest, 0)
    assert a.versions() == [1] and b.append(docs(spark, [(2, "b")]).select("doc_id", "text")) == 2
    assert sorted(r.doc_id for r in a.read().collect()) == [1, 2]


def test_query_form(spark):
    data = docs(spark, ODD).select("doc_id", "text")
    out = sharding.sharded(data)
    assert sorted((tuple(r)[:2] for r in out.collect()), key=str) == sorted(((i, t) for i, t in ODD), key=str)
    assert out.select("_version").distinct().count() == 1
    empty = sharding.sharded(docs(spark, []).select("doc_id", "text"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "_shard", "_version"]


def test_a_lost_writer_leaves_the_store_as_it_was(spark):
    store = sharding.ShardStore(spark, scratch(spark, "store"))
    store.append(docs(spark, [(1, "a")]).select("doc_id", "text"))
    fs, path = store._fs, lambda at: store._path(f"{store.root}/{at}")
    fs.create(path(f"versions/{2:012d}"), False).close()  # created and not yet written, as other tools may do
    fs.create(path("versions/.v-lost"), False).close()  # a writer lost before its commit
    assert store.versions() == [1] and store.read().count() == 1
    fs.delete(path(f"versions/{2:012d}"), False)
    assert store.append(docs(spark, [(2, "b")]).select("doc_id", "text")) == 2 and store.read().count() == 2


def test_writers_build_on_each_other(spark, monkeypatch):
    a = sharding.ShardStore(spark, scratch(spark, "store"), target_bytes=20_000, base_bytes=1000, least_runs=2)
    b = sharding.ShardStore(spark, a.root, target_bytes=20_000, base_bytes=1000, least_runs=2)
    row = lambda i: docs(spark, [(i, "x")]).select("doc_id", "text").coalesce(1)
    for i in range(3):
        a.append(row(i))
    commit, raced = a._commit, []

    def late(manifest, base):
        if not raced:
            raced.append(b.append(row(9)))
        return commit(manifest, base)

    monkeypatch.setattr(a, "_commit", late)
    assert a.compact() == 5 and sorted(r.doc_id for r in a.read().collect()) == [0, 1, 2, 9]

    raced.clear()
    for i in range(3, 6):
        b.append(row(i))

    def merged(manifest, base):
        if not raced:
            raced.append(b.compact())
        return commit(manifest, base)

    monkeypatch.setattr(a, "_commit", merged)
    with pytest.raises(sharding.CommitConflict):
        a.compact()
    assert sorted(r.doc_id for r in a.read().collect()) == [0, 1, 2, 3, 4, 5, 9]


def test_vacuum_leaves_what_is_about_to_be_committed(spark):
    store = sharding.ShardStore(spark, scratch(spark, "store"))
    for i in range(2):
        store.append(docs(spark, [(i, "x")]).select("doc_id", "text"))
    folder = f"{store.root}/data/arrival-of-another"
    docs(spark, [(5, "y")]).select("doc_id", "text").coalesce(1).write.parquet(folder)
    store.vacuum()
    assert store._add(store._shards(folder)) == 3 and sorted(r.doc_id for r in store.read().collect()) == [0, 1, 5]
    docs(spark, [(6, "z")]).select("doc_id", "text").write.parquet(f"{store.root}/data/lost")
    store.vacuum(grace_seconds=-5)
    names = {x.getPath().getName() for x in store._fs.listStatus(store._path(f"{store.root}/data"))}
    assert "lost" not in names and "arrival-of-another" in names and store.read().count() == 3
    assert store._fs.listStatus(store._path(f"{store.root}/manifests")).__len__() == 1


def test_names_that_clash(spark):
    data = docs(spark, ODD).selectExpr("doc_id", "text", "1 as _metadata", "2 as _shard", "3 as _version", "4 as arrival", "5 as path")
    out = sharding.sharded(data)
    assert out.columns == [*data.columns, "_shard_", "_version_"]
    assert rows_of(out, data.columns) == rows_of(data, data.columns) and out.where("_shard_ = ''").isEmpty()


def test_merges_are_those_of_the_tiers(spark):
    store = sharding.ShardStore(spark, scratch(spark, "store"), target_bytes=60_000, base_bytes=1500, factor=3, least_runs=3)
    import random

    rng = random.Random(2)
    for n in (1, 1, 1, 40, 300, 45, 50, 2):
        store.append(docs(spark, [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(40))) for i in range(n)]).select("doc_id", "text").coalesce(1))
    before = {r.path: r.asDict() for r in store.manifest().collect()}
    tier = lambda size: next(t for t in range(40) if size <= 1500 * 3**t)
    by_tier = {}
    for path, r in before.items():
        assert r["tier"] == tier(r["bytes"])
        if r["bytes"] < 0.75 * 60_000:
            by_tier.setdefault(r["tier"], []).append(path)
    merged = {t: paths for t, paths in by_tier.items() if len(paths) >= 3}
    assert len(merged) >= 1
    version = store.compact()
    after = {r.path: r.asDict() for r in store.manifest().collect()}
    gone = {p for paths in merged.values() for p in paths}
    assert before.keys() - after.keys() == gone and {p for p in after if after[p]["added"] == version} == after.keys() - before.keys()
    new = [after[p] for p in after.keys() - before.keys()]
    assert sum(r["rows"] for r in new) == sum(before[p]["rows"] for p in gone)
    assert len(new) <= sum(max(1, round(sum(before[p]["bytes"] for p in paths) / 60_000)) for paths in merged.values())


def test_a_store_below_a_folder_of_the_same_name(spark):
    data = docs(spark, ODD).select("doc_id", "text")
    store = sharding.shard(data, f"{scratch(spark, 'lake')}/data/of/data/store", target_bytes=2000, base_bytes=100, least_runs=2)
    store.vacuum(grace_seconds=0)
    out = store.read(with_shard=True)
    assert rows_of(out, ["doc_id", "text"]) == rows_of(data, ["doc_id", "text"])
    assert {len(r._shard.split("/")) for r in out.collect()} <= {2, 3}


def test_no_column_is_lost_whatever_the_order_of_files(spark):
    for _ in range(6):
        store = sharding.ShardStore(spark, scratch(spark, "store"), least_runs=2)
        store.append(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string").coalesce(1))
        store.append(spark.createDataFrame([(3, "c", "new")], "doc_id bigint, text string, more string").coalesce(1))
        want = [(1, "a", None), (2, "b", None), (3, "c", "new")]
        assert rows_of(store.read(), ["doc_id", "text", "more"]) == want
        assert store.read(1).columns == ["doc_id", "text"]
        store.compact()
        store.vacuum(grace_seconds=0)
        assert store.manifest().count() == 1 and rows_of(store.read(), ["doc_id", "text", "more"]) == want


def test_types_that_differ_hold_every_value(spark):
    arrivals = [
        ([(1, 2**62, 1.5, {"x": 1}, ["a"], "t", 7)], "id int, n bigint, v float, s struct<x:int>, l array<string>, odd string, m int"),
        ([(2**40, 3, 2.25, {"X": 5, "y": "z"}, ["b"], 12, None)], "ID bigint, n int, v double, s struct<X:bigint,y:string>, l array<string>, odd int, m void"),
        ([(3, 1.5, 9, None, [7], [1, 2], Decimal("1.25"))], "id int, n double, v int, s struct<x:int>, l array<int>, odd array<int>, m decimal(9,2)"),
    ]
    store = sharding.ShardStore(spark, scratch(spark, "store"), least_runs=2)
    for rows, schema in arrivals:
        frame = spark.createDataFrame(rows, schema)
        store.append(frame.select(*[c for c, kind in frame.dtypes if kind != "void"]).coalesce(1))
    types = {"id": "bigint", "n": "string", "v": "double", "s": "struct<x:bigint,y:string>", "l": "array<string>", "odd": "string", "m": "decimal(12,2)"}
    for _ in range(2):
        assert dict(store.read().dtypes) == types
        got = {r.id: r for r in store.read().collect()}
        assert {k: r.n for k, r in got.items()} == {1: str(2**62), 2**40: "3", 3: "1.5"} and got[2**40].v == 2.25 and got[3].v == 9.0
        assert got[1].s == (1, None) and got[2**40].s == (5, "z") and got[3].s is None
        assert [got[k].l for k in (1, 2**40, 3)] == [["a"], ["b"], ["7"]] and [got[k].odd for k in (1, 2**40, 3)] == ["t", "12", "[1,2]"]
        assert str(got[1].m) == "7.00" and str(got[3].m) == "1.25" and got[2**40].m is None
        store.compact()
        store.vacuum(grace_seconds=0)
    assert store.manifest().count() == 1


def test_common_types():
    from pyspark.sql import types as t

    common = sharding.common_type
    assert common(t.LongType(), t.DoubleType()) == t.StringType() and common(t.FloatType(), t.IntegerType()) == t.DoubleType()
    assert common(t.DecimalType(38, 0), t.DecimalType(38, 10)) == t.StringType() and common(t.ByteType(), t.LongType()) == t.LongType()
    assert common(t.StringType(), t.BinaryType()) == t.BinaryType() and common(t.DateType(), t.IntegerType()) == t.StringType()
