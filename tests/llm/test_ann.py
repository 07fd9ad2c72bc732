import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, score int, rank string"


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            near = [(-float((v * w).sum() / (math.sqrt((v * v).sum()) * math.sqrt((w * w).sum()))), i) for i, w in ok.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def search(spark, rows, every=10, k=5):
    table = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "r") for i, v in rows], SCHEMA)
    found = ann.search(ann.build_index(table.repartition(3)), F.col("vec_id") % every == 0, k).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_rotation_keeps_inner_products():
    x = np.random.default_rng(1).normal(size=(9, 100))
    assert np.allclose(ann.rotate(x) @ ann.rotate(x).T, x @ x.T)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scalar = ann.encode(x)
    q = x[:1]
    guess = ann.estimate(codes, np.bitwise_count(codes).sum(1), scalar, ann.rotate(q)[0])
    error = guess - x @ q[0]
    assert abs(error[1:].mean()) < 0.01
    assert (np.abs(error) <= ann.error_bound(scalar, 64) + 0.02).mean() > 0.99


def test_recall_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 48)))]
    want = brute(rows, 5, 10)
    got = search(spark, rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.98 * sum(map(len, want.values()))
    monkeypatch.setattr(ann, "PASS_BYTES", 48 * 8 * 20)  # queries in many passes
    assert search(spark, rows) == got


def test_odd_vectors(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(1, 40)] + [(0, same), (50, None), (60, [0.0, 0.0, 0.0]), (70, [1.0, None, 2.0]), (80, [1.0, float("nan"), 0.0]), (90, [1.0, float("inf"), 0.0]), (None, same), (100, [1.0, 2.0]), (110, []), (41, [-0.5, 0.25, -1.0])]
    got = search(spark, rows)
    want = brute(rows, 5, 10)
    assert got.keys() == {0, 10, 20, 30}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and all(abs(s - 1) < 1e-12 for _, s in got[q])
    few = search(spark, [(10, [1.0, 0.0]), (11, [0.0, 1.0])])
    assert few == {10: [(11, 0.0)]}
    assert search(spark, []) == {}


def test_every_row_is_a_candidate_of_its_own(spark):
    rng = np.random.default_rng(5)
    rows = [(0, v) for v in [rng.normal(size=8)]] + [(1, rng.normal(size=8)) for _ in range(8)] + [(i, rng.normal(size=8)) for i in range(2, 6)]
    got = search(spark, rows)[0]
    q = np.array(rows[0][1], dtype=np.float32).astype(float)
    want = sorted((-float(ann.cosine(np.array(v, dtype=np.float32).astype(float)[None], q)[0]), i) for i, v in rows[1:])[:5]
    assert [i for i, _ in got] == [i for _, i in want] and all(abs(s + w) < 1e-12 for (_, s), (w, _) in zip(got, want))
    same = [0.5, 0.25]
    # Each of three rows asks, and the other two are its neighbours.
    repeated = spark.createDataFrame([(i, v, 1, "r") for i, v in [(0, same)] * 3 + [(4, same)] * 3 + [(7, same), (2, same), (5, [1.0, -1.0])]], SCHEMA)
    found = sorted((r.rank, r.vec_id) for r in ann.search(ann.build_index(repeated), F.col("vec_id") == 0).collect())
    assert found == [x for pair in enumerate([0, 0, 2, 4, 4], 1) for x in [pair] * 3]


def test_large_and_small_components_have_finite_scores(spark):
    rows = [(10, [1e200, 2e200, 0.0]), (1, [1e200, 2.1e200, 0.0]), (2, [1e-200, 2e-200, 1e-200]), (3, [-1.0, 0.0, 1e-300])]
    table = spark.createDataFrame([(i, v, 1, "r") for i, v in rows], "vec_id bigint, embedding array<double>, score int, rank string")
    got = ann.search(ann.build_index(table), F.col("vec_id") % 10 == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3] and all(math.isfinite(r.score) and abs(r.score) <= 1 + 1e-12 for r in got)


def test_rows_that_share_an_id_ask_and_are_found_one_by_one(spark):
    rows = [(10, [0.0, 1.0]), (10, [1.0, 0.0]), (1, [0.1, 1.0]), (2, [1.0, 0.1]), (10, [0.0, 2.0])]
    table = lambda rs: spark.createDataFrame([(i, v, 1, "r") for i, v in rs], SCHEMA)
    for given in (rows, rows[::-1]):
        got = sorted((r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(ann.build_index(table(given)), F.col("vec_id") % 10 == 0).collect())
        want = []
        for i, (q, v) in enumerate(rows):
            if q % 10 == 0:
                near = sorted((-sum(a * b for a, b in zip(v, w)) / math.hypot(*v) / math.hypot(*w), j) for k, (j, w) in enumerate(rows) if k != i)
                want += [(rank, j, round(-s, 6)) for rank, (s, j) in enumerate(near, 1)]
        assert got == sorted(want)


def test_lists_of_structured_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 32))
    rows = [(i, centres[rng.integers(0, 60)] + 0.4 * rng.normal(size=32)) for i in range(6000)]
    table = spark.createDataFrame([(i, [float(x) for x in v], 1, "r") for i, v in rows], SCHEMA)
    index = ann.build_index(table)
    lists = ann._lists_of(index.codes, 5)[32]
    assert len(lists.centroids) > 50 and lists.probes <= 0.3 * len(lists.centroids)
    assert len(ann.learn_lists(rng.normal(size=(6000, 64)), 6000).centroids) == 1  # no structure: no lists
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, 6000, 100):
        near = unit @ unit[q]
        near[q] = -2
        want[q] = set(np.argsort(-near)[:5].tolist())

    def recall():
        got = {}
        for r in ann.search(index, F.col("vec_id") % 100 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
        return sum(len(got[q] & want[q]) for q in want) / (5 * len(want))

    assert recall() >= 0.95
    monkeypatch.setattr(ann, "SLICE_BYTES", 32 * 8 * 20)  # a list in many slices
    assert recall() >= 0.95
