import random

from pyspark.sql import functions as F
from tests.llm.helpers import ODD, docs

from corpusloom.llm import mixing


def fill(budget, children):
    """Shares of {name: (cap, weight)} by filling in rounds."""
    got = dict.fromkeys(children, 0.0)
    for zero in (False, True):
        active = {c for c, (cap, w) in children.items() if (w <= 0) == zero and cap > 0}
        while active and budget > 1e-9:
            weight = {c: (children[c][0] if zero else children[c][1]) for c in active}
            total = sum(weight.values())
            gave = {c: min(children[c][0] - got[c], budget * weight[c] / total) for c in active}
            for c, g in gave.items():
                got[c] += g
            budget -= sum(gave.values())
            active = {c for c in active if children[c][0] - got[c] > 1e-9}
    return got


def plan(leaves, weights, share, epochs):
    """Budgets of {(a, b, c): supply} level by level."""
    cap = {}
    for leaf, n in leaves.items():
        for i in range(4):
            cap[leaf[:i]] = cap.get(leaf[:i], 0) + n * epochs
    budget = {(): min(sum(leaves.values()) * share, cap[()])}
    for i in range(3):
        for parent in [p for p in budget if len(p) == i]:
            children = {c: (cap[c], weights.get("/".join(c), cap[c])) for c in cap if len(c) == i + 1 and c[:i] == parent}
            budget |= fill(budget[parent], children)
    return {leaf: budget[leaf] for leaf in leaves}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, domain string, lang string, source string")


def check(spark, rows, weights, share, epochs):
    w = spark.createDataFrame(list(weights.items()) or [("none", 1.0)], "node string, weight double")
    out = mixing.mix(table(spark, rows), w, share=share, epochs=epochs).collect()
    leaves, texts = {}, {}
    for i, t, *leaf in rows:
        leaves[tuple(leaf)] = leaves.get(tuple(leaf), 0) + len(t.split())
        texts.setdefault(tuple(leaf), {})[i] = len(t.split())
    want = plan(leaves, weights, share, epochs)
    taken = {}
    for r in out:
        taken.setdefault((r.domain, r.lang, r.source), {}).setdefault(r.epoch, []).append(r.doc_id)
    for leaf, b in want.items():
        epochs_of = taken.get(leaf, {})
        used = sum(texts[leaf][d] for ds in epochs_of.values() for d in ds)
        whole = [e for e, ds in epochs_of.items() if sorted(ds) == sorted(texts[leaf])]
        assert used <= b + 0.5 + 1e-6
        assert b - used <= max(texts[leaf].values()) + 0.5, (leaf, b, used)
        assert len(whole) >= int((b + 0.4) // leaves[leaf]) and len(epochs_of) <= len(whole) + 1
        assert all(len(ds) == len(set(ds)) for ds in epochs_of.values())
    return out


def random_rows(seed, n=400):
    rng = random.Random(seed)
    return [(i, "w " * rng.randint(1, 30), rng.choice("AB"), rng.choice(["en", "de"]), "hot" if rng.random() < 0.4 else rng.choice("xyz")) for i in range(n)]


def test_budgets_follow_weights_and_shortages_go_to_siblings(spark):
    for seed, weights, share, epochs in (
        (1, {}, 0.5, 1.0),
        (2, {"A": 5.0, "B": 1.0, "A/en": 9.0, "A/de": 1.0, "A/en/x": 100.0}, 0.7, 1.0),
        (3, {"A": 0.0, "B": 1.0, "B/en/hot": 50.0}, 0.9, 1.0),
        (4, {"A": 1.0, "B": 3.0}, 1.5, 3.0),
    ):
        check(spark, random_rows(seed), weights, share, epochs)


def test_seeded_prefix_is_stable_and_grows(spark):
    rows = random_rows(9, 200)
    w = spark.createDataFrame([("none", 1.0)], "node string, weight double")
    pick = lambda share, seed=1: {r.doc_id for r in mixing.mix(table(spark, rows), w, share=share, seed=seed).collect()}
    assert pick(0.3) == pick(0.3) != pick(0.3, 2)
    assert pick(0.3) <= pick(0.6) <= pick(1.0) and len(pick(1.0)) == 200


def test_odd_rows(spark):
    data = docs(spark, ODD)
    out = mixing.mix(mixing.with_domain(data), mixing.default_weights(spark), share=1.0, epochs=1.0)
    assert out.count() == len(ODD)
    kept = mixing.keep_mixed(data, 1.0)
    assert kept.columns == data.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in ODD), key=str)
    assert mixing.keep_mixed(docs(spark, []), 0.5).count() == 0
    null = data.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    assert mixing.keep_mixed(null, 1.0).count() == len(ODD)


def test_slashes_and_empty_sets_in_names(spark):
    rows = [(i, "w " * 10, *leaf) for i in range(30) for leaf in [(("a/b", "c", "s"), ("a", "b/c", "s"), ("∅", "x%2Fy", "s"))[i % 3]]]
    rows += [(100 + i, "w " * 10, None, "x/y", "s") for i in range(10)]
    out = mixing.mix(table(spark, rows), spark.createDataFrame([("a%2Fb", 1.0), ("a", 1.0), ("∅", 1.0), ("%E2%88%85", 2.0)], "node string, weight double"), share=0.5).collect()
    taken = {}
    for r in out:
        taken[r.domain] = taken.get(r.domain, 0) + r._tokens
    assert len({r.doc_id for r in out}) == len(out) and taken == {"a/b": 40, "a": 40, None: 40, "∅": 80}
    assert sorted(r.n for r in table(spark, rows).select(mixing.node_of(F.col("domain"), F.col("lang")).alias("n")).distinct().collect()) == ["%E2%88%85/x%252Fy", "a%2Fb/c", "a/b%2Fc", "∅/x%2Fy"]


def test_rows_without_an_id_are_drawn_like_others(spark):
    data = docs(spark, [(None, f"text number {i} of these") for i in range(40)] + [(i, f"text number {i} with an id") for i in range(40)])
    kept = mixing.keep_mixed(data, 0.5).collect()
    assert 36 <= len(kept) <= 40 and 8 < sum(r.doc_id is None for r in kept) < 32


def test_ranges_stay_even_without_ids(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "0 as _whole", "xxhash64(concat('text ', id)) as _text")
    most = mixing.placed(rows, 1).groupBy("_range").count().agg({"count": "max"}).first()[0]
    assert most <= 40  # seven or so of 4,096 ranges each
