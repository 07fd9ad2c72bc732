import random

import numpy as np
import xxhash
from tests.llm.helpers import ODD, docs

from corpusloom.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_plain_one():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("aB é\t\n\x1f ") for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint("") == 0


def test_gray_rank_walks_through_the_gray_code():
    codes = np.array([i ^ (i >> 1) for i in range(300)], dtype=np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(300))


def codes_near(rng, n, groups=12, flips=4):
    centres = [rng.getrandbits(64) for _ in range(groups)]
    out = {rng.getrandbits(64) for _ in range(n // 4)}
    while len(out) < n:
        c = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            c ^= 1 << rng.randrange(64)
        out.add(c)
    return np.array(sorted(out), dtype=np.uint64)


def test_index_finds_all_pairs_within_a_distance():
    rng = random.Random(5)
    codes = codes_near(rng, 700)
    for distance in (0, 2, 5):
        index = simhash.GrayIndex(codes)
        found = {(int(codes[a]), int(index.codes[b])) for who, node in index.near(codes, distance, block=97) for a, b in zip(who, node)}
        plain = {(int(a), int(b)) for a in codes for b in codes[np.bitwise_count(codes ^ a) <= distance]}
        assert found == plain


def components(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(codes, distance):
    return components(codes.tolist(), [(int(a), int(b)) for a in codes for b in codes[np.bitwise_count(codes ^ a) <= distance]])


def test_links_connect_what_brute_force_connects(spark):
    codes = codes_near(random.Random(7), 900)
    table = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp bigint")
    for distance, segments, size in ((2, 3, 4096), (2, 3, 16), (3, 5, 4096)):
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(table, distance, segments, size).collect()]
        assert all((a ^ b).bit_count() <= distance for a, b in links)
        assert components(codes.tolist(), links) == brute_components(codes, distance)


def test_query_rows_for_odd_inputs(spark):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, ODD)).collect()}
    assert simhash.near_duplicates(docs(spark, ODD)).count() == len(ODD)
    zero = "0" * 16
    assert {(2, zero, 2), (3, zero, 2), (4, zero, 2)} <= got
    by_id = {d: (f, c) for d, f, c in got}
    assert by_id[7] == by_id[1] and by_id[1][1] == 1
    assert by_id[None][1] is None
    assert all(f"{plain_fingerprint(t):016x}" == by_id[d][0] for d, t in ODD)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, 6, 8, None], key=str)


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"other{rng.getrandbits(40)}"
    return out


def own_words(rng, n):
    return [f"w{rng.getrandbits(40)}" for _ in range(n)]


def test_copies_behind_long_filler_are_all_compared(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):  # each has the fingerprint of its filler
        tail = own_words(rng, 60)
        texts += [tail, changed(rng, tail, 1), changed(rng, tail, 2)]
    rng.shuffle(texts)
    texts = ["spam " * 200 + " ".join(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
    want = {r for r in components(range(len(texts)), pairs).values()}
    assert len({simhash.fingerprint(t, 2) for t in texts}) == 1 and len(want) <= len(texts) - 12
    assert {r.doc_id for r in simhash.keep_one(docs(spark, list(enumerate(texts)))).collect()} == want


def test_members_of_a_band_left_apart_by_its_head_are_compared(spark):
    rng = random.Random(12)
    stem = own_words(rng, 200)
    texts = []
    for _ in range(15):  # ends of their own keep the groups apart (Jaccard about 0.66), yet most share bands
        group = stem + own_words(rng, 50)
        texts += [" ".join(changed(rng, group, 1)) for _ in range(3)]
    rng.shuffle(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
    want = {r for r in components(range(len(texts)), pairs).values()}
    assert len(want) == 15
    assert {r.doc_id for r in simhash.keep_one(docs(spark, list(enumerate(texts)))).collect()} == want
    marked = docs(spark, list(enumerate(texts))).selectExpr("doc_id", "text", f"sha1(cast(text as binary)) as {simhash._DIGEST}")
    sliced = simhash.verified_classes(marked, 6, 8, 2, 5, 0.8, slice_size=4)
    assert {r.component_id for r in sliced.collect()} == want


def test_copies_of_each_similarity_are_found(spark):
    rng = random.Random(13)
    texts, groups = [], 0
    for n in (60, 200, 600):
        for _ in range(60):
            base = own_words(rng, n)
            copy = changed(rng, base, rng.randint(1, max(1, n // 40)))
            if jaccard(" ".join(base), " ".join(copy)) >= 0.8:
                texts += [" ".join(base), " ".join(copy)]
                groups += 1
    near = [(a, b) for a, b in zip(texts[::2], texts[1::2]) if jaccard(a, b) < 0.9]
    assert len(near) > 50 and sum((simhash.fingerprint(a, 2) ^ simhash.fingerprint(b, 2)).bit_count() > 6 for a, b in near) > 5
    assert simhash.keep_one(docs(spark, list(enumerate(texts)))).count() == groups


def test_components_of_long_chains_and_hubs(spark):
    from corpusloom.llm.components import connected_components

    rng = random.Random(1)
    chain = list(range(1, 200))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(1000, 1000 + i) for i in range(1, 50)] + [(5000 - i, 5000) for i in range(1, 50)] + [(7, 7), (None, 3)]
    table = spark.createDataFrame(pairs, "a bigint, b bigint")
    roots = {r.node: r.root for r in connected_components(table).collect()}
    assert {roots[x] for x in chain} == {1} and roots[1049] == 1000 and roots[5000] == 4951
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def removable(texts):
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
    return set(components(range(len(texts)), pairs).values())


def test_edited_groups_are_found_whole(spark):
    rng = random.Random(14)
    texts, want = [], set()
    for _ in range(60):
        base = own_words(rng, 120)
        group = [" ".join(changed(rng, base, rng.randint(1, 3))) for _ in range(7)]
        want |= {len(texts) + i for i in removable(group)}
        texts += group
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, list(enumerate(texts)))).collect()}
    gone = len(texts) - len(want)
    assert gone > 100 and len(texts) - len(kept) >= 0.99 * gone and len(kept) >= len(want)


def test_every_pair_of_a_large_band_is_compared(spark):
    rng = random.Random(21)
    sets = []
    for _ in range(60):
        own = rng.sample(range(1000), 40)
        sets += [sorted({*own[: rng.randint(36, 40)], *rng.sample(range(1000, 2000), rng.randint(0, 3))}) for _ in range(rng.randint(1, 5))]
    n = len(sets)
    assert n > 140  # so over 64 slices of two
    members = spark.createDataFrame([(1, i, len(s), n) for i, s in enumerate(sets)], "bucket bigint, no bigint, size bigint, head bigint")
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "no bigint, shingles array<bigint>")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    found = [(r.a, r.b) for r in simhash._apart(members, roots, table, 0.8, 2).collect()]
    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    pairs = [(i, j) for i in range(n) for j in range(i) if alike(sets[i], sets[j])]
    assert pairs and {(max(p), min(p)) for p in found} <= {(max(p), min(p)) for p in pairs}
    assert components(range(n), found) == components(range(n), pairs)


def test_a_large_band_is_dealt_out(spark):
    rng = random.Random(15)
    stem = own_words(rng, 200)
    texts = [" ".join(changed(rng, stem + own_words(rng, 50), 1)) for _ in range(6)]
    texts += [" ".join(changed(rng, t.split(), 1)) for t in texts for _ in range(3)]
    marked = docs(spark, list(enumerate(texts))).selectExpr("doc_id", "text", f"sha1(cast(text as binary)) as {simhash._DIGEST}")
    for size in (2, 4096):
        found = simhash.verified_classes(marked, 6, None, 2, 5, 0.8, slice_size=size).collect()
        assert {r.component_id for r in found} == removable(texts) and sum(r.stays for r in found) == len(removable(texts))


def test_links_within_are_those_of_all_pairs():
    rng = random.Random(16)
    for n in (1, 2, 30):
        base = list(range(40))
        sets = [np.array(sorted({*rng.sample(base, 36), *rng.sample(range(100, 400), rng.randint(0, 8))})) for _ in range(n)] + [np.empty(0, dtype=np.int64)] * 2
        classes = np.array([rng.randint(0, 3) if i % 2 else 10 + i for i in range(len(sets))])
        side = np.array([rng.random() < 0.5 for _ in sets])
        alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))  # noqa: E731, B023
        for of in (None, side):
            pairs = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]) and (of is None or of[i] != of[j])]
            given = [(i, j) for i in range(len(sets)) for j in range(i) if classes[i] == classes[j]]
            found = simhash.links_within(sets, classes, 0.8, of)
            assert set(found) <= {(j, i) for i, j in pairs}
            assert components(range(len(sets)), given + found) == components(range(len(sets)), given + pairs)


def test_rows_are_told_by_their_text(spark):
    text, other = "one text that comes again and again here", "quite another text that has nothing of it"
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs(spark, rows)).collect()), key=str)
    assert kept([(None, text), (4, text), (None, other), (None, other)]) == sorted([(4, text), (None, other)], key=str)
    twin = text + " " + " ".join(f"w{i}" for i in range(60))
    assert len(kept([(7, twin), (7, twin + " end"), (8, twin)])) == 1
    clash = docs(spark, [(1, text), (2, text), (2, other)]).withColumnRenamed("html", simhash._DIGEST)
    out = simhash.keep_one(clash)
    assert out.columns == clash.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]
    assert {r[simhash._DIGEST] for r in out.collect()} == {None}


def test_segments_follow_the_count():
    assert simhash.segments_for(10, 2) == 3 and simhash.segments_for(10**10, 2) > 3
    assert all(d < simhash.segments_for(n, d) <= 64 for n in (1, 10**6, 10**12) for d in (0, 1, 2, 6))
