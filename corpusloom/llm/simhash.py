"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints are 64-bit. The index over them is a tree: fingerprints are sorted by their rank in the reflected Gray
code, neighbours in that order are grouped, and each node keeps the bit pattern that all below it share (a mask of
agreed positions and their values). A search walks down the levels; the differences found on a node's own agreed
positions accumulate along the path and a whole group is left as soon as they exceed the allowed distance.

Over executors the top of the tree is cut by the pigeonhole rule: the 64 positions are parted into `segments`
runs, and two fingerprints at most `max_distance` apart agree wholly on at least `segments - max_distance` of them.
Every choice of that many runs is one orientation of the index, whose top nodes are the patterns on these runs; a pair
needs to be sought only below equal top nodes of some orientation, so nothing is broadcast and no pair is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, give_back, materialise, release, table
from corpusloom.llm.components import connected_components

BITS = 64
SEED = 42
#: Fingerprints to a leaf group, and groups to a group of the next level.
FAN_OUT = 16
#: Fingerprints of one bucket that meet in one task; a larger bucket is dealt out in pairs of slices of this size.
SLICE = 4096


# ---- fingerprints ---------------------------------------------------------------------------------------------


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """The unsigned SimHash of a whole text; 0 where it has no words (or is null)."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()  # of bytes: A-Z only, and space with \t\n\v\f\r only
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([h(joined, SEED)], dtype=np.uint64)
    else:
        ends = list(itertools.accumulate(map(len, words)))
        ends = [e + i for i, e in enumerate(ends)]
        starts = [0, *(e + 1 for e in ends)]
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])), dtype=np.uint64, count=len(words) - shingle + 1)
    bits = 2 * _bit_counts(hashes) > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, and fp (the fingerprint as a signed bigint), a row for each row. A null text is one without words."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("_text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(fps.view(np.int64))], names=[*names, "fp"])

    chosen = docs.select(*names, F.col(text).cast("binary").alias("_text"))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in names) + ", fp bigint"
    return chosen.mapInArrow(run, schema)


# ---- the hierarchical index -----------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence: bit i is the parity of bits i and up."""
    rank = codes.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A static tree over codes in Gray order. Level 0 holds the codes; each level above groups FAN_OUT nodes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask, value = np.full(len(self.codes), every), self.codes
        levels = [(mask, value)]
        while len(value) > 1:
            cuts = np.arange(0, len(value), FAN_OUT)
            ones = np.bitwise_and.reduceat(value & mask, cuts)
            zeros = np.bitwise_and.reduceat(~value & mask, cuts)
            mask, value = ones | zeros, ones
            levels.append((mask, value))
        # What a parent already has of the pattern is taken out of its children: differences accumulate on the path.
        self.levels = []
        for depth, (mask, value) in enumerate(levels):
            if depth + 1 < len(levels):
                mask = mask & ~np.repeat(levels[depth + 1][0], FAN_OUT)[: len(mask)]
            self.levels.append((mask, value))

    def near(self, queries: np.ndarray, distance: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (place of the query, place of the code in self.codes) at most distance apart, the nearest first."""
        for at in range(0, len(queries), block):
            q = queries[at : at + block]
            mask, value = self.levels[-1]
            who = np.repeat(np.arange(len(q)), len(value))
            node = np.tile(np.arange(len(value)), len(q))
            seen = np.zeros(len(who), dtype=np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, value = self.levels[depth]
                if depth < len(self.levels) - 1:
                    left = np.minimum(FAN_OUT, len(value) - node * FAN_OUT)
                    who, seen = np.repeat(who, left), np.repeat(seen, left)
                    first = np.repeat(node * FAN_OUT, left)
                    node = first + np.arange(len(first)) - np.repeat(np.cumsum(left) - left, left)
                seen = seen + np.bitwise_count((q[who] ^ value[node]) & mask[node])
                keep = seen <= distance
                who, node, seen = who[keep], node[keep], seen[keep]
            if len(who):
                order = np.argsort(seen, kind="stable")
                yield who[order] + at, node[order]


class _Forest:
    """Union-find over places, the smaller place as the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def forest_links(codes: np.ndarray, distance: int, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (at most distance apart) that connect what all links among the codes connect, fewer than codes in number.

    With others, links between codes and others are sought instead.
    """
    index = GrayIndex(codes)
    if others is None:
        values, sought, shift = index.codes, index.codes, 0
    else:
        values, sought, shift = np.concatenate([index.codes, others]), others, len(codes)
    forest, out = _Forest(len(values)), []
    for who, node in index.near(sought, distance):
        if others is None:
            who, node = who[who > node], node[who > node]
        for a, b in zip((who + shift).tolist(), node.tolist()):
            if forest.join(a, b):
                out.append((int(values[a]), int(values[b])))
    return out


# ---- the join over executors ----------------------------------------------------------------------------------


def segment_masks(max_distance: int, segments: int) -> list[int]:
    """The positions of each orientation's top nodes, as masks."""
    if not max_distance < segments <= BITS:
        raise ValueError("segments must exceed max_distance")
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(runs, segments - max_distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def segments_for(n: int, max_distance: int) -> int:
    """How many segments cost the least for n fingerprints: each orientation holds all of them once, and compares those
    of equal top patterns, of which a tree looks at one in FAN_OUT or so."""
    runs = range(max_distance + 1, min(BITS, 4 * (max_distance + 1)) + 1)
    cost = lambda s: math.comb(s, max_distance) * (1 + n / 2.0 ** (BITS * (s - max_distance) // s) / FAN_OUT)
    return min(runs, key=cost)


def near_links(codes: DataFrame, max_distance: int = 2, segments: int | None = 3, slice_size: int = SLICE) -> DataFrame:
    """Links (a, b) between the distinct values of codes.fp that connect all at most max_distance apart.

    segments: None picks the number by the count of fingerprints, so that buckets stay small however many there are.

    Every bucket (orientation, top pattern) is indexed by itself. A bucket of more than slice_size fingerprints is
    parted by hash into slices; each pair of slices is a task's work of its own, so that one bucket with a third of
    all fingerprints spreads over the cluster, whole. Within a unit of work only a spanning forest is emitted.
    """
    masks = segment_masks(max_distance, segments or segments_for(codes.count(), max_distance))
    spread = codes.select("fp", F.posexplode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("o", "mask"))
    spread = spread.select("fp", F.col("o").cast("int").alias("o"), F.col("fp").bitwiseAND(F.col("mask")).alias("top"))
    sizes = spread.groupBy("o", "top").agg(F.count("*").alias("n")).where("n > 1")
    spread = spread.join(sizes, ["o", "top"])
    slices = F.ceil(F.col("n") / slice_size).cast("int")
    mine = F.pmod(F.xxhash64("fp"), slices).cast("int")
    # A unit (i, j), i <= j, holds slices i and j; the slice i goes to the units (i, *) and (*, i).
    units = (
        spread.withColumn("k", slices).withColumn("s", mine)
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("fp", "o", "top", "s", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"))
    )
    units = units.repartition("o", "top", "i", "j").sortWithinPartitions("o", "top", "i", "j")

    def work(rows: np.ndarray, s: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
        if i == j:
            return forest_links(rows, max_distance)
        return forest_links(rows[s == i], max_distance, rows[s == j]) if (s == i).any() and (s == j).any() else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def full() -> pa.RecordBatch:
            found = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("o", "top", "i", "j", "s", "fp")]))
            rows = np.concatenate(held, axis=1) if held else np.empty((6, 0), dtype=np.int64)
            n = rows.shape[1]
            cuts = np.flatnonzero(np.any(rows[:4, 1:] != rows[:4, :-1], axis=0)) + 1
            bounds = [0, *cuts.tolist(), n] if n else [0]
            if batch is not None:  # the last unit may go on in the next batch
                held = [rows[:, bounds[-2] :]] if n else []
                bounds = bounds[:-1]
            small, pairs = rows[5].view(np.uint64), []
            for a, b in itertools.pairwise(bounds):
                if b - a == 2:  # a tree over two is its two leaves
                    pairs.append(a)
                elif b - a > 2:
                    out.extend(work(small[a:b], rows[4, a:b], int(rows[2, a]), int(rows[3, a])))
            if pairs:
                at = np.array(pairs)
                at = at[np.bitwise_count(small[at] ^ small[at + 1]) <= max_distance]
                out.extend(zip(small[at].tolist(), small[at + 1].tolist()))
            if len(out) > 50_000:
                yield full()
        yield full()

    return units.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, max_distance: int = 2, segments: int | None = None, shingle: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Equal fingerprints are one node of the graph, so exact copies, however many, cost one row in the join.
    Null and empty texts have the zero fingerprint and link like others. Rows with a null doc_id take part (their
    fingerprint can link others), but never name a component; a component of such rows only has a null id.
    Repeated rows come back as often as they went in. Columns other than the key and text are not read.
    """
    key = keys[0]
    fps = materialise(fingerprints(docs, shingle, keys=keys), "simhash-fp")
    nodes = materialise(fps.groupBy("fp").agg(F.min(key).alias("first")), "simhash-nodes")
    links = near_links(nodes.select("fp"), max_distance, segments)
    roots = connected_components(links)
    classes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = classes.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(*keys, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- one document of each group of near copies -----------------------------------------------------------------

_DIGEST = "_simhash_digest"
#: The second fingerprint: bands of smallest hashes of the shingles. Texts with a Jaccard of j share a band with
#: probability 1 - (1 - j ** BAND_ROWS) ** BANDS: all but 3 of a million pairs at 0.8.
BANDS, BAND_ROWS = 24, 4
#: Members of one band, and shingles of these, that meet in one unit of work; a larger band is dealt out in pairs of slices.
PAIR_SLICE, SLICE_SHINGLES = 4096, 1 << 20

_MIX = np.fromiter((xxhash.xxh64_intdigest(b"band %d" % i, SEED) for i in range(2 * BANDS * BAND_ROWS)), dtype=np.uint64).reshape(2, -1, 1)
_XOR, _TIMES = _MIX[0], _MIX[1] | np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Different hashes of a text's shingles of so many words (of all its words, where there are fewer)."""
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=np.int64)
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))), dtype=np.uint64)).view(np.int64)


def bands(hashes: np.ndarray) -> list[int]:
    """The second fingerprint of a set of shingle hashes: a signed number for each band, alike where the set is empty."""
    low = np.full(BANDS * BAND_ROWS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(low, ((hashes[at : at + 4096].view(np.uint64) ^ _XOR) * _TIMES).min(axis=1), out=low)
    return [_signed(xxhash.xxh64_intdigest(low[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes(), i)) for i in range(BANDS)]


def _signatures(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, digest, fp, size (of the shingle set) and bands, a row for each row of docs (doc_id, text, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, found = np.empty(batch.num_rows, dtype=np.uint64), [], []
            for i, t in enumerate(batch.column("_text")):
                text = t.as_py() or b""
                fps[i] = fingerprint(text, shingle)
                hashes = shingle_hashes(text, words)
                sizes.append(len(hashes))
                found.append(bands(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(_DIGEST), pa.array(fps.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", _DIGEST, "fp", "size", "bands"])
        give_back()

    chosen = docs.select("doc_id", _DIGEST, F.col("text").cast("binary").alias("_text"))
    return chosen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_DIGEST} string, fp bigint, size bigint, bands array<bigint>")


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("no"), pa.array(found, pa.list_(pa.int64()))], names=["no", "shingles"])
        give_back()

    return texts.mapInArrow(run, "no bigint, shingles array<bigint>")


def links_within(sets: list[np.ndarray], classes: np.ndarray, similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Places (a, b) of sets with a Jaccard of at least similarity that join different classes, a forest of them.

    Every pair of different classes is compared, as long as they are different: from each set outside the largest class
    to all others at once, so a group that is one class but for a few costs those few passes. side: only pairs with one
    set on either side (False, True) count.
    """
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.empty(0, dtype=np.int64)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    starts = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    marks = np.zeros(len(flat) + 1, dtype=bool)
    forest = _Forest(len(sets))
    first: dict[int, int] = {}
    for i, c in enumerate(classes.tolist()):
        forest.join(first.setdefault(c, i), i)
    root = np.array([forest.find(i) for i in range(len(sets))])
    out = []
    for x in sorted(range(len(sets)), key=lambda i: -int(sizes[i])):
        names, counts = np.unique(root, return_counts=True)
        if len(names) < 2:
            break
        if root[x] == names[np.argmax(counts)]:
            continue
        own = flat[starts[x] : starts[x] + sizes[x]]
        both = np.zeros(len(sets), dtype=np.int64)
        if len(full):
            marks[own] = True
            both[full] = np.add.reduceat(marks[flat].astype(np.int32), starts[full])
            marks[own] = False
        near = (both >= similarity * (sizes + sizes[x] - both)) & (root != root[x])
        if side is not None:
            near &= side != side[x]
        for y in np.flatnonzero(near).tolist():
            if forest.join(x, y):
                out.append((min(x, y), max(x, y)))
        if near.any():
            root = np.array([forest.find(i) for i in range(len(sets))])
    return out


def _apart(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, slice_size: int) -> DataFrame:
    """Verified links (a, b) of members (bucket, no, size, head) of one bucket that no link connects yet; heads have been compared.

    A bucket whose members are connected already is left. The others' members meet with their shingle sets in units of
    work of bounded size: (i, j) compares slice i with slice j, so a bucket with a third of all rows spreads over the
    cluster, whole, and pairs are found in it as they are in small ones.
    """
    own = members.where("no <> head").join(roots.select(F.col("node").alias("no"), "root").hint("merge"), "no", "left").select("bucket", "no", "size", F.coalesce("root", "no").alias("root"))

    counts = own.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.greatest(F.count("*") / slice_size, F.sum("size") / SLICE_SHINGLES)).cast("int").alias("k"))
    own = own.join(counts.where("low <> high").select("bucket", "k").hint("merge"), "bucket")
    units = own.withColumn("s", F.pmod(F.xxhash64("no"), "k").cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    units = units.select("bucket", "no", "root", "s", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j")).join(sets.hint("merge"), "no")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        no, s = rows.column("no").to_numpy(), rows.column("s").to_numpy()
        lists = rows.column("shingles").combine_chunks()
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        found = links_within([values[a:b] for a, b in itertools.pairwise(offsets)], rows.column("root").to_numpy(), similarity, None if i == j else s == j)
        ends = no[np.array(found, dtype=np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(ends.min(axis=1, initial=np.iinfo(np.int64).max)), "b": pa.array(ends.max(axis=1, initial=0))})

    return units.groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def verified_classes(docs: DataFrame, max_distance: int, segments: int | None, shingle: int, words: int, similarity: float, slice_size: int = PAIR_SLICE) -> DataFrame:
    """(digest of the text, doc_id, component_id, stays) of docs (doc_id, text, digest): near copies, checked exactly.

    A row for each different text: doc_id is the smallest of the rows with that text (null where all are null),
    component_id that of its group, stays true for one text of each group, the one with the smallest doc_id (then
    digest). A link counts if the shingle sets of its texts have a Jaccard of at least similarity. Equal texts are one
    node; texts without words are alike. First each text is compared with the head of its fingerprint, heads with those
    that the index links, and each member of a band with the band's head. Then members of a band that these links leave
    apart are compared with each other, so no pair that shares a band is passed over because another one failed.
    """
    return _classes(docs, materialise(_signatures(docs, shingle, words), "simhash-fp"), max_distance, segments, words, similarity, slice_size)


def _classes(docs: DataFrame, fps: DataFrame, max_distance: int, segments: int | None, words: int, similarity: float, slice_size: int = PAIR_SLICE) -> DataFrame:
    nodes = fps.groupBy("fp", F.col(_DIGEST).alias("node")).agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("no", F.monotonically_increasing_id()), "simhash-nodes")
    heads = nodes.groupBy("fp").agg(F.min("no").alias("head"))
    same = nodes.select("fp", "no").join(heads.hint("merge"), "fp").where("no <> head").select(F.col("head").alias("a"), F.col("no").alias("b"))
    near = near_links(heads.select("fp"), max_distance, segments)
    of = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    across = near.join(of("a"), "a").join(of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    rows = nodes.select("no", "size", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("no").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    members = materialise(rows.join(buckets.hint("merge"), "bucket"), "simhash-members")
    shared = members.where("no <> head").select(F.col("head").alias("a"), F.col("no").alias("b"))
    links = same.unionByName(across).unionByName(shared).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialise(links, "simhash-candidates")
    ends = links.select(F.col("a").alias("no")).union(links.select(F.col("b").alias("no"))).distinct().join(nodes, "no").select("no", "node", F.col("first").alias("doc_id"))
    texts = docs.join(ends.hint("shuffle_hash"), (docs["doc_id"].eqNullSafe(ends["doc_id"])) & (docs[_DIGEST] == ends["node"])).select("no", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    sets = materialise(_shingles(texts, words).dropDuplicates(["no"]), "simhash-shingles")
    side = lambda end: sets.select(F.col("no").alias(end), F.col("shingles").alias(f"{end}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    checked = links.join(side("a"), "a").join(side("b"), "b").where(both >= similarity * (F.size("a_set") + F.size("b_set") - both))
    found = materialise(checked.select("a", "b"), "simhash-alike")
    roots = connected_components(found)
    more = materialise(_apart(members, roots, sets, similarity, slice_size), "simhash-alike")
    if not more.isEmpty():
        release(roots)
        roots = connected_components(found.unionByName(more))
    release(members, links, sets)
    classes = nodes.join(roots, nodes["no"] == roots["node"], "left").select(nodes["node"].alias(_DIGEST), F.col("first").alias("doc_id"), F.coalesce("root", "no").alias("_root"))
    best = classes.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _DIGEST)).alias("_best"))
    return classes.join(best.hint("merge"), "_root").select(_DIGEST, "doc_id", F.col("_best.doc_id").alias("component_id"), (F.col(_DIGEST) == F.col(f"_best.{_DIGEST}")).alias("stays"))


def keep_one(docs: DataFrame, max_distance: int = 6, segments: int | None = None, shingle: int = 2, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of near copies, with all its columns: the one with the smallest doc_id.

    Fingerprints of shingles of two words, and bands of the smallest hashes of shingles of five words, propose links;
    shingles of five words confirm them. Rows are told apart by their own text: one with a null doc_id takes part like
    any other and stays only where no row of its group has an id; of different texts with one id in a group that with
    the smaller digest stays; rows that repeat both id and text count once. Null and empty texts, and those of white
    space only, are alike. An empty table gives an empty one.
    """
    digest = free_name(docs.columns, _DIGEST)
    marked = docs.withColumn(digest, F.sha1(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    known = marked.select("doc_id", "text", F.col(digest).alias(_DIGEST))
    fps = materialise(_signatures(known, shingle, words), "simhash-fp")
    classes = _classes(known, fps, max_distance, segments, words, similarity)
    stay = materialise(classes.where("stays").select(F.col("doc_id").alias("_stay"), F.col(_DIGEST).alias("_text")), "simhash-stay")
    kept = marked.join(stay.hint("shuffle_hash"), (marked[digest] == stay["_text"]) & marked["doc_id"].eqNullSafe(stay["_stay"]), "left_semi")
    repeated = not fps.groupBy("doc_id", _DIGEST).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    release(fps)
    if repeated:
        kept = kept.dropDuplicates(["doc_id", digest])
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprints of whole texts of documents, and their groups at two bits or fewer apart. See near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))
