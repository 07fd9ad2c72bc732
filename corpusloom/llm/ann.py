"""Approximate nearest neighbours by cosine, with randomly rotated one-bit codes.

A vector is scaled to length one, rotated (rounds of random signs and a Hadamard transform, from a seed), and each
coordinate is kept as its sign: 64 coordinates to an unsigned word. Beside the code stands one scalar, the inner
product of the rotated vector and its code's unit vector. From the packed bits and that scalar comes an unbiased
estimate of the cosine with a rotated query, and a bound on its error that holds with high probability.

Before the codes stands an inverted file: rows and queries are dealt to lists of the nearest of some centroids, learned
from a bounded sample. How many lists a query has to look at is measured on the sample, and where lists would save
little (vectors without any structure), there is one list. A list is cut into slices and its queries into blocks of bounded
size; each pair of a slice and a block is a task's work of its own. It estimates every pair, reranks those with the best
estimates exactly, and then all whose estimate plus error bound reaches the worst of the neighbours found so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, table

SEED = 7
ROUNDS = 3
#: Bits to which a query's coordinates are quantised, and deviations of the estimate that the error bound covers.
QUERY_BITS, EPSILON = 6, 3.0
#: Bytes of vectors (as doubles) in a slice of a list, and of queries in a block, at most.
SLICE_BYTES, PASS_BYTES = 32 << 20, 8 << 20
#: Rows of which a slice is never cut further to busy more tasks; estimates that a task holds at once.
SLICE_ROWS, ESTIMATES = 8192, 4 << 20
#: Best estimates that are reranked before the error bound is applied; room for rounding in single precision.
PROBED, ROOM = 64, np.float32(1e-5)
#: The bounded sample that centroids and the number of lists to look at are learned from: rows and bytes at most.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
#: Lists at most. Part of a sampled query's neighbours whose lists it has to look at. Part of all rows beyond which lists don't pay.
MAX_LISTS, LIST_RECALL, MOST_READ = 4096, 0.98, 0.3
#: Rows from which lists are tried.
LEAST_ROWS = 4096


def padded(dim: int) -> int:
    return max(64, 1 << (dim - 1).bit_length())


def rotate(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows of x, padded with zeros to a power of two and rotated; lengths and inner products stay."""
    n, dim = x.shape
    size = padded(dim)
    out = np.zeros((n, size))
    out[:, :dim] = x
    rng = np.random.default_rng([seed, size])
    for _ in range(ROUNDS):
        out *= rng.integers(0, 2, size) * 2.0 - 1.0
        step = 1
        while step < size:
            pairs = out.reshape(n, size // (2 * step), 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
            step *= 2
        out /= np.sqrt(size)
    return out


def encode(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Of unit rows: codes (n, words) and the inner product of each rotated row with its code's unit vector."""
    turned = rotate(unit, seed)
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
    return codes, np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def estimate(codes: np.ndarray, ones: np.ndarray, scalar: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimated cosines of the coded vectors with a rotated unit query, or (codes, queries) with one a row.

    ones: how many bits of a code are set. A query is quantised to low + step * integer; the sum of its integers over a
    code's set bits is exact in single precision. A bit stands for plus or minus one, so the inner product with a code
    is twice the query's sum over its set bits less the sum over all.
    """
    bits = np.unpackbits(codes.view(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little").astype(np.float32)
    q = np.atleast_2d(turned)
    low, high = q.min(1), q.max(1)
    step = (high - low) / (2**QUERY_BITS - 1)
    step[step == 0] = 1.0
    ints = np.rint((q - low[:, None]) / step[:, None]).astype(np.float32)
    guess = bits @ ints.T * (2 * step).astype(np.float32)
    guess += np.outer(ones.astype(np.float32), (2 * low).astype(np.float32)) - q.sum(1).astype(np.float32)
    guess /= (np.sqrt(q.shape[1]) * scalar).astype(np.float32)[:, None]
    return guess[:, 0] if turned.ndim == 1 else guess


def error_bound(scalar: np.ndarray, size: int) -> np.ndarray:
    """What the error of an estimate stays within, EPSILON deviations, for codes of so many bits."""
    return np.sqrt(np.maximum(0, 1 - scalar**2)) / scalar * (EPSILON / np.sqrt(size - 1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of x times powers of two, the largest component of each below one: no square overflows, no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    y = scaled(x)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows of x with q (a row each, or one) in double precision, the same for a pair wherever it stands."""
    x, q = scaled(np.atleast_2d(x)), scaled(np.atleast_2d(q))
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have dim values, as rows of doubles."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of rows that take part: an id, a vector that is not zero, all components finite."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if kind in ("float", "double") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))


class Index(NamedTuple):
    """codes: (dim, vector, ids, code, scalar) of every different usable vector. rows: (vec_id, vector) of all usable rows."""

    codes: DataFrame
    rows: DataFrame


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> Index:
    """The index of a table of vectors, for searches of up to k neighbours; its codes are a table in the shared folder.

    Equal vectors are one row with its smallest ids, as many different ones as a search for k neighbours can need, and how often
    each occurs; so a vector that a third of all rows repeat is one. Null vectors, zero ones, those with a null or
    non-finite component and rows without an id have no part.
    """
    usable = _usable(vectors, key, vector)
    counted = usable.groupBy("vector", "vec_id").agg(F.count("*").alias("n"))
    first = counted.withColumn("_at", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_at") <= k + 1)
    rows = first.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k + 1)).cast("int").alias("n")))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                own = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                codes, scalar = encode(unit(_matrix(own.column("vector"), dim)))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), dim, dtype=np.int32)), own.column("vector"), own.column("ids"), packed, pa.array(scalar)], names=["dim", "vector", "ids", "code", "scalar"])

    kinds = dict(rows.dtypes)
    return Index(materialise(rows.mapInArrow(run, f"dim int, vector {kinds['vector']}, ids {kinds['ids']}, code binary, scalar double"), "ann-codes"), usable)


class Lists:
    """Centroids of one dimension's vectors, and how many of the nearest a query looks at. One list if there is no use in more."""

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, probes

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, of which the first is its own."""
        if len(self.centroids) < 2:
            return np.zeros((len(x), 1), dtype=np.int32)
        out = []
        for i in range(0, len(x), 1024):
            near = unit(x[i : i + 1024]) @ self.centroids.T
            some = np.argpartition(-near, n - 1, axis=1)[:, :n]
            order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
            out.append(np.take_along_axis(some, order, 1).astype(np.int32))
        return np.concatenate(out)


def learn_lists(sample: np.ndarray, rows: int, k: int = 5, steps: int = 8) -> Lists:
    """Lists for so many rows from a sample of their vectors: spherical k-means, then the probes that find the neighbours.

    A part of the sample are queries against the rest; a neighbour counts as found if the query looks at its list.
    Neighbours within a sample are farther than within all rows, so the number errs to the safe side.
    """
    one = Lists(np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1)), 1)
    wanted = min(MAX_LISTS, math.isqrt(rows), len(sample) // 16)
    if rows < LEAST_ROWS or wanted < 8:
        return one
    rng = np.random.default_rng(SEED)
    x = unit(sample)[rng.permutation(len(sample))]
    q, x = x[: max(64, len(x) // 64)], x[max(64, len(x) // 64) :]
    centroids = x[:wanted].copy()
    nearest = lambda: np.concatenate([np.argmax(x[i : i + 1024] @ centroids.T, axis=1) for i in range(0, len(x), 1024)])
    for _ in range(steps):
        own = nearest()
        order = np.argsort(own, kind="stable")
        used, starts = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        long = np.sqrt((sums * sums).sum(1))
        ok = long > 0
        centroids[used[ok]] = sums[ok] / long[ok, None]
    own = nearest()
    near = np.argpartition(-(q @ x.T), k, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)  # of each list in each query's order
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    probes = int(needed[min(len(needed) - 1, math.ceil(LIST_RECALL * len(needed)) - 1)]) + 1
    return one if probes > MOST_READ * wanted else Lists(centroids, probes)


def _lists_of(codes: DataFrame, k: int) -> dict[int, Lists]:
    """The lists of each dimension. Driver memory: one bounded sample at a time."""
    out = {}
    for r in codes.groupBy("dim").count().collect():  # a row a dimension
        most = max(16, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * r.dim)))
        found = np.zeros((0, r.dim))
        if r["count"] >= LEAST_ROWS:
            part = min(1.0, 1.1 * most / r["count"])
            sample = codes.where((F.col("dim") == r.dim) & (F.pmod(F.xxhash64(F.lit("ann"), "vector"), F.lit(1 << 30)) < part * (1 << 30)))
            found = _matrix(sample.select("vector").limit(most).toArrow().column("vector").combine_chunks(), r.dim)
        out[r.dim] = learn_lists(found, r["count"], k)
    return out


def _dealt(rows: DataFrame, lists: dict[int, Lists], probing: bool) -> DataFrame:
    """rows (dim, vector, ...) with list: the nearest one, or a row for each that a query looks at."""
    sent = rows.sparkSession.sparkContext.broadcast(lists)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                at = sent.value[dim].nearest(_matrix(own.column("vector"), dim), sent.value[dim].probes if probing else 1)
                wide = own.take(pa.array(np.repeat(np.arange(len(at)), at.shape[1])))
                yield pa.RecordBatch.from_arrays([*wide.columns, pa.array(at.ravel())], names=[*names, "list"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", list int"
    return rows.mapInArrow(run, schema)


def _compare(k: int):
    """What finds the k nearest rows of a slice for each query of a block."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        cols: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            given, asked = _matrix(left.column("vector").combine_chunks(), dim), _matrix(right.column("vector").combine_chunks(), dim)
            x, q = scaled(given), scaled(asked)
            x_long, q_long = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), dtype="<u8").reshape(len(x), -1)
            scalar = left.column("scalar").to_numpy()
            bound = error_bound(scalar, codes.shape[1] * 64).astype(np.float32)
            turned, ones = rotate(q / q_long[:, None]), np.bitwise_count(codes).sum(1)
            first = left.column("ids").combine_chunks()
            first = first.values.field("vec_id").to_numpy()[first.offsets.to_numpy()[:-1]]
            most = min(k + 1, len(x))  # one of them may be the query's own row
            some = min(max(PROBED, most), len(x))
            # Reranking sifts in single precision, with room for its error; what is left is scored in double precision.
            near, to = (x / x_long[:, None]).astype(np.float32), (q / q_long[:, None]).astype(np.float32)
            step = max(1, ESTIMATES // len(x))
            for a in range(0, len(q), step):
                guess = np.ascontiguousarray(estimate(codes, ones, scalar, turned[a : a + step]).T)
                for j, own in enumerate(guess, a):
                    best = np.argpartition(own, len(own) - some)[len(own) - some :]
                    worst = np.partition(near[best] @ to[j], some - most)[some - most]
                    rows = np.union1d(np.flatnonzero(own + bound >= worst - ROOM), best)
                    cosines = near[rows] @ to[j]
                    rows = rows[cosines >= np.partition(cosines, len(rows) - most)[len(rows) - most] - ROOM]
                    score = (x[rows] * q[j]).sum(1) / (x_long[rows] * q_long[j])
                    order = np.lexsort((first[rows], -score))[:most]
                    cols[0].append(np.full(len(order), j))
                    cols[1].append(rows[order])
                    cols[2].append(score[order])
                    cols[3].append((given[rows[order]] == asked[j]).all(1))
        queries, rows, score, same = (np.concatenate(c) if c else np.empty(0, dtype=t) for c, t in zip(cols, (np.int64, np.int64, np.float64, bool)))
        of = right.select(["query", "query_id", "times"]).take(pa.array(queries))
        return pa.table({**{c: of.column(c) for c in of.column_names}, "ids": left.column("ids").take(pa.array(rows)), "same": pa.array(same), "score": pa.array(score)})

    return run


def search(index: Index, is_query, k: int = 5) -> DataFrame:
    """For each indexed row that is_query (a Column over vec_id) marks, its k nearest: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller vec_id. Every row is a candidate of its own, so an id that comes twice can be
    given twice; only the query's own row is none, so others with its id are. Vectors of another dimension are no neighbours. Fewer
    than k where there are fewer candidates. An id that comes in several rows asks once for each, and has k rows for each.
    Queries are all indexed rows marked, joined to the rows in blocks on the executors; an empty index gives no rows.
    index: build_index() for at least k.
    """
    lists = _lists_of(index.codes, k)
    asked = index.rows.where(is_query).groupBy(F.col("vec_id").alias("query_id"), "vector").agg(F.count("*").alias("times"))
    asked = materialise(asked.select("query_id", F.size("vector").alias("dim"), "vector", "times", F.monotonically_increasing_id().alias("query")), "ann-asked")
    queries = materialise(_dealt(asked, lists, True), "ann-queries")
    if any(len(x.centroids) > 1 for x in lists.values()):
        rows = materialise(_dealt(index.codes, lists, False), "ann-lists")
    else:
        rows = index.codes.withColumn("list", F.lit(0))
    # Slices and blocks of each list. Few rows are still cut into as many slices as there are cores, if these are not too small.
    cores = index.codes.sparkSession.sparkContext.defaultParallelism
    wide = lambda at_most: F.ceil(F.count("*") * F.col("dim") * 8 / at_most)
    slices = rows.groupBy("dim", "list").agg(F.greatest(wide(SLICE_BYTES), F.least(F.lit(cores), F.ceil(F.count("*") / SLICE_ROWS))).cast("int").alias("_s"))
    blocks = queries.groupBy("dim", "list").agg(wide(PASS_BYTES).cast("int").alias("_b"))
    plan = F.broadcast(materialise(slices.join(blocks, ["dim", "list"]), "ann-plan"))  # MAX_LISTS rows a dimension at most
    part = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(plan, ["dim", "list"]).withColumn("slice", part("vector", F.col("_s"))).withColumn("block", upto("_b")).select("dim", "list", "slice", "block", "vector", "ids", "code", "scalar")
    right = queries.join(plan, ["dim", "list"]).withColumn("block", part("query", F.col("_b"))).withColumn("slice", upto("_s")).select("dim", "list", "slice", "block", "query", "query_id", "times", "vector")
    unit_ = ["dim", "list", "slice", "block"]
    kind = dict(index.codes.dtypes)["ids"]
    found = left.groupBy(*unit_).cogroup(right.groupBy(*unit_)).applyInArrow(_compare(k), f"query bigint, query_id bigint, times bigint, ids {kind}, same boolean, score double")
    one = found.select("query", "query_id", "times", "same", "score", F.explode("ids").alias("_i"))
    left_of = (F.col("_i.n") - (F.col("same") & (F.col("_i.vec_id") == F.col("query_id"))).cast("int")).cast("int")
    one = one.select("query", "query_id", "times", F.explode(F.array_repeat(F.col("_i.vec_id"), left_of)).alias("vec_id"), "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the five nearest of all embeddings for each whose vec_id is divisible by 50. See search()."""
    return search(build_index(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
