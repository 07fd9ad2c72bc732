"""Benchmark decontamination over a distributed positional inverted index.

The index is made of segments, each over some whole documents. A segment stores, for each of its terms, the ascending
places at which it stands (documents follow each other with a gap, so one number is a document and a position), and
for each document where it starts. Segments are rows of Parquet: a term's postings in blocks of bounded size.

A phrase is sought in a segment from its rarest term: the places of that term, less its offset in the phrase, are the
candidate starts; the lists of the next rarer terms, shifted by their own offsets, are intersected with them until
none is left or every term has agreed, so what remains are exact occurrences.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, give_back, materialise, table

#: Bytes that stand in words: digits, letters (A-Z folded) and all of non-ASCII characters.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or b >= 0x61 and b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WINDOW = 13
#: Words after which a segment is closed, postings in a row, words of queries sought in one pass.
SEGMENT_WORDS, BLOCK_POSTINGS, QUERY_WORDS = 1_000_000, 100_000, 200_000

_INDEX = "segment string, kind string, term binary, n bigint, places binary, doc_id {id}, start bigint, n_words bigint"


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of docs (doc_id, text) as a table in the shared folder: rows of kind 'doc' and 'term'.

    Every row of docs gives a row of kind 'doc' (a null text has no words); repeated ids stay apart. A segment holds
    whole documents and is closed at segment_words words, so its memory is bounded by that and the longest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{TaskContext.get().partitionId():07d}"
        numbers: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        ids: list = []
        starts: list[int] = []
        lengths: list[int] = []
        at, serial = 0, 0
        names = ["segment", "kind", "term", "n", "places", "doc_id", "start", "n_words"]

        def flush(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            segment = f"{name}-{serial:05d}"
            for i in range(0, len(ids), 10_000):
                k = len(ids[i : i + 10_000])
                none = pa.nulls(k, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([segment] * k), pa.array(["doc"] * k), none, pa.nulls(k, pa.int64()), none, pa.array(ids[i : i + 10_000], id_type), pa.array(starts[i : i + 10_000], pa.int64()), pa.array(lengths[i : i + 10_000], pa.int64())], names=names)
            if not numbers:
                return
            terms = np.concatenate(parts)
            places = np.concatenate([np.arange(s, s + n, dtype=np.uint32) for s, n in zip(starts, lengths)])
            order = np.argsort(terms, kind="stable")
            places, counts = places[order], np.bincount(terms, minlength=len(numbers))
            ends = np.cumsum(counts)
            blocks = ((term, min(end, a + BLOCK_POSTINGS) - a, places[a : a + min(end - a, BLOCK_POSTINGS)].tobytes()) for term, end, n in zip(numbers, ends.tolist(), counts.tolist()) for a in range(end - n, end, BLOCK_POSTINGS))
            while rows := list(itertools.islice(blocks, 5_000)):
                t, n, p = zip(*rows)
                k = len(t)
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([segment] * k), pa.array(["term"] * k), pa.array(t, pa.binary()), pa.array(n, pa.int64()), pa.array(p, pa.binary()), pa.nulls(k, id_type), none, none], names=names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = words(text.as_py())
                ids.append(doc_id)
                starts.append(at)
                lengths.append(len(found))
                if found:
                    parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), dtype=np.uint32, count=len(found)))
                at += len(found) + 1
                if at >= segment_words:
                    yield from flush(id_type)
                    numbers, parts, ids, starts, lengths, at, serial = {}, [], [], [], [], 0, serial + 1
        if ids:
            yield from flush(id_type)
        numbers, parts, ids, starts, lengths = {}, [], [], [], []
        give_back()

    schema = _INDEX.format(id=docs.schema["doc_id"].dataType.simpleString())
    return materialise(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema), "postings")


def _shifted(places: np.ndarray, offset: int) -> np.ndarray:
    return places.astype(np.int64) - offset


def _among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a stand in the ascending b."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return b[at] == a


def phrase_starts(postings: dict[bytes, np.ndarray], phrase: list[bytes]) -> np.ndarray:
    """Where a phrase begins in a segment, from the rarest of its terms on."""
    if not phrase or any(w not in postings for w in phrase):
        return np.empty(0, dtype=np.int64)
    order = sorted(range(len(phrase)), key=lambda i: len(postings[phrase[i]]))
    starts = _shifted(postings[phrase[order[0]]], order[0])
    for i in order[1:]:
        starts = starts[_among(starts + i, postings[phrase[i]])]
        if not len(starts):
            break
    return starts


def near_starts(postings: dict[bytes, np.ndarray], terms: list[bytes], slop: int, doc_starts: np.ndarray) -> np.ndarray:
    """Places of the rarest of the terms with each of the others at most slop words away in the same document."""
    terms = list(dict.fromkeys(terms))
    if not terms or any(w not in postings for w in terms):
        return np.empty(0, dtype=np.int64)
    terms.sort(key=lambda w: len(postings[w]))
    places = postings[terms[0]].astype(np.int64)
    own = np.searchsorted(doc_starts, places, side="right")
    for w in terms[1:]:
        other = postings[w].astype(np.int64)
        ok = np.zeros(len(places), dtype=bool)
        for side, step in (("left", -1), ("left", 0)):  # the nearest before, the nearest at or after
            at = np.searchsorted(other, places, side=side) + step
            safe = np.clip(at, 0, len(other) - 1)
            ok |= (at >= 0) & (at < len(other)) & (np.abs(other[safe] - places) <= slop) & (np.searchsorted(doc_starts, other[safe], side="right") == own)
        places, own = places[ok], own[ok]
    return places


def windows_of(item: list[bytes], window: int = WINDOW) -> list[list[bytes]]:
    """All runs of so many consecutive words of an item; the whole of a shorter one; none of one without words."""
    return [item[i : i + window] for i in range(max(1, len(item) - window + 1))] if item else []


def _item_hits(postings: dict[bytes, np.ndarray], item: list[bytes], window: int) -> list[tuple[int, int]]:
    """Merged [start, end) of all occurrences of an item's windows in a segment."""
    k = min(window, len(item))
    found = [s for w in {tuple(x) for x in windows_of(item, window)} if len(s := phrase_starts(postings, list(w)))]
    if not found:
        return []
    starts = np.unique(np.concatenate(found))
    cut = np.flatnonzero(np.diff(starts) > k) + 1
    return [(int(a[0]), int(a[-1]) + k) for a in np.split(starts, cut)]


def _seeker(block: list[tuple[str, list[bytes]]], window: int, slop: int | None):
    """What finds the items of a block in one segment."""

    def seek(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lists: dict[bytes, list[np.ndarray]] = {}
        for term, places in zip(left.column("term").to_pylist(), left.column("places").to_pylist()):
            lists.setdefault(term, []).append(np.frombuffer(places, dtype=np.uint32))
        lists = {t: np.sort(np.concatenate(x)) if len(x) > 1 else x[0] for t, x in lists.items()}
        order = np.argsort(begins := right.column("start").to_numpy())
        begins, ids = begins[order], right.column("doc_id").take(pa.array(order)).combine_chunks()
        rows = []
        for item_id, ws in block:
            if slop is None:
                spans = _item_hits(lists, ws, window)
            else:
                spans = [(x, x + 1) for x in near_starts(lists, ws, slop, begins).tolist()]
            rows += [(item_id, a, b) for a, b in spans]
        where = np.array([r[1] for r in rows], dtype=np.int64)
        doc = np.searchsorted(begins, where, side="right") - 1
        return pa.table({
            "segment": pa.array([key[0].as_py()] * len(rows), pa.string()), "doc_id": ids.take(pa.array(doc)) if len(rows) else ids.slice(0, 0),
            "doc_start": pa.array(begins[doc] if len(rows) else [], pa.int64()), "item_id": pa.array([r[0] for r in rows], pa.string()),
            "start": pa.array(where, pa.int64()), "end": pa.array([r[2] for r in rows], pa.int64()),
        })

    return seek


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Where items (item_id, text) occur: rows (segment, doc_id, doc_start, item_id, start, end), places in the segment.

    slop None: exact occurrences of the items' windows, merged. Else proximity: the rarest of the item's terms with
    all others within slop words; start and end then are that word. Items are taken in passes of QUERY_WORDS words, so
    what a task gets of them is bounded; a pass reads only the postings of its own terms. Items without words, and
    null texts, match nothing.
    """
    spark = index.sparkSession
    sized = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text", F.length("text").alias("n"))
    # Passes by hash, so many that each has about QUERY_WORDS words; a word and its space have two characters at least.
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // (4 * QUERY_WORDS)))
    id_type = index.schema["doc_id"].dataType.simpleString()
    out = None
    for p in range(passes):
        block = [(r.item_id, words(r.text)) for r in sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).toLocalIterator()]
        block = [x for x in block if x[1]]
        terms = sorted({w for _, ws in block for w in ws})
        vocabulary = spark.createDataFrame([(bytearray(w),) for w in terms], "term binary")
        postings = index.where("kind = 'term'").select("segment", "term", "places").join(F.broadcast(vocabulary), "term", "left_semi")
        starts = index.where("kind = 'doc' and n_words > 0").select(F.col("segment").alias("within"), "doc_id", "start")

        schema = f"segment string, doc_id {id_type}, doc_start bigint, item_id string, start bigint, end bigint"
        hits = postings.groupBy("segment").cogroup(starts.groupBy("within")).applyInArrow(_seeker(block, window, slop), schema)
        if passes > 1:  # written at once, so the driver holds one pass's items at a time
            hits = materialise(hits, "occurrences-of-pass")
        out = hits if out is None else out.unionByName(hits)
    return out


def contamination(index: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """A row for each indexed row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, segment, doc_start.

    n_hit counts the words inside any occurrence of a window, each once however many items cover it. contaminated: at
    least one, and at least one in share of all words. Documents without words have zeros and are clean.
    """
    hits = materialise(search(index, items, window), "occurrences")
    before = F.max("end").over(Window.partitionBy("segment", "doc_start").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each merged span of each document, so a document's rows are bounded by its words.
    spans = hits.groupBy("segment", "doc_start", "start").agg(F.max("end").alias("end"))
    covered = spans.withColumn("b", before).groupBy("segment", "doc_start").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("b", "start")))).alias("n_hit"))
    names = hits.groupBy("segment", "doc_start").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    docs = index.where("kind = 'doc'").select("segment", F.col("start").alias("doc_start"), "doc_id", "n_words")
    out = docs.join(covered.join(names, ["segment", "doc_start"]), ["segment", "doc_start"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "segment", "doc_start",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows whose own text is contaminated, whatever their doc_id, null or not, and others with it are."""
    key = free_name(docs.columns, "_text_sha1")
    marked = docs.withColumn(key, F.sha1(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    known = marked.select(F.col(key).alias("doc_id"), "text")
    bad = contamination(build_index(known), items, window).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return marked.join(bad.hint("shuffle_hash"), key, "left_anti").select(*docs.columns)  # keys are hashed, so texts need no sort


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: for every document the words inside passages of the benchmark, and the items. See contamination()."""
    found = contamination(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
win as (
  select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as s
  from b, unnest(range(1, greatest(1, len(w) - 12) + 1)) as t(i) where len(w) > 0),
ks as (select distinct k from win),
pos as (
  select r, i, k, array_to_string(w[i:i + k - 1], ' ') as s
  from d, ks, unnest(range(1, len(w) - k + 2)) as t(i) where len(w) >= k),
hit as (select r, i, pos.k, item_id from pos join win on pos.k = win.k and pos.s = win.s),
covered as (select r, count(distinct j) as n_hit from (select distinct r, i, k from hit), unnest(range(i, i + k)) as t(j) group by r),
named as (select r, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct r, cast(item_id as varchar) as x from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (r) left join named using (r)
"""
