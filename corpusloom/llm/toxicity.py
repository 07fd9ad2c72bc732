"""Toxicity by multiple-instance learning.

Only documents are labelled, sentences are what is scored: a sentence's score is a logistic function of its words, a
document's is the noisy-or of its sentences (it is clean only if each of them is). The weights are learned from
document labels through the noisy-or, so they settle on the sentences that explain a label, which are then located.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import give_back, held_out, table

#: Score from which a document is called toxic, and a sentence offending.
THRESHOLD = 0.3
#: Toxic and clean documents to learn from at most, their longest text in characters, and features with a weight at most.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS, MAX_FEATURES = 2000, 3000, 50_000, 2000
#: Weights below this are left out of the model.
LEAST_WEIGHT = 0.05
#: Chi-squared of a feature and the label (one degree of freedom) from which it is used.
CHI2 = 11.0

_SENTENCE = re.compile(r"[^.!?\n…。！？]+[.!?…。！？]*")
# For scoring: the end of a sentence becomes a word of its own, all else of ASCII but letters and digits a space.
_END = " \n "
_TABLE = {i: (_END if chr(i) in ".!?\n" else chr(i) if chr(i).isalnum() else " ") for i in range(128)} | {ord(c): _END for c in "…。！？"}
_TABLE |= {i: chr(i + 32) for i in range(65, 91)}
_TABLE |= {i: " " for i in (0x2018, 0x2019, 0x201C, 0x201D, 0xAB, 0xBB, 0xBF, 0xA1)}


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans (start, end) of a text's sentences that have a word."""
    return [m.span() for m in _SENTENCE.finditer(text) if any(map(str.isalnum, m.group()))]


def words(text: str) -> list[str]:
    """A sentence's words in lower case; signs of ASCII part them."""
    return text.translate(_TABLE).lower().split()


def traits(word: str) -> list[str]:
    """A word's features: itself, and each stem (its first 4 to 8 characters) that it goes on from."""
    return [word, *(f"^{word[:k]}" for k in range(4, min(9, len(word))))]


class Model:
    """Weights of words' features and a bias; a sentence has the sum over its different words."""

    #: Words whose weights are remembered at most; beyond that the memory starts anew.
    REMEMBERED = 200_000

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "words": {}}

    def _learn(self, every: set[str]) -> None:
        if len(self.words) > self.REMEMBERED:
            self.words.clear()
        get, known = self.weights.get, self.words
        for w in every:
            if w not in known:
                known[w] = sum(get(f, 0.0) for f in traits(w))

    def _sums(self, lines: list[list[str]]) -> tuple[list[float], int]:
        """The words' sums of lines with a weighted word, and how many others have words."""
        every = {w for ws in lines for w in ws}
        self._learn(every)
        hot = {w: x for w in every if (x := self.words[w])}
        out, others = [], 0
        for ws in lines:
            if ws:
                if known := hot.keys() & ws:
                    out.append(sum(hot[w] for w in sorted(known)))
                else:
                    others += 1
        return out, others

    def sentence(self, text: str) -> float:
        sums, _ = self._sums([words(text)])
        return float(_sigmoid(np.float64(self.bias + sum(sums))))

    def document(self, text: str | None) -> float:
        """The noisy-or over a whole text's sentences; 0 where it has none."""
        lines = [x.split() for x in (text or "").translate(_TABLE).lower().split("\n")]
        sums, others = self._sums(lines)
        clean = others * np.logaddexp(0, self.bias) + np.logaddexp(0, self.bias + np.array(sums)).sum()
        return float(-np.expm1(-clean))

    def offending(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        return [(a, b, p) for a, b in sentences(text or "") if (p := self.sentence(text[a:b])) >= threshold]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray | None = None, steps: int = 300, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Learn word weights from documents, their labels (0, 1) and how many documents each stands for."""
    n, positive = len(texts), labels == 1
    if not positive.any() or positive.all():
        return Model({}, -30.0 if not positive.any() else 30.0)
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    vocabulary: dict[str, int] = {}
    split: list[list[np.ndarray]] = []
    for t in texts:
        own = [{vocabulary.setdefault(w, len(vocabulary)) for w in words(t[a:b])} for a, b in sentences(t)]
        split.append([np.fromiter(x, dtype=np.int32, count=len(x)) for x in own])
    # Features are told apart by a 32-bit hash, so that the driver holds numbers and no string for each stem.
    lengths = np.fromiter((len(traits(w)) for w in vocabulary), dtype=np.int64, count=len(vocabulary))
    hashes = np.fromiter((zlib.crc32(f.encode()) for w in vocabulary for f in traits(w)), dtype=np.uint32, count=int(lengths.sum()))
    values, dense = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(lengths)
    of = lambda w: dense[ends[w] - lengths[w] : ends[w]]
    both, either = np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=np.int64)
    for own, y in zip(split, positive.tolist()):
        if own:
            seen = np.unique(np.concatenate([of(w) for w in np.unique(np.concatenate(own)).tolist()]))
            either[seen] += 1
            both[seen] += y
    n1 = int(positive.sum())
    det = (both * (n - n1 - (either - both)) - (n1 - both) * (either - both)).astype(float)
    chi2 = n * det * det / np.maximum(either * (n - either) * float(n1) * (n - n1), 1e-9)
    good = np.flatnonzero((either >= 3) & (either < n) & (chi2 >= CHI2))
    good = sorted(good.tolist(), key=lambda i: (-chi2[i], int(values[i])))[:MAX_FEATURES]
    number = np.full(len(values), -1)
    number[good] = np.arange(len(good))
    kept = number[dense]
    # Sentences without a known word behave alike: they are counted, not listed.
    sent_doc, pair_sent, pair_word = [], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    flat = np.zeros(n)
    for d, own in enumerate(split):
        for s in own:
            known = np.concatenate([kept[ends[w] - lengths[w] : ends[w]] for w in s.tolist()]) if len(s) else s
            known = known[known >= 0]
            if not len(known):
                flat[d] += 1
                continue
            pair_sent.append(np.full(len(known), len(sent_doc)))
            pair_word.append(known)
            sent_doc.append(d)
    sent_doc, pair_sent, pair_word = np.array(sent_doc, dtype=np.int64), np.concatenate(pair_sent), np.concatenate(pair_word)
    number = {f: int(kept[ends[i] - lengths[i] + j]) for i, w in enumerate(vocabulary) for j, f in enumerate(traits(w)) if kept[ends[i] - lengths[i] + j] >= 0}
    theta = np.zeros(len(number) + 1)
    theta[-1] = np.log(max(1e-4, weight[positive].sum()) / max(1.0, np.mean([len(x) for x in split]))) - 1
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        s = np.bincount(pair_sent, weights=theta[pair_word], minlength=len(sent_doc)) + theta[-1]
        p, p0 = _sigmoid(s), _sigmoid(theta[-1])
        clean = np.bincount(sent_doc, weights=-np.logaddexp(0, s), minlength=n) - flat * np.logaddexp(0, theta[-1])
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        pull = np.where(positive, -np.exp(clean) / toxic, 1.0) * weight  # times a sentence's score: the loss's slope in its sum
        per = pull[sent_doc] * p
        grad = np.append(np.bincount(pair_word, weights=per[pair_sent], minlength=len(number)), per.sum() + (pull * flat).sum() * p0)
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return Model({f: float(theta[i]) for f, i in number.items() if abs(theta[i]) >= LEAST_WEIGHT}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Model:
    """Learn from labelled rows outside the held-out fold: about so many toxic and clean ones, by a hash of doc_id.

    Each sampled row stands for as many as its class has to one sampled, so scores keep the share of toxic rows.
    Rows with a null label or text, and texts over TRAIN_CHARS, are not learned from; of a document labelled more than
    once the largest label counts. Twice the sample is never exceeded, whatever repeats.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, most / max(n.get(y, 0), 1)) for y, most in ((True, toxic), (False, clean))}
    below = F.when(F.col("toxic"), F.lit(share[True])).otherwise(F.lit(share[False])) * (1 << 30)
    sample = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) < below)
    texts = docs.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text")
    sample = sample.limit(2 * (toxic + clean))  # so it is small enough to be sent to all tasks: texts are not moved
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").limit(2 * (toxic + clean)).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    labels_of = np.array(rows.column("toxic").to_pylist(), dtype=bool)
    texts_of = rows.column("text").to_pylist()
    del rows
    model = fit(texts_of, labels_of.astype(np.int64), np.where(labels_of, 1 / share[True], 1 / share[False]))
    del texts_of
    give_back()
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, held_out, score, predicted, offending.

    offending: (start, end, score) of the sentences that score threshold or more, for documents predicted toxic.
    Only the text is looked at. Null and empty texts score 0. A null doc_id is in no fold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, where = [], []
            for text in batch.column("text"):
                p = sent.value.document(t := text.as_py())
                scores.append(p)
                where.append([dict(zip(("start", "end", "score"), x)) for x in sent.value.offending(t)] if p >= threshold else [])
            s = np.array(scores, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(where, spans)], names=["doc_id", "held_out", "score", "predicted", "offending"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return chosen.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is predicted toxic, columns as they were."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [sent.value.document(t.as_py()) < THRESHOLD for t in batch.column("text")]
            yield batch.filter(pa.array(ok, pa.bool_()))
        give_back()

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: a toxicity score of every document, learned outside the held-out fold. See train() and score()."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
