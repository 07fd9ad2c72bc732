"""Language identification by hierarchical discrimination.

A text's features are the relative frequencies of its byte trigrams, hashed. A first set of linear classifiers tells
language families apart; within a family, one-versus-one linear support vector machines tell closely related
languages apart, and the language with most wins (then the largest sum of margins) is predicted.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, table

#: Hashed features (2 ** FEATURE_BITS); texts to learn from at most: of each language, and of all together (many languages
#: have fewer each, but LEAST_TEXTS of every one).
FEATURE_BITS, TRAIN_TEXTS, TRAIN_ALL, LEAST_TEXTS = 14, 400, 12_800, 8
UNKNOWN = "und"

#: Families of ISO 639-1 codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

# Everything of ASCII but letters becomes a space; upper case is folded before, for all scripts.
_TO_SPACE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_LETTER = re.compile("[A-Za-z]")


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), f"only-{lang}")


def has_letters(text: str | None) -> bool:
    """Whether a text has a character of Unicode's letter categories; numbers that look like letters are none."""
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """The hashed trigram at each place of a text, runs of other characters counting as one space."""
    raw = b" " + b" ".join(text.lower().encode().translate(_TO_SPACE).split()) + b" "
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, dtype=np.uint32)
    mixed = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1)
    return mixed >> np.uint32(32 - FEATURE_BITS)


class Rows(NamedTuple):
    """Sparse rows: each row's feature numbers and values, one row after the other, and where each starts (and the last ends)."""

    ids: np.ndarray
    values: np.ndarray
    at: np.ndarray

    def pick(self, which: np.ndarray) -> Rows:
        n = np.diff(self.at)[which]
        own = np.repeat(self.at[:-1][which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return Rows(self.ids[own], self.values[own], np.append(0, np.cumsum(n)))

    def times(self, w: np.ndarray) -> np.ndarray:
        """Each row's inner product with w, whose last number is the bias. Every row has a feature."""
        return np.add.reduceat(self.values * w[self.ids], self.at[:-1]) + w[-1]

    def back(self, u: np.ndarray, size: int) -> np.ndarray:
        """The sum of the rows, each times its number in u, the sum of u for the bias."""
        return np.append(np.bincount(self.ids, weights=self.values * np.repeat(u, np.diff(self.at)), minlength=size), u.sum())


def train_svm(x: Rows, y: np.ndarray, c: float = 10.0, steps: int = 120, size: int = 1 << FEATURE_BITS) -> np.ndarray:
    """Weights (the bias last) of a linear SVM with squared hinge loss, classes weighted alike; y is -1 or 1."""
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    v = np.ones(size + 1)
    for _ in range(8):  # the largest curvature, by power iteration
        v = x.back(cost * x.times(v), size)
        top = np.linalg.norm(v)
        v /= top or 1
    rate = 1 / (1 + 2 * 1.1 * top)
    w = z = np.zeros(size + 1)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * x.times(z))
        new = z - rate * (z - 2 * x.back(cost * y * slack, size))
        z = new + t / (t + 3) * (new - w)
        w = new
    return w.astype(np.float32)


class Model:
    """Families' classifiers and, within families, those of pairs of languages, as columns of one weight matrix."""

    def __init__(self, x: Rows, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        own = np.array(langs)
        fam = np.array([family(x) for x in langs])
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        self.scale = 1.0
        if langs:
            self.scale = 1 / max(1e-9, float(np.median(np.sqrt(np.add.reduceat(x.values * x.values, x.at[:-1])))))
        x = x._replace(values=x.values * self.scale)
        columns = []
        for f in self.families if len(self.families) > 1 else []:
            columns.append(train_svm(x, np.where(fam == f, 1, -1)))
        self.pairs: list[tuple[str, str]] = []
        for f in self.families:
            for a, b in itertools.combinations(self.members[f], 2):
                at = np.flatnonzero((own == a) | (own == b))
                columns.append(train_svm(x.pick(at), np.where(own[at] == a, 1, -1)))
                self.pairs.append((a, b))
        self.weights = np.stack(columns, axis=1) if columns else np.zeros(((1 << FEATURE_BITS) + 1, 0), dtype=np.float32)
        self.columns = np.ascontiguousarray(self.weights[:-1].T)

    def predict(self, text: str | None) -> tuple[str, float, str]:
        """(language, score, family) of a whole text; und, 0 and und where it has no letters or nothing was learned."""
        if not self.langs or not has_letters(text):
            return UNKNOWN, 0.0, UNKNOWN
        found = features(text)
        if len(found) > 1 << FEATURE_BITS:
            margins = self.columns @ np.bincount(found, minlength=1 << FEATURE_BITS).astype(np.float32)
        else:
            margins = np.array([c.take(found).sum(dtype=np.float64) for c in self.columns])
        margins = (margins * (self.scale / max(1, len(found))) + self.weights[-1]).astype(np.float64)
        confidence, best = 1.0, 0
        if len(self.families) > 1:
            of_family = margins[: len(self.families)]
            best = int(np.argmax(of_family))
            confidence = _sigmoid(of_family[best] - np.delete(of_family, best).max())
        fam = self.families[best]
        shift = len(self.families) if len(self.families) > 1 else 0
        wins = {x: [0, 0.0, np.inf] for x in self.members[fam]}
        for i, (a, b) in enumerate(self.pairs):
            if a in wins:
                m = margins[shift + i]
                for x, own in ((a, m), (b, -m)):
                    wins[x][0] += own > 0
                    wins[x][1] += own
                    wins[x][2] = min(wins[x][2], own)
        lang = max(wins, key=lambda x: (wins[x][0], wins[x][1]))
        if len(wins) > 1:
            confidence *= _sigmoid(2 * wins[lang][2])
        return lang, float(min(1.0, confidence)), fam


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * x, -500, 500))))


def train(docs: DataFrame, per_lang: int = TRAIN_TEXTS) -> Model:
    """Learn from (doc_id, text, lang) rows outside the held-out fold with a lang and letters.

    A bounded sample is enough for the margins: about per_lang texts of each language, by a hash of doc_id, fewer where
    all languages together would have more than TRAIN_ALL. Every language with a label is learned. Each text counts whole.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return Model(Rows(np.empty(0, dtype=np.int32), np.empty(0), np.zeros(1, dtype=np.int64)), [])
    per_lang = min(per_lang, max(LEAST_TEXTS, TRAIN_ALL // len(counts)))
    share = F.create_map(*itertools.chain.from_iterable((F.lit(r["lang"]), F.lit(per_lang / r["count"])) for r in counts))
    picked = rows.where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ids, values = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if has_letters(t := text.as_py()) and len(own := features(t)):
                    f, n = np.unique(own, return_counts=True)
                    langs.append(lang)
                    ids.append(f.astype(np.int32))
                    values.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "ids", "values"])

    found = picked.select("lang", "text").mapInArrow(count, "lang string, ids array<int>, values array<float>").limit(2 * per_lang * len(counts)).toArrow()
    lists = found.column("ids").combine_chunks()
    values = found.column("values").combine_chunks().values.to_numpy().astype(np.float64)
    return Model(Rows(lists.values.to_numpy(), values, lists.offsets.to_numpy().astype(np.int64)), found.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, held_out, lang_pred, score, family_pred.

    Only the text is looked at. Null, empty and letterless texts are und with score 0. A null doc_id is in no fold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column("text")]
            lang, score, fam = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fam, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "family_pred"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return chosen.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, family_pred string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the language of every document, learned outside the held-out fold. See train() and identify()."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
