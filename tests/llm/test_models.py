import random
import zlib

from pyspark.sql import functions as F
from tests.llm.helpers import ODD, docs

from corpusloom.llm import langid, toxicity
from corpusloom.llm.common import held_out

SYLLABLES = {"en": ["the", "ing", "and", "wh", "tion"], "de": ["sch", "ung", "ein", "keit", "der"], "fr": ["eau", "oux", "ment", "que", "les"], "es": ["cion", "los", "ado", "que", "ar"]}


def speak(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_fold_is_that_of_crc32(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == out(r.id) for r in rows)


def test_languages_of_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(i, speak(rng, lang), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    model = langid.train(docs(spark, rows))
    assert model.families == ["germanic", "romance"] and ("de", "en") in model.pairs and ("en", "fr") not in model.pairs
    found = langid.identify(docs(spark, rows), model).collect()
    held = [r for r in found if r.held_out]
    truth = {i: lang for i, _, lang in rows}
    assert len(found) == 400 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == out(r.doc_id) for r in found)


def test_language_of_odd_texts(spark):
    rng = random.Random(4)
    model = langid.train(docs(spark, [(i, speak(rng, lang), lang) for i, lang in enumerate("en de fr es".split() * 20)] + [(900, None, "en"), (901, "x", None)]))
    found = langid.identify(docs(spark, ODD), model).collect()
    assert len(found) == len(ODD)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {2, 3, 4, 5}
    assert all(r.held_out is False for r in found if r.doc_id is None)
    nothing = langid.train(docs(spark, []))
    assert {r.lang_pred for r in langid.identify(docs(spark, ODD), nothing).collect()} == {"und"}
    one = langid.train(docs(spark, [(i, speak(rng, "en"), "en") for i in range(9)]))
    assert {r.lang_pred for r in langid.identify(docs(spark, [(1, "the and")]), one).collect()} == {"en"}


def test_toxic_sentences_are_found(spark):
    rng = random.Random(6)
    rows, labels, bad = [], [], ["grob", "fiesling", "mistvieh"]
    for i in range(500):
        parts = [speak(rng, "en", 8) for _ in range(rng.randint(2, 8))]
        toxic = rng.random() < 0.2
        if toxic:
            parts.insert(1, f"the {rng.choice(bad)} and ing.")
        rows.append((i, " ".join(parts)))
        labels.append((i, 1 if toxic else 0))
    table = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs(spark, rows), table)
    found = toxicity.score(docs(spark, rows), model).collect()
    truth = dict(labels)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    text = dict(rows)
    for r in found:
        assert r.predicted == (1 if r.score >= 0.3 else 0) and 0 <= r.score <= 1
        for s in r.offending or []:
            assert any(w in text[r.doc_id][s.start : s.end] for w in bad)
    kept = toxicity.drop_toxic(docs(spark, rows), table)
    assert kept.columns == docs(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.predicted}


def test_noisy_or_is_one_less_the_product(spark):
    model = toxicity.Model({"bad": 3.0, "^fies": 2.0}, -2.0)
    text = "All well. A bad thing, bad! The fiesling\n..."
    p = [model.sentence(text[a:b]) for a, b in toxicity.sentences(text)]
    clean = 1.0
    for x in p:
        clean *= 1 - x
    assert len(p) == 3 and abs(model.document(text) - (1 - clean)) < 1e-12
    assert model.document(None) == model.document("") == model.document("..") == 0


def test_toxicity_of_odd_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs(spark, ODD), empty)
    found = toxicity.score(docs(spark, ODD), model).collect()
    assert len(found) == len(ODD) and all(r.predicted == 0 for r in found)
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_letters_are_those_of_unicode():
    for text in ("½", "²", "Ⅷ", "①", "12 ٣", "", None, "_ -", "🙂"):
        assert not langid.has_letters(text)
    for text in ("a", "12 é", "日", "ªb", "1 ʰ", "ß"):
        assert langid.has_letters(text)


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(9)
    names = [f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    sounds = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for x in names}
    rows = [(i, " ".join(rng.choice(sounds[x]) for _ in range(40)), x) for i, x in enumerate(names * 12)]
    monkeypatch.setattr(langid, "TRAIN_ALL", 70 * 8)
    model = langid.train(docs(spark, rows))
    assert model.langs == sorted(names)
    found = langid.identify(docs(spark, rows), model).collect()
    held = [r for r in found if r.held_out]
    truth = {i: x for i, _, x in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
