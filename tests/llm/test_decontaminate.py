import random
import re

from tests.llm.helpers import ODD, docs

from corpusloom.llm import decontaminate as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    ws, hit, named = plain_words(text), set(), set()
    for item, t in items:
        it = plain_words(t)
        for w in [it[i : i + 13] for i in range(max(1, len(it) - 12))] if it else []:
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    named.add(str(item))
    return len(ws), len(hit), len(named), len(hit) > 0 and 20 * len(hit) >= len(ws)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünter", "x1", "b", "cat", "dog", "漢字"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!", "'s"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 5, 13, 14, 30]))) for i in range(12)] + [(99, None), (98, ""), (97, "..")]
    texts = [text(rng.randint(0, 40)) for _ in range(20)]
    texts += [text(5) + " " + rng.choice(items)[1] + " " + text(rng.choice([5, 500])) if rng.random() < 2 else "" for _ in range(20) if items]
    return [(i, t) for i, t in enumerate(texts)], [x for x in items]


def test_same_as_scanning_each_text(spark, monkeypatch):
    rows, items = case(2)
    rows += [(i + 100 if i is not None else None, t) for i, t in ODD if i != 6]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for words in (m.SEGMENT_WORDS, 100):  # one segment a task, and many
        found = m.contamination(m.build_index(docs(spark, rows), words), table).collect()
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found)
        assert got == sorted((str(i), *plain(t, items)) for i, t in rows)
    monkeypatch.setattr(m, "QUERY_WORDS", 20)  # items in many passes
    again = m.contamination(m.build_index(docs(spark, rows)), table).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in again) == got
    assert {r.items_sha256 for r in again} == {r.items_sha256 for r in found}


def test_long_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "long long long")], "item_id bigint, text string")
    (row,) = m.contamination(m.build_index(docs(spark, [(6, "long " * 50_000)])), items).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (50_000, 50_000, True)
    assert m.contamination(m.build_index(docs(spark, [])), items).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.contaminated for r in m.contamination(m.build_index(docs(spark, [(1, "a b")])), none).collect()] == [False]


def test_proximity_stays_in_a_document(spark):
    rows = [(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "alpha"), (4, "beta alpha")]
    index = m.build_index(docs(spark, rows))
    items = spark.createDataFrame([(1, "beta alpha")], "item_id bigint, text string")
    assert sorted({r.doc_id for r in m.search(index, items, slop=3).collect()}) == [1, 4]


def test_contaminated_rows_go(spark):
    rows = [(1, "one two three"), (2, "four"), (None, "one two three"), (3, None)]
    items = spark.createDataFrame([(1, "One, two")], "item_id bigint, text string")
    kept = m.drop_contaminated(docs(spark, rows), items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_rows_are_judged_by_their_own_text(spark):
    item = " ".join(f"bench{i}" for i in range(20))
    rows = [(3, item), (None, item), (None, f"{item} {item}"), (3, "a clean text under the same id"), (None, "clean too"), (4, None), (5, f"before {item} after"), (6, item)]
    kept = m.drop_contaminated(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "a clean text under the same id"), (None, "clean too"), (4, None)], key=str)
