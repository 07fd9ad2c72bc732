import hashlib
import random
import re

from pyspark.sql import functions as F
from tests.llm.helpers import ODD, docs

from corpusloom.llm import infill


def plain(doc_id, text, seed=7, rate=100, spm=50):
    """The contract word by word: units listed and joined."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_as_units_are_listed():
    rng = random.Random(3)
    for i in range(6000):
        text = "".join(rng.choice(("a", "é", "日", "😀", "\n", "\n", "\r", "<", "P", "S>", "<P>" if i % 9 == 0 else ">", " ")) for _ in range(rng.randint(0, 30)))
        n, form, p, m, out = infill.transform(i, text.encode())
        assert (n, form, p, m, out.decode()) == plain(i, text)


def test_selection_finds_every_bit():
    rng = random.Random(4)
    for width in (1, 2, 3, 64, 65, 1000):
        mask = rng.getrandbits(width) | 1 << (width - 1)
        places = [i for i in range(width) if mask >> i & 1]
        assert [infill.select(mask, width, k) for k in range(1, len(places) + 1)] == places


def test_rates_and_long_texts():
    assert infill.transform(1, b"a\nb\n", rate=0)[1] == "plain"
    assert {infill.transform(i, b"a\nb\n", spm_rate=100)[1] for i in range(50)} == {"spm"}
    for text in ("x\n" * 400_000, "é" * 800_000, "\n" * 300_000):
        n, form, p, m, out = infill.transform(5, text.encode())
        assert (n, form, p, m, out.decode()) == plain(5, text)


def test_rows_for_odd_inputs(spark):
    rows = [*ODD, (9, "one\n\ntwo\r\nthree"), (10, "has <S> in it\nmore"), (11, "\n"), (12, "日本\n😀 é\nend\n")]
    frame = docs(spark, rows)
    made = infill.fill_in_middle(frame)
    assert made.columns == [*frame.columns, "n_", "form", "prefix_chars", "middle_chars", "output"]
    got = made.select("doc_id", "text", "n_", "form", "prefix_chars", "middle_chars", "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text) and r.back == (r.text or "")
    assert infill.fill_in_middle(docs(spark, [])).count() == 0


def test_query_and_its_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    got = infill.query(spark, data)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = c.sql(infill.SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = dict(c.sql("select doc_id, text from documents").fetchall())
    for r in got.collect():
        n, form, p, m, out = plain(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(texts[r.doc_id]))
