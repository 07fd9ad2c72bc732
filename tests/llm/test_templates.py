import html
import random
import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import templates

PAGES = "page_id bigint, url string, html string"
WORDS = "amber birch cedar delta ember flint grove heath inlet jetty knoll larch marsh north ocean pines quarry river stone thorn".split()


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as tokens", "'x' as text", "3 as container")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def page_of(rng, i, paragraphs, comments=2):
    """A page in neutral markup: only what repeats over the host tells a template from an article."""
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    said = "".join(f"<div class='c7'><p>{sentence(rng, 4)}</p></div>" for _ in range(comments))
    return (
        f"<html><body><div class=x1><ul><li><a href=/{i}>{rng.choice(WORDS)}</a><li><a href=/>{rng.choice(WORDS)}</a></ul></div>"
        f"<div class=x2>We keep small files on your machine to know you again, {'as the law lets us' if i else 'as ever'}.</div>"
        f"<div class=x3>{body}<p><i>Printed by the house press.</i></p></div><div class=x4>{said}</div><div class=x5>No. {i}</div></body></html>"
    )


def test_neutral_markup_is_told_apart_by_the_template(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        paragraphs = [sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(3, 6))]
        rows.append((i, f"https://Plain.example:443/p/{i}", page_of(rng, i, paragraphs)))
        want[i] = " ".join(paragraphs)
    got = {r.page_id: r.text for r in templates.extract(frame(spark, rows)).collect()}
    assert got == want


def test_classes_are_those_of_whole_vectors(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{'a' if i % 3 else 'b'}.example/{i}", page_of(rng, i, [sentence(rng, 9)] * rng.randint(1, 3), rng.randint(0, 2))) for i in range(60)]
    vectors: dict = defaultdict(dict)
    for i, url, source in rows:
        page = templates.parse(source)
        counts = Counter(page.tokens)
        within = templates.regions(page, counts)
        for token, n in counts.items():
            vectors[re.search("//(.)", url)[1] + ".example", token][i] = n, within[token] if n > 1 else 0
    by_vector = defaultdict(set)
    size = Counter(re.search("//(.)", u)[1] + ".example" for _, u, _ in rows)
    for (host, token), vector in vectors.items():
        if len(vector) > templates.SUPPORT * size[host]:
            within = {w for _, w in vector.values()}
            by_vector[host, tuple(sorted((k, n) for k, (n, _) in vector.items())), min(map(templates._signed, within)), max(map(templates._signed, within))].add(templates._signed(token))
    want = {(host, frozenset(tokens)) for (host, *_), tokens in by_vector.items() if len(tokens) >= templates.CLASS_TOKENS}
    found = templates.candidates(templates.with_host(frame(spark, rows).select("page_id", "url", "html"))).collect()
    assert {(r.host, frozenset(c)) for r in found if r.host != templates.EVERY for c in r.classes} == want and want


def test_order_and_nesting():
    classes, sizes = {1: 0, 2: 0, 3: 0, 11: 1, 12: 1, 13: 1}, {0: 3, 1: 3}
    fine = lambda tokens: {c: ok for c, (_, ok) in templates.straddled(tokens, classes, sizes).items()}
    assert fine([1, 11, 12, 13, 2, 3, 1, 2, 11, 12, 13, 3]) == {0: True, 1: True}
    assert fine([1, 11, 2, 12, 13, 3])[1] is False
    assert fine([1, 2, 3, 1, 3, 2])[0] is False
    assert fine([1, 2])[0] is False
    a, b = templates.straddled([1, 2, 3], classes, sizes), templates.straddled([2, 1, 3], classes, sizes)
    assert a[0][0] != b[0][0]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<body><nav>menu</nav><article><h1>A</h1><p>one<b>two</b> &amp;&nbsp;&#233;<br>three<script>x</script>four</article><footer>f</footer>", "A onetwo & é threefour"),
        ("<article><header><h1>Title</h1><p>by line</p></header><p>Body.<aside>no</aside><div class='share-box'>no</div><section id=comments>no</section></article>", "Title Body."),
        ("<main><div class=cookie-notice>no</div><p>yes</p><form>no<input></form><div role=search>no</div></main>", "yes"),
        ("<div class='has-sidebar'><article><p>in</p><article>a comment</article></article></div>", "in"),
        ("<article><p>a < b and 3<4 <!-- no --> c<!-- cut", "a < b and 3<4 c"),
        ("<article><p>cut <a href=\"x", "cut"),
        ("<article><p>cut</", "cut"),
        ("<article><p title='a>b'>x</p><style>p{}</style><p hidden>no</p><p style='display: none'>no</p>y", "x y"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one two a b c"),
        ("<article><script>var t='</p>';if(a<b){}</script>t<textarea>no</textarea>&copy &lt;p&gt;</article>", "t © <p>"),
        ("just words, no markup", ""),
        ("<body>just words", "just words"),
        ("", ""),
    ],
)
def test_page_by_page(source, want):
    assert templates.main_text(source, frozenset(), 0) == want


def test_broken_and_deep_pages_stay_linear():
    for source in ("<div>" * 100_000 + "x", "<b>" * 50_000 + "<p>" * 50_000, "<" * 300_000, "</p>" * 200_000, "<a '" * 60_000, "<!-- " * 60_000, "&amp" * 100_000, "<li>" * 100_000, "<article>" * 5_000, "<main>" * 20_000 + "x"):
        templates.main_text(source, frozenset(), 0)


def plain(source):
    """The article of the synthetic pages, cut out by its tags."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", source or "", re.S)
    return " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*(>|\Z)", " ", re.sub(r"</?b>", "", m[1]))).split()) if m else ""


def test_rows_for_odd_inputs(spark):
    rows = [(1, None, None), (2, "no address", ""), (None, "http://h.example/", "<article>x</article>"), (3, "http://h.example/", "<article>x</article>"), (3, "http://h.example/", "<article>x</article>"), (4, "ftp://u:p@h.example:21/", "<p>" + "long words " * 200_000), (5, "", " \n")]
    got = templates.extract(frame(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id, r.url, r.text[:20], r.n_chars) for r in got.collect()), key=str) == sorted([(1, None, "", 0), (2, "no address", "", 0), (None, rows[2][1], "x", 1), (3, rows[3][1], "x", 1), (3, rows[3][1], "x", 1), (4, rows[5][1], "", 0), (5, "", "", 0)], key=str)
    assert templates.extract(frame(spark, [])).count() == 0


def test_query_over_the_pages(spark):
    data = "/root/testdata/sf0.01"
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in templates.query(spark, data).collect()}
    assert got == {k: plain(v) for k, v in sources.items()}
