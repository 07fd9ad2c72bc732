"""Image references, code tables, residual duplicates, token overlaps, page trees and accents, against plain versions and odd inputs."""

import random
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import joins, markdown, pagedata, rendering, residual


def images(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    found = {}
    for r in sorted(markdown.image_references(rows, "id", "content").collect(), key=lambda r: (r.id, r.ordinal)):
        found.setdefault(r.id, []).append(r)
    return [[(r.kind, texts[i][r.span_start : r.span_end], r.url, r.alt, r.link_url) for r in found.get(i, [])] for i in range(len(texts))]


def test_images_of_all_forms(spark):
    plain, linked, tag = "![a &amp; b]( u )", '[![x](u "t")](http://l?a&amp;b "q")', "<IMG class='c' alt=\"d &lt;\"\n src='s&amp;t' >"
    got = images(spark, f"é {linked} ![ok](v) {tag}", plain, "![a](u", "![a](u x)", '![a](u "t" )', "[![a](u)](", "[![a](u)](l", "![](z)![y](w)", None, "", "<img alt='x'>", "<image src='x'>", "<img src=''>", "![a]\n(u)", "[a ![b](c) d](e)")
    assert got[0] == [("linked_markdown_image", linked, "u", "x", "http://l?a&b"), ("markdown_image", "![ok](v)", "v", "ok", None), ("html_image", tag, "s&t", "d <", None)]
    assert got[1] == got[2] == got[3] == got[4] == [] and got[5] == [("markdown_image", "![a](u)", "u", "a", None)] == got[6]
    assert [x[2] for x in got[7]] == ["z", "w"] and got[8:14] == [[]] * 6 and [x[:3] for x in got[14]] == [("markdown_image", "![b](c)", "c")]


def test_images_of_random_texts_are_apart_and_in_order(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["![", "[![", "](", ")", "a", " ", '"', "]", "<img ", "src=", "'", ">", "u"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    last = {}
    for r in sorted(markdown.image_references(rows, "id", "content").collect(), key=lambda r: (r.id, r.ordinal)):
        assert last.get(r.id, 0) <= r.span_start < r.span_end <= len(texts[r.id]) and r.url
        last[r.id] = r.span_end


def test_tables_of_line_numbers_become_code():
    table = "before\n| | |\n| --- | - |\n| 1<br>2<BR> 3 <br>| from a import b<br/><br> x &lt; 1<br>y |after"
    assert rendering.fence_code_tables(table) == "before\n```python\nfrom a import b\nx < 1\ny\n```after"
    assert rendering.fence_code_tables(table + "\n" + table).count("```python") == 2
    for same in ("", "| a | b |\n|---|---|\n| 1 | x<br>y |", "| | |\n|---|---|\n| 1<br><br>2 | x<br>y |", "| | |\n|---|---|\n| one | x<br>y |", "| | |\n|---|---|\n| 1 | <br> <br>|", "| | |\n|---|---|\n| 1 | no break |", "|" * 50):
        assert rendering.fence_code_tables(same) == same
    assert [rendering.code_language(x) for x in ("pip install x", " conda y", "model.fit()", "x = 1", "")] == ["sh", "sh", "python", "text", "text"]


def test_residual_groups_are_whole_and_pairs_are_those_of_a_pass_in_order(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    concepts, depth = [], {}
    for scope in "ab":
        for i in range(60):
            label = "tf idf" if i in (3, 17, 40) else " ".join(rng.sample(words, 4))
            ids = [f"c{i}"] + ([f"c{rng.randrange(60)}"] if i % 9 == 0 else [])
            concepts.append((scope, i, label, "", ids))
            depth[scope, f"c{i}"] = rng.choice(["definition"] * 6 + ["math", None])
    entries = [(s, c, d) for (s, c), d in depth.items() if int(c[1:]) % 11]
    known = {(s, c): d or "definition" for s, c, d in entries}
    want = set()
    for scope in "ab":
        rows = []
        for s, i, label, _, ids in concepts:
            own = list(dict.fromkeys(c for c in ids if (s, c) in known))
            if s == scope and own and {known[s, c] for c in own} == {"definition"}:
                rows.append((i, "tfidf" if label == "tf idf" else None, {w for w in label.split() if w != "w"}, own))
        group = [r for r in rows if r[1]]
        used = set()
        ids = list(dict.fromkeys(c for r in group for c in r[3]))
        if len(group) > 1 and len(ids) > 1:
            want.add((scope, "subject", group[0][0], ",".join(ids)))
            used |= set(ids)
        for n, left in enumerate(rows):
            if used & set(left[3]):
                continue
            for right in rows[n + 1 :]:
                if not used & set(right[3]) and (left[1] and left[1] == right[1] or len(left[2] & right[2]) / len(left[2] | right[2]) >= 0.5):
                    pair = list(dict.fromkeys(left[3] + right[3]))
                    want.add((scope, "pair", left[0], ",".join(pair)))
                    used |= set(pair)
                    break
    got = residual.residual_duplicates(spark.createDataFrame(concepts, "scope string, ord int, label string, description string, candidate_ids array<string>"), spark.createDataFrame(entries, "scope string, candidate_id string, depth string"), "scope")
    assert {(r.scope, r.kind, r.ord, ",".join(r.candidate_ids)) for r in got.collect()} == want and len(want) > 20


def test_identity_keys_follow_the_first_subject_named(spark):
    rows = [("NLP", "a field"), ("nlp", "applications of bag of words"), ("NLP and bag of words", ""), ("Word2Vec", "CBOW and skip-gram"), ("TFIDF tools", ""), ("Bag of words", "n gram"), ("rainbow", ""), ("bow", "and arrow"), ("análise de sentimentos", "")]
    got = [r.k for r in spark.createDataFrame(rows, "l string, d string").select(residual.identity_key("l", "d").alias("k")).collect()]
    assert got == ["nlp_definition", None, None, "word2vec_cbow_skipgram", None, None, None, "bow_definition", "sentiment_analysis_definition"]


def test_overlaps_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(30)]
    sets = [sorted(rng.sample(words, rng.randint(0, 9))) for _ in range(120)]
    sets += [sets[5]] * 30 + [sets[6]] * 3
    rows = [(i, t, "x" if i % 3 else "y") for i, t in enumerate(sets)]
    table = spark.createDataFrame(rows, "id int, t array<string>, b string")
    for threshold in (0.35, 0.8):
        want = {}
        for i, a, p in rows:
            for j, c, q in rows[i + 1 :]:
                if p == q and a and c and len(set(a) & set(c)) / len(set(a) | set(c)) >= threshold:
                    want[i, j] = len(set(a) & set(c)) / len(set(a) | set(c))
        got = {(r.left_key, r.right_key): r.overlap for r in joins.overlap_pairs(table, "id", "t", threshold, "b").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        best = sorted(want, key=lambda k: (-want[k], k))[:24]
        assert [(r.left_key, r.right_key) for r in joins.most_similar(table, "id", "t", threshold, "b").orderBy(F.desc("overlap"), "left_key", "right_key").collect()] == best


def test_accents_are_folded_by_decomposition(spark):
    texts = ["Łódź ąęñ", "½ ﬁn ⑩ ｆｕｌｌ", "straße øre", "日本", "ÇA dž", "plain", "", "ﬃ㎏"]
    plain = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.fold_accents("t").alias("v")).collect()] == plain


def test_page_trees_of_any_depth():
    tree = {"type": "text", "value": "x"}
    for _ in range(5000):
        tree = {"tagName": "div", "children": [tree]}
    assert pagedata.render(tree) == "x"
    odd = {"tagName": "li", "properties": None, "children": [None, 3, "loose", {"tagName": "strong", "children": "no list"}, {"type": "text"}]}
    assert pagedata.render(odd) == "- ****\n" and pagedata.render(odd, pagedata.PLAIN) == "loose" and pagedata.render(None) == ""
    nested = {"tagName": "ul", "children": [{"tagName": "li", "children": [{"type": "text", "value": "a"}, {"tagName": "ol", "children": [{"tagName": "li", "children": [{"type": "text", "value": "b"}]}]}]}, {"tagName": "div", "children": [{"tagName": "li", "children": []}]}]}
    assert pagedata.render(nested) == "- ab\n    - b\n\n- \n\n" and pagedata.render(nested, pagedata.LINE) == "ab"
    assert pagedata.render({"tagName": "exercise", "properties": {"id": 3}, "children": [{"tagName": "h2", "children": [{"tagName": "a", "children": [{"type": "text", "value": " t "}]}]}]}) == "## 3. Exercise\n\n## t\n\n\n"
    assert pagedata.page_markdown("no json", "t") is None and pagedata.page_markdown("{}", "t") == "# t\n"
    code = {"tagName": "codeblock", "properties": {"id": "1"}, "children": []}
    assert pagedata.render(code).startswith("> ") and pagedata.render({"tagName": "pre", "children": ["\na\n"]}) == "```\na\n```\n\n"
    assert pagedata.render({"tagName": "blockquote", "children": []}) == "" == pagedata.render({"tagName": "slides"})
