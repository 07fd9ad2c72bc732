import hashlib
import random
import re

from tests.llm.helpers import ODD, docs

from corpusloom.llm import pii


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for alphabet in ("a1.@-+ ", "12.0 ", "1 -+().4", "a@.b", "0123456789 -", "é@a.1"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24)))
            assert pii.identifiers(text) == plain(text), text
            assert pii.find(text)[0] == plain(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def found(text):
    return [(k, text[a:b]) for k, a, b in pii.find(text)[1]]


def test_disguises_map_back_to_the_source():
    assert found("write bob [at] mail (dot) example (dot) com now") == [("email", "bob [at] mail (dot) example (dot) com")]
    assert found("bob at mail dot example dot com") == [("email", "bob at mail dot example dot com")]
    assert found("plus one five five five, two three four nine nine") == [("phone", "plus one five five five, two three four nine nine")]
    assert found("card four one one one 1111 1111 1111") == [("card", "four one one one 1111 1111 1111")]
    assert found("ｂｏｂ＠ｍａｉｌ．ｃｏｍ") == [("email", "ｂｏｂ＠ｍａｉｌ．ｃｏｍ")]
    assert found("bоb@mаil.com") == [("email", "bоb@mаil.com")]
    assert found("one nine two dot one six eight dot one dot one") == [("ip", "one nine two dot one six eight dot one dot one")]
    assert found("we met at noon, dot com") == []


def test_base_spans_stay_beside_longer_disguised_ones():
    text = "a@b.co [dot] uk and c [at] d [dot] org"
    base, every = pii.find(text)
    assert base == [("email", 0, 6)] and every == [("email", 0, 6), ("email", 0, 15), ("email", 20, 38)]


def test_look_alikes_beside_plain_fragments_are_found_whole():
    for text, fragment in (("jоhn.smith@example.com", "hn.smith@example.com"), ("john@example.cоm", "john@example.c"), ("jоhn@exаmple.co.uk", None)):
        base, every = pii.find(f"to {text} now")
        assert [f"to {text} now"[a:b] for _, a, b in base] == ([fragment] if fragment else [])
        assert ("email", 3, 3 + len(text)) in every and set(base) <= set(every)
    assert found("é а a@b.co") == [("email", "a@b.co")]


def test_spelled_runs_pass_the_filter():
    for text in ("eight dot eight dot eight dot eight", "one dot one dot one dot one", "one dot 1 dot two dot 3"):
        assert found(f"ask {text} now") == [("ip", text)]
    rng = random.Random(5)
    words = [*pii.SPELLED, *pii.DOT_WORDS, "7", "42", "SEVEN", "ſix", "fıve", "FİVE", "Point"]
    for _ in range(4000):
        text = "".join(rng.choice(words) + rng.choice((" ", ", ", "-", ".")) for _ in range(rng.randint(2, 7)))
        if pii._SPELLED_RUN.search(text):
            assert pii._SPELLED_PAIR.search(pii.lowered(text)) and pii.disguised(text), text
            pii.find(text)


def test_long_runs_stay_linear():
    for text in ("1" * 300_000, "a." * 150_000 + "@", "1." * 150_000, "+1" * 100_000, "one " * 60_000, "x at " * 60_000, "@" * 200_000):
        pii.find(text)


def test_rows_for_odd_inputs(spark):
    rows = [*ODD, (9, "x a@b.co y 10.0.0.1 z +1 (017) 555-7713, 4111 1111 1111 1111"), (9, "x a@b.co y")]
    got = pii.detect(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    text = next(t for i, t in rows if i == 9)
    row = next(r for r in got if r.doc_id == 9 and r.n_ip)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text))
    assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and row.spans == joined
    none = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == none and r.spans == "" for r in got if r.doc_id != 9)
    assert pii.detect(docs(spark, [])).count() == 0
