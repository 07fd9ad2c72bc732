import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from corpusloom.llm import repair

TURNS = "conv_id bigint, turn bigint, role string, text string"


def edits(rows):
    """All edit sequences of rows with at most two insertions between rows, by brute force: the least (cost, labels)."""
    per = []
    for initial, fault in rows:
        options = [(4, "D", "")]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            options += [(more, "K", initial or "?"), (3 + more, "R", "u"), (3 + more, "R", "a")]
        per.append(options)
    put_in = [(3 * n, "I" * n, "".join(r)) for n in range(3) for r in itertools.product("ua", repeat=n)]
    steps = [put_in]
    for options in per:
        steps += [options, put_in]
    return min((sum(c for c, _, _ in way), "".join(x for _, x, _ in way)) for way in itertools.product(*steps) if re.fullmatch("(s?(ua)+)?", "".join(r for _, _, r in way)))


def test_shortest_paths_are_those_of_brute_force():
    rng = random.Random(2)
    for n, tries in ((0, 1), (1, 60), (2, 150), (3, 60)):
        for _ in range(tries):
            rows = [(rng.choice(("s", "u", "a", "t", "")), rng.choice(("", "", "blank", "duplicate", "truncated"))) for _ in range(n)]
            cost, labels, roles = repair.shortest(rows)
            assert (cost, labels) == edits(rows), rows
            assert re.fullmatch("(s?(ua)+)?", roles.replace("-", "")) and len(roles) == len(labels)


def by_strings(rows):
    """Distances to the end with whole strings as weights, as the definition says."""
    best = {(len(rows), 0): (0, ""), (len(rows), 3): (0, "")}
    grammar = repair.GRAMMAR
    for i in range(len(rows), -1, -1):
        here = {q: best[i, q] for q in range(4) if (i, q) in best}
        if i < len(rows):
            for q in range(4):
                for cost, label, role in repair.arcs(*rows[i]):
                    to = q if role is None else grammar[q].get(role)
                    if to is not None and (i + 1, to) in best:
                        c, x = best[i + 1, to]
                        here[q] = min(here.get(q, (10**9, "")), (cost + c, label + x))
        for _ in range(4):
            for q in range(4):
                for r in "ua":
                    if (to := grammar[q].get(r)) in here:
                        here[q] = min(here.get(q, (10**9, "")), (3 + here[to][0], "I" + here[to][1]))
        best |= {(i, q): w for q, w in here.items()}
    return best[0, 0]


def test_ranks_stand_for_strings():
    rng = random.Random(6)
    for _ in range(600):
        rows = [(rng.choice("suaaut"), rng.choice(("", "", "", "blank", "duplicate", "truncated"))) for _ in range(rng.randint(0, 40))]
        assert repair.shortest(rows)[:2] == by_strings(rows)


def plain(rows):
    """A conversation's row of the result from its rows (conv_id, turn, role, text), by the definitions."""
    after = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    symbols, seen = [], set()
    for _, role, text in after:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        symbols.append((role[:1], "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""))
        seen.add((role, text))
    turns = {t for t, _, _ in after if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    cost, audit = by_strings(symbols)
    length = sum(x != "D" for x in audit)
    system, out, at = length % 2 == 1, [], 0
    for x in audit:
        k = len(out)
        role = "user" if (k - system) % 2 == 0 else "assistant"
        if x != "D":
            out.append(f"{after[at][1] if x == 'K' else role}:{'' if x == 'I' else after[at][2]}")
        at += x != "I"
    count = lambda f: sum(s[1] == f for s in symbols)
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as copies", "'x' as _kind", "null as audit", "'y' as cost")


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_conversations_as_plainly_made(spark):
    rng = random.Random(8)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice((turn, turn, turn, None, turn * 2)), rng.choice(("user", "assistant", "system", "tool", None, "")), rng.choice(("Yes.", "No", "", None, " \t", "a\nb!", "日本。", "why? \n", "Yes."))))
    rows += [(500, 1, "user", "same."), (500, 1, "user", "same."), (501, None, None, None)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(frame(spark, rows)).collect()}
    want = {k: plain(v) for k, v in groups(rows).items()}
    assert got == want
    assert repair.repair(frame(spark, [])).count() == 0


def test_long_conversations_and_spooled_texts(spark, monkeypatch):
    long = [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(20_000)] + [(2, 0, "user", "long " * 400_000), (2, 1, "assistant", "é. " * 900_000)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(frame(spark, long)).collect()}
    assert {k: v[-1] for k, v in got.items()} == {k: plain(v)[-1] if k == 2 else got[1][-1] for k, v in groups(long).items()}
    assert got[1][1] > 0 and len(got[1][6]) >= got[1][1]
    monkeypatch.setattr(repair, "SPOOL", 10)
    c = repair._Conversation()
    for i, text in enumerate(("one.", "two.", "three.")):
        c.add(i, ("user", "assistant", "user")[i], text)
    assert c.result()[-1] == hashlib.sha256(b"user:one.\nassistant:two.\nuser:three.\nassistant:").hexdigest()


def test_query_over_the_table(spark):
    data = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in repair.query(spark, data).collect()}
    assert got == {k: plain(v) for k, v in groups(rows).items()}
    assert repair.query(spark, data).where(F.col("cost") < 0).count() == 0
