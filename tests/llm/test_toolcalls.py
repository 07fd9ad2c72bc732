import json

from corpusloom.llm import toolcalls as m

CALLS = "conv_id bigint, call_id string, ord bigint, name string, arguments string, parents array<string>"
RESULTS = "conv_id bigint, call_id string, ord bigint, content string"
SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "number"}, "b": {"type": "number", "minimum": 0}}, "additionalProperties": False}}


def link(spark, calls, results):
    found = m.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    return {(r.conv_id, r.call_id): r for r in found}


def test_links_and_validation(spark):
    good, bad = '{"b": 2, "a": 1.5}', '{"a": "1", "c": 0}'
    got = link(
        spark,
        [(1, "x", 0, "add", good, []), (1, "y", 1, "add", bad, ["x"]), (1, "z", 2, "nope", "{}", None), (1, "x", 5, "add", "{}", []), (2, "x", 0, "add", "no json", []), (2, None, 1, "add", good, []), (None, "x", 1, "add", good, []), (3, "n", None, None, None, None)],
        [(1, "x", 3, "ü\n3.5"), (1, "x", 2, None), (2, "lost", 9, "r")],
    )
    assert {k: v.status for k, v in got.items()} == {(1, "x"): "linked", (1, "y"): "pending", (1, "z"): "pending", (2, "x"): "pending", (2, "lost"): "orphan", (3, "n"): "pending"}
    assert {k for k, v in got.items() if v.valid} == {(1, "x")}
    assert got[1, "x"].repeats == 2 and got[1, "y"].errors == ["$.b: missing", "$.a: not of type number", "$.c: not known"]
    assert got[1, "x"].json == '{"arguments":{"a":1.5,"b":2},"id":"x","name":"add","result":null}'
    assert json.loads(got[2, "lost"].json)["result"] == "r"


def levels(spark, edges, n):
    calls = [(1, str(i), i, "add", "{}", [str(p) for c, p in edges if c == i]) for i in range(n)]
    return {int(k[1]): (r.level, r.status) for k, r in link(spark, calls, []).items()}


def test_order_is_topological(spark):
    edges = [(0, 3), (3, 5), (4, 0), (6, 4), (2, 1)]  # (call, what it refers to)
    got = levels(spark, edges, 8)
    for child, parent in edges:
        assert (got[parent][0], parent) < (got[child][0], child)
    assert got[2][0] == got[1][0] == got[7][0] == 0


def test_cycles_are_told(spark):
    got = levels(spark, [(0, 1), (1, 0), (2, 3)], 5)
    assert got[0][1] == got[1][1] == "cyclic" and got[2] == (1, "pending") and got[3] == (0, "pending")


def test_long_chains_of_later_calls_are_settled(spark):
    n = 300
    got = levels(spark, [(i, i + 1) for i in range(n - 1)], n)
    assert got == {i: (n - 1 - i, "pending") for i in range(n)}


def test_levels_and_cycles_of_any_graph(spark):
    import random

    rng = random.Random(4)
    for cycles in (False, True):
        n, edges = 45, [(0, 1), (1, 2), (2, 0)] if cycles else []
        for c in range(3, n):
            edges += [(c, p) for p in rng.sample(range(c + 1, n), min(n - c - 1, rng.choice((0, 1, 1, 2))))]
        if cycles:
            edges += [(10, 5), (44, 3), (7, 0)]
        else:  # places that don't follow the references
            place = rng.sample(range(n), n)
            edges = [(place[c], place[p]) for c, p in edges]
        most = sum(p >= c for c, p in edges)
        level = dict.fromkeys(range(n), 0)
        for _ in range(n * (most + 2)):
            for c, p in edges:
                level[c] = max(level[c], min(level[p] + (p >= c), most + 1))
        want = {i: (0, "cyclic") if x > most else (x, "pending") for i, x in level.items()}
        assert levels(spark, edges, n) == want and cycles == ((0, "cyclic") in want.values())


def test_long_conversations_need_no_rounds(spark):
    got = levels(spark, [(i, i - 1) for i in range(1, 500)], 500)
    assert {x for x, _ in got.values()} == {0}


def test_plain_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", 'say "hé"\n'), (1, 2, "assistant", "hé"), (1, 3, "user", None), (1, 3, "user", None), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, None, "?"), (4, 0, "user", "long " * 50_000)], "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.ord): r for r in m.link(*m.from_turns(turns.selectExpr("*", "1 as status", "2 as level")), {"respond": m.RESPOND}).collect()}
    assert {k: v.status for k, v in got.items()} == {(1, 0): "orphan", (1, 1): "linked", (1, 3): "pending", (3, 0): "orphan", (4, 0): "pending"}
    assert got[1, 1].json == '{"arguments":{"prompt":"say \\"hé\\"\\n","turn":1},"id":"call-1-1","name":"respond","result":"hé"}'
    assert got[1, 3].repeats == 1 and not got[1, 3].valid and got[4, 0].valid


def test_arguments_that_json_cannot_say_are_invalid(spark):
    odd = {"nan": '{"a":NaN}', "inf": '{"a":1e999}', "half": '{"a":"\\ud800"}', "deep": "[" * 100_000 + "]" * 100_000, "most": "[" * 900 + "]" * 900, "digits": "9" * 5000, "null": "null", "big": '{"a":1,"b":' + "1" * 4000 + "}"}
    got = {k[1]: r for k, r in link(spark, [(1, k, i, "add", v, []) for i, (k, v) in enumerate(odd.items())], []).items()}
    for k in ("nan", "inf", "half", "deep", "digits"):
        assert not got[k].valid and got[k].errors == ["$: no JSON"] and json.loads(got[k].json)["arguments"] is None, k
    assert not got["null"].valid and not got["most"].valid and got["big"].valid
    assert m.violations(3, {"type": ["whole", "integer"]}) == ["$: the schema asks for whole, which is no type"]


def test_turns_that_call_tools(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "word " * (t + c)) for c in range(4, 8) for t in range(9)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.ord): r for r in m.link(*m.tool_turns(turns), m.TOOLS).collect()}
    assert [got[4, t].level for t in (0, 2, 4, 6, 8)] == [0] * 5 and [got[5, t].level for t in (0, 2, 4, 6, 8)] == [4, 3, 2, 1, 0]
    assert [got[6, t].status for t in (0, 2, 4, 6, 8)] == ["linked", "cyclic", "cyclic", "cyclic", "cyclic"]
    assert got[7, 8].status == "pending" and {r.valid for r in got.values()} == {True, False}
    assert {json.loads(r.json)["name"] for r in got.values()} == {"respond", "search", "note"}


def test_numbers_by_value_and_types_by_kind():
    v, c = m.violations, m.canonical
    assert v(1.0, {"type": "integer"}) == [] and v(1.5, {"type": "integer"}) and v(True, {"type": "integer"}) and v(True, {"type": "number"})
    assert v(True, {"enum": [1]}) and v(1, {"enum": [True]}) and v(1.0, {"enum": [1]}) == [] and v([1, {"a": 2.0}], {"enum": [[1.0, {"a": 2}]]}) == []
    assert c(json.loads("[100, 1e2, 100.0, -0.0, 1.5, 1e22]")) == "[100,100,100,0,1.5,10000000000000000000000]"
    assert m.checked('{"a": 1, "b": {"c": 1, "c": 1}}', {}, "t") == (None, ["$: no JSON"])
    assert m.checked('{"a": 1, "A": 1}', {}, "t") == ({"a": 1, "A": 1}, [])
