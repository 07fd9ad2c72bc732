"""Chat formatting: tool calls linked to their results.

Calls and results are hash-joined by conversation and identifier, calls are put in an order in which each stands after
those it refers to, their arguments are checked against the tool's schema, and each is serialised as canonical JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, release, table

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in value breaks schema (type, enum, required, properties, additionalProperties, items, minLength, minimum, maximum).

    A type that JSON does not have is a violation too, whatever the value. Numbers are compared by value, so 1.0 is an integer and
    equals 1; truth values are no numbers.
    """
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if odd := [str(k) for k in kinds if k not in _TYPES]:
        return [f"{at}: the schema asks for {'|'.join(odd)}, which is no type"]
    whole = lambda k: k == "integer" and isinstance(value, float) and value.is_integer()
    fits = lambda k: isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) or whole(k)
    if kinds and not any(map(fits, kinds)):
        return [f"{at}: not of type {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not one of the values allowed")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in properties:
                out += violations(value[k], properties[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not known")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at}: out of range")
    return out


def _plain(value):
    """value with whole numbers as integers, so that a number has one spelling."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key comes twice")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, whole numbers without a fraction or exponent, and non-ASCII characters as they are.

    ValueError for what JSON or UTF-8 cannot say.
    """
    out = json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    out.encode()  # a lone surrogate is no character
    return out


def checked(arguments: str | None, schema: dict | None, name: str | None) -> tuple[object, list[str]]:
    """(value, errors) of a call's arguments. The value is null where they are no JSON that can be written again.

    That is so for null, broken JSON, a key that an object has twice, NaN and infinite numbers, lone surrogates, and nesting
    beyond what the parser takes.
    """
    try:
        value = json.loads(arguments or "", object_pairs_hook=_object)
        canonical([[value]])  # with room for what it is put into
        return value, violations(value, schema) if schema is not None else [f"{name}: no schema"]
    except (ValueError, RecursionError):
        return None, ["$: no JSON"]


def ordered(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, ord, parents, ...) with level and cyclic: sorting by (level, ord) is topological.

    A call's level is the most references to later calls on any way back from it, so conversations that only refer
    back, whatever their length, are settled at level 0 without a round. A round takes in references to calls whose
    level is known, and leads those to a call with a single open reference on to where that one leads, so a chain
    takes logarithmically many rounds. Rounds go on while there is such a reference. A way with more references to
    later calls than the conversation has, or calls left without one, hang on a cycle: their level is 0. References to
    unknown calls count as none, and a null ord stands before all others.
    """
    ids = calls.select("conv_id", "call_id", "ord")
    links = calls.select("conv_id", F.col("call_id").alias("child"), F.col("ord").alias("c"), F.explode("parents").alias("call_id")).join(ids, ["conv_id", "call_id"])
    later = F.coalesce(F.col("ord") >= F.col("c"), F.col("c").isNull()).cast("bigint")
    links = links.select("conv_id", "child", F.col("call_id").alias("parent"), later.alias("w"))
    most = links.where("w = 1").groupBy("conv_id").agg(F.count("*").alias("_most"))
    most = materialise(most, "chat-later")
    if most.isEmpty():
        return calls.withColumns({"level": F.lit(0), "cyclic": F.lit(False)})
    # A row without a parent holds the level that the settled references of child give; one beyond _most is on a cycle.
    own = ids.select("conv_id", F.col("call_id").alias("child"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("w"))
    ways = links.unionByName(own).groupBy("conv_id", "child", "parent").agg(F.max("w").alias("w")).join(most, "conv_id")
    past: list[DataFrame] = []
    while True:
        ways = materialise(ways, "chat-ways")
        release(*past)
        settled = F.max(F.when(F.col("parent").isNull(), F.col("w")))
        calls_ = ways.groupBy("conv_id", F.col("child").alias("call_id")).agg(settled.alias("level"), F.count("parent").alias("open"), F.max("parent").alias("to"), F.max(F.when(F.col("parent").isNotNull(), F.col("w"))).alias("by"), F.first("_most").alias("_most"))
        calls_ = materialise(calls_.withColumn("cyclic", F.col("level") > F.col("_most")).withColumn("open", F.when(F.col("cyclic"), 0).otherwise(F.col("open"))), "chat-calls")
        past = [ways, calls_]
        above = calls_.select("conv_id", F.col("call_id").alias("parent"), "level", "open", "to", "by")
        led = ways.join(calls_.where("open > 0").select("conv_id", F.col("call_id").alias("child")), ["conv_id", "child"]).where("parent is not null").join(above, ["conv_id", "parent"])
        if led.where("open <= 1").isEmpty():
            break
        way = lambda to, w: F.struct(F.when(F.col("_most") >= w, to).alias("parent"), F.least(w, F.col("_most") + 1).alias("w"))
        w, none = F.col("w"), F.lit(None).cast("string")
        on = F.when(F.col("open") == 0, F.array(way(none, w + F.col("level")))).when(F.col("open") == 1, F.array(way(none, w + F.col("level")), way(F.col("to"), w + F.col("by")))).otherwise(F.array(way(F.col("parent"), w)))
        led = led.select("conv_id", "child", "_most", F.explode(on).alias("way")).select("conv_id", "child", "way.parent", "way.w", "_most")
        ways = led.unionByName(ways.where("parent is null")).groupBy("conv_id", "child", "parent").agg(F.max("w").alias("w"), F.first("_most").alias("_most"))
    found = calls_.select("conv_id", "call_id", "level", (F.col("cyclic") | (F.col("open") > 0)).alias("cyclic"))
    found = found.select("conv_id", "call_id", F.when(F.col("cyclic"), 0).otherwise(F.col("level")).cast("int").alias("level"), "cyclic")
    return calls.join(found, ["conv_id", "call_id"], "left").withColumns({"level": F.coalesce("level", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False))})


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each identifier of calls (conv_id, call_id, ord, name, arguments, parents) or results (conv_id, call_id, ord, content).

    Gives conv_id, call_id, level, ord, status, repeats, valid (false for orphans), errors, json. status: linked; pending (no result); orphan (no
    call); cyclic (linked or not, on a cycle of references). Of rows that repeat an identifier the one with the
    smallest ord (then text) counts, and repeats tells how many there were besides. Rows without conv_id or call_id
    have no identifier and are left out. arguments that are null or no JSON (see checked()), and tools without a schema,
    are invalid; other columns are not read.
    """
    def firsts(rows: DataFrame, *columns: str) -> DataFrame:
        known = rows.where("conv_id is not null and call_id is not null")
        return known.groupBy("conv_id", "call_id").agg(F.min(F.struct(*columns)).alias("_f"), (F.count("*") - 1).alias("_n")).select("conv_id", "call_id", "_n", *(F.col(f"_f.{c}").alias(c) for c in columns))

    first_calls = firsts(calls.select("conv_id", "call_id", "ord", "name", "arguments", "parents"), "ord", "name", "arguments", "parents")
    first_results = firsts(results.select("conv_id", "call_id", "ord", "content"), "ord", "content").select("conv_id", "call_id", F.col("_n").alias("_m"), F.col("ord").alias("_o"), "content", F.lit(True).alias("_answered"))
    c = ordered(first_calls).withColumn("_called", F.lit(True))
    both = c.join(first_results, ["conv_id", "call_id"], "full_outer")
    status = F.when(F.col("cyclic"), "cyclic").when(F.col("_called").isNull(), "orphan").when(F.col("_answered").isNull(), "pending").otherwise("linked")
    rows = both.select("conv_id", "call_id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("ord", "_o").alias("ord"), status.alias("status"), (F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0))).alias("repeats"), "name", "arguments", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, out = [], [], []
            for call_id, status, name, arguments, content in zip(*(batch.column(k).to_pylist() for k in ("call_id", "status", "name", "arguments", "content"))):
                value, found = (None, []) if status == "orphan" else checked(arguments, schemas.get(name), name)
                valid.append(status != "orphan" and not found)
                errors.append(found)
                out.append(canonical({"arguments": value, "id": call_id, "name": name, "result": content}))
            kept = [batch.column(k) for k in ("conv_id", "call_id", "level", "ord", "status", "repeats")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(out, pa.string())], names=["conv_id", "call_id", "level", "ord", "status", "repeats", "valid", "errors", "json"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"conv_id {kind['conv_id']}, call_id string, level int, ord {kind['ord']}, status string, repeats bigint, valid boolean, errors array<string>, json string")


#: The tool that the query takes each user's turn to call: its result is the turn after it.
RESPOND = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string"}}}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: a user's turn calls respond, any other turn is the result of the one before it."""
    identifier = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    arguments = F.struct(F.when(F.col("turn") >= 2, identifier(F.col("turn") - 2)).alias("after"), F.col("text").alias("prompt"), "turn")
    calls = rows.where("role = 'user'").select("conv_id", identifier(F.col("turn")).alias("call_id"), F.col("turn").alias("ord"), F.lit("respond").alias("name"), F.to_json(arguments).alias("arguments"), F.when(F.col("turn") >= 2, F.array(identifier(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("parents"))
    results = rows.where("role is null or role <> 'user'").select("conv_id", identifier(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("ord"), F.col("text").alias("content"))
    return calls, results


#: Tools that the query deals user turns to by the length of their text, so that some calls break their schema.
TOOLS = {
    "respond": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "array", "items": {"type": "string"}}}},
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 40}, "limit": {"type": "integer", "minimum": 1, "maximum": 4}}},
    "note": {"type": "object", "required": ["body"], "additionalProperties": False, "properties": {"body": {"type": "string"}, "kind": {"enum": ["long", "short"]}}},
}


def tool_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of conversations: a user's turn calls one of TOOLS, any other turn is the result of the one before it.

    By conv_id modulo 4 a call refers to the user's turn before, the one after, one of both (which makes cycles), or the
    two before. So the order, the cycles and the schema errors follow from the table.
    """
    identifier = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    turn, n = F.col("turn"), F.coalesce(F.length("text"), F.lit(0))
    back, on = F.array(turn - 2), F.array(turn + 2)
    kind = F.col("conv_id") % 4
    ways = F.when(kind == 0, back).when(kind == 1, on).when(kind == 2, F.when(turn % 4 < 2, back).otherwise(on)).otherwise(F.array(turn - 2, turn - 4))
    parents = F.transform(ways, identifier)
    tool = F.when(n % 3 == 0, "respond").when(n % 3 == 1, "search").otherwise("note")
    of = {
        "respond": F.struct(parents.alias("after"), F.col("text").alias("prompt"), "turn"),
        "search": F.struct((n % 7 - 1).alias("limit"), F.col("text").alias("query")),
        "note": F.struct(F.col("text").alias("body"), F.when(n % 5 == 0, "odd").when(n > 200, "long").otherwise("short").alias("kind"), F.when(turn < 2, True).alias("pinned")),
    }
    arguments = F.when(tool == "respond", F.to_json(of["respond"])).when(tool == "search", F.to_json(of["search"])).otherwise(F.to_json(of["note"]))
    calls = rows.where("role = 'user'").select("conv_id", identifier(turn).alias("call_id"), turn.alias("ord"), tool.alias("name"), arguments.alias("arguments"), parents.alias("parents"))
    results = rows.where("role is null or role <> 'user'").select("conv_id", identifier(turn - 1).alias("call_id"), turn.alias("ord"), F.col("text").alias("content"))
    return calls, results


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: tool calls made of all conversations, linked to results, ordered and checked. See tool_turns() and link()."""
    found = link(*tool_turns(table(spark, sf_dir, "conversations")), TOOLS)
    return found.select("conv_id", "call_id", "level", "ord", "status", "repeats", "valid", F.array_join("errors", "; ").alias("errors"), "json")


SQL = """
with recursive t as (select * from conversations where conv_id is not null and turn is not null),
u as (select conv_id, turn, text, coalesce(length(text), 0) as n,
  case conv_id % 4 when 0 then [turn - 2] when 1 then [turn + 2] when 2 then [case when turn % 4 < 2 then turn - 2 else turn + 2 end] else [turn - 2, turn - 4] end as refs from t where role = 'user'),
a as (select *, ['respond', 'search', 'note'][n % 3 + 1] as name, case n % 3
  when 0 then '{"after":[' || array_to_string(list_transform(refs, lambda x: '"call-' || conv_id || '-' || x || '"'), ',') || ']' || coalesce(',"prompt":' || to_json(text)::varchar, '') || ',"turn":' || turn || '}'
  when 1 then '{"limit":' || (n % 7 - 1) || ',"query":' || to_json(text)::varchar || '}'
  else '{"body":' || to_json(text)::varchar || ',"kind":"' || case when n % 5 = 0 then 'odd' when n > 200 then 'long' else 'short' end || '"' || case when turn < 2 then ',"pinned":true' else '' end || '}' end as arguments from u),
c as (select *, count(*) over (partition by conv_id, turn) as m, row_number() over (partition by conv_id, turn order by name, arguments) as k from a),
r as (select conv_id, turn, text as content, count(*) over (partition by conv_id, turn) as m, row_number() over (partition by conv_id, turn order by text nulls first) as k from t where role is null or role <> 'user'),
refs as (select conv_id, turn as child, unnest(refs) as parent from c where k = 1),
e as (select refs.* from refs join c on c.k = 1 and c.conv_id = refs.conv_id and c.turn = refs.parent),
w(conv_id, root, at_, d) as (select conv_id, turn, turn, 0 from c where k = 1 and conv_id % 4 <> 2
  union select w.conv_id, root, parent, d + (parent >= child)::integer from w join e on e.conv_id = w.conv_id and e.child = w.at_),
lv as (select conv_id, root as turn, max(d) as level from w group by all),
cyc as (select distinct conv_id, child as turn from e where conv_id % 4 = 2),
j as (select coalesce(c.conv_id, r.conv_id) as conv_id, 'call-' || coalesce(c.conv_id, r.conv_id) || '-' || coalesce(c.turn, r.turn - 1) as call_id, coalesce(c.turn, r.turn) as ord, c.turn as called, r.turn as answered,
  coalesce(c.m - 1, 0) + coalesce(r.m - 1, 0) as repeats, c.n, c.name, c.arguments, content,
  array_to_string(list_filter(case when c.turn is null then [] when c.n % 3 = 0 then [case when c.text is null then '$.prompt: missing' when c.text = '' then '$.prompt: too short' end, case when c.turn < 0 then '$.turn: out of range' end]
    when c.n % 3 = 1 then [case when c.n % 7 - 1 not between 1 and 4 then '$.limit: out of range' end, case when c.n < 40 then '$.query: too short' end]
    else [case when c.n % 5 = 0 then '$.kind: not one of the values allowed' end, case when c.turn < 2 then '$.pinned: not known' end] end, lambda x: x is not null), '; ') as errors
  from (select * from c where k = 1) c full join (select * from r where k = 1) r on c.conv_id = r.conv_id and c.turn = r.turn - 1)
select j.conv_id, call_id, coalesce(case when cyc.turn is null then lv.level end, 0)::integer as level, ord,
  case when cyc.turn is not null then 'cyclic' when called is null then 'orphan' when answered is null then 'pending' else 'linked' end as status, repeats::bigint as repeats,
  called is not null and errors = '' as valid, errors,
  '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json(call_id)::varchar || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(content)::varchar, 'null') || '}' as json
from j left join cyc on cyc.conv_id = j.conv_id and cyc.turn = called left join lv on lv.conv_id = j.conv_id and lv.turn = called
"""
