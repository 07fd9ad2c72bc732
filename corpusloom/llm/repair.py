"""Repair of conversations as a shortest path through composed weighted automata.

Three automata are composed lazily, that is, only states that a path can reach are made: the input acceptor reads a
conversation's rows in order, an edit transducer turns each row into none or one (keep, change of role, deletion) or
writes one of its own (insertion), and a grammar acceptor takes sequences of roles `(s?(ua)+)?`. Insertions between two rows are
layers, at most as many as a way through the grammar without a circle has arcs, so the composition has no cycle and its shortest path is found in
topological order, from the end. Weights are pairs (cost, labels) in lexicographic order. Labels are compared from
the left, and only putting one in front keeps an order of strings, so distances are to the end. Two paths that begin
with the same label go on in the same layer, so a rank among the states of each layer stands for the strings.

Rows come to a task sorted by conversation and turn and pass through it as a stream: of a row its fault, a digest and the arcs'
codes are kept until the conversation ends (its audit, a value of the result, grows with its rows too), and texts wait in a spool that
goes to disk beyond SPOOL bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Costs of edits; TRUNCATED comes on top for a row that is cut off and stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Remainders of a row's hash that decide how it is damaged; of other remainders rows stay as they are.
MODULUS, DROP, EMPTY, UNSTOP, REPEAT, AS_USER = 20, 0, 1, 2, 3, 4
#: Bytes of a conversation's texts that wait in memory.
SPOOL = 4 << 20
#: White space of the contract.
SPACE = " \t\n\x0b\x0c\r"

# The grammar: state by state, the role initials that lead on. `(s?(ua)+)?` is in states 0 (nothing yet) and 3 (after an answer).
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
_ROLES = {"u": "user", "a": "assistant"}
_LAYERS = len(GRAMMAR)
_LABELS = "DIKR"
_FAULTS = ("", "blank", "duplicate", "truncated")


def arcs(initial: str, fault: str) -> list[tuple[int, str, str | None]]:
    """The edit transducer on one row: (cost, label, role initial written, or None if nothing is)."""
    if fault in ("blank", "duplicate"):
        return [(DELETE, "D", None)]
    more = TRUNCATED if fault == "truncated" else 0
    return [(DELETE, "D", None), (more, "K", initial), *((REROLE + more, "R", r) for r in _ROLES)]


@lru_cache(maxsize=4096)
def composed(initial: str, fault: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """For each state of the grammar the arcs (cost, label, next state) that reading a row allows, made when first asked for."""
    return tuple(tuple((cost, label, q if role is None else on[role]) for cost, label, role in arcs(initial, fault) if role is None or role in on) for q, on in enumerate(GRAMMAR))


#: The arcs that write a row without reading one, and those that end.
_INSERTIONS = tuple(tuple((INSERT, "I", on[r]) for r in _ROLES if r in on) for on in GRAMMAR)
_ENDS = tuple(((0, "", q),) if q in FINAL else () for q in range(len(GRAMMAR)))


def _reached(rows: list[tuple[str, str]]) -> bytearray:
    """For each position and layer the states that some path from the start reaches, as a mask."""
    out = bytearray((len(rows) + 1) * _LAYERS)
    now = 1
    for i in range(len(rows) + 1):
        ahead, by = 0, composed(*rows[i]) if i < len(rows) else None
        for layer in range(_LAYERS):
            out[i * _LAYERS + layer] = now
            then = 0
            for q in range(len(GRAMMAR)):
                if now >> q & 1:
                    for _, _, to in by[q] if by else ():
                        ahead |= 1 << to
                    for _, _, to in _INSERTIONS[q]:
                        then |= 1 << to
            now = then
        now = ahead
    return out


def _layer(edges: list, after: dict[str, list[tuple[int, int]]]) -> tuple[list[tuple[int, int]], bytes]:
    """Distances of a layer's states: (cost, rank), and a byte for each that says its best label and next state.

    edges: for each state its arcs; after: by label, the (cost, rank) of the states of the layer that it leads to.
    """
    best = []
    for out in edges:
        least = None
        for cost, label, to in out:
            ahead = after[label][to] if label else (0, -1)
            if ahead is not None and (least is None or (cost + ahead[0], label, ahead[1]) < least[:3]):
                least = (cost + ahead[0], label, ahead[1], to)
        best.append(least)
    rank = {x: i for i, x in enumerate(sorted({b[1:3] for b in best if b}))}
    return [b and (b[0], rank[b[1:3]]) for b in best], bytes(1 + 4 * _LABELS.index(b[1]) + b[3] if b and b[1] else 0 for b in best)


def shortest(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """(cost, labels, roles) of the cheapest edits of rows (role initial, fault) into a sequence of the grammar.

    roles has for each label the initial that it writes, or '-' for deletions. Of edits that cost the same, those whose labels
    are least in ASCII; these determine the roles, since the grammar alternates.
    """
    n, states, reached = len(rows), len(GRAMMAR), _reached(rows)
    codes = bytearray((n + 1) * _LAYERS * states)
    ahead: list = []
    for i in range(n, -1, -1):
        here: list = []
        reads = composed(*rows[i]) if i < n else _ENDS
        for layer in range(_LAYERS - 1, -1, -1):
            mask = reached[i * _LAYERS + layer]
            edges = [reads[q] + _INSERTIONS[q] * (layer + 1 < _LAYERS) if mask >> q & 1 else () for q in range(states)]
            here, code = _layer(edges, {"D": ahead, "I": here, "K": ahead, "R": ahead})
            at = (i * _LAYERS + layer) * states
            codes[at : at + states] = code
        ahead = here
    labels, roles, i, layer, q = [], [], 0, 0, 0
    while code := codes[(i * _LAYERS + layer) * states + q]:
        label, to = _LABELS[(code - 1) // 4], (code - 1) % 4
        labels.append(label)
        roles.append("-" if label == "D" else next(r for r, at in GRAMMAR[q].items() if at == to))
        i, layer, q = (i, layer + 1, to) if label == "I" else (i + 1, 0, to)
    return ahead[0][0], "".join(labels), "".join(roles)


def damaged(turns: DataFrame) -> DataFrame:
    """turns after damage: conv_id, turn, role, text, and copies (0 for a dropped row, 2 for a repeated one).

    Nulls of role and text are one space, as they are in the text that is hashed; turn and conv_id stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % MODULUS
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("_kind") == AS_USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == EMPTY, "").when(F.col("_kind") == UNSTOP, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == DROP, 0).when(F.col("_kind") == REPEAT, 2).otherwise(1).alias("copies"),
    )


@dataclass
class _Conversation:
    """What is kept of a conversation while its rows pass."""

    rows: list[tuple[str, str]] = field(default_factory=list)
    seen: set[bytes] = field(default_factory=set)
    texts: tempfile.SpooledTemporaryFile = field(default_factory=lambda: tempfile.SpooledTemporaryFile(SPOOL))
    turns: list[int] = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        bare = text.rstrip(SPACE)
        key = hashlib.sha256(struct.pack(">I", len(role)) + f"{role}{text}".encode()).digest()
        fault = "blank" if not bare else "duplicate" if key in self.seen else "truncated" if bare[-1] not in ".!?" else ""
        self.seen.add(key)
        if self.rows and self.rows[-1][0] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:  # in order, so a turn is new if it is not the last one
            low, high, distinct = self.turns
            self.turns = [turn if not distinct else low, turn, distinct + (not distinct or turn != high)]
        self.rows.append((role[:1], fault))
        for part in (role.encode(), text.encode()):
            self.texts.write(struct.pack(">Q", len(part)) + part)

    def result(self) -> tuple:
        cost, labels, roles = shortest(self.rows)
        faults = [f for _, f in self.rows]
        low, high, distinct = self.turns
        digest, first = hashlib.sha256(), True
        self.texts.seek(0)

        def part() -> bytes:
            return self.texts.read(struct.unpack(">Q", self.texts.read(8))[0])

        for label, role in zip(labels, roles):
            kept, text = (b"", b"") if label == "I" else (part(), part())
            if label == "D":
                continue
            digest.update((b"" if first else b"\n") + (kept if label == "K" else _ROLES[role].encode()) + b":")
            digest.update(text)
            first = False
        self.texts.close()
        return (high - low + 1 - distinct if distinct else 0, *(faults.count(f) for f in _FAULTS[1:]), self.illegal, cost, labels, digest.hexdigest())


def repair(turns: DataFrame) -> DataFrame:
    """For each conversation of turns (conv_id, turn, role, text): faults after damage, the cheapest edits, the repaired text's digest.

    Rows are read by turn, nulls first; rows of one turn by role and text, so that any order of the table gives the same. A null
    conv_id is a conversation like others. A row with an empty role can't be kept. Rows that repeat in the table are duplicates. Null roles and texts are
    one space: roles outside the grammar, and blank rows. A conversation all of whose rows were dropped has zeros, no edits and an empty text. Columns other
    than the four are not read; an empty table gives an empty one. A conversation is one sequence with one digest, so it
    is read by one task, but not held by it.
    """
    rows = damaged(turns)
    id_type = rows.schema["conv_id"].dataType
    rows = rows.withColumn("turn", F.col("turn").cast("bigint"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, now, kind, done = False, None, pa.null(), []
        open_ = _Conversation()

        def made() -> pa.RecordBatch:
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
                if began and conv_id != now:
                    done.append((now, *open_.result()))
                    open_ = _Conversation()
                began, now = True, conv_id
                for _ in range(copies):
                    open_.add(turn, role, text)
            if done:
                yield made()
                done.clear()
        if began:
            done.append((now, *open_.result()))
            yield made()

    return rows.mapInArrow(run, f"conv_id {id_type.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every conversation after damage, with its cheapest repair. See repair()."""
    return repair(table(spark, sf_dir, "conversations"))
