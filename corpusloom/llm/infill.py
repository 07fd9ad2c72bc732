"""Fill-in-middle transformation on big integers, one bit a byte of the text.

bytes.translate turns a text's UTF-8 bytes into class masks (line ends, bytes that begin a code point), each read as
one big integer. Shifted boolean operations mark where units (lines) end, bit_count() gives how many there are, and the
end of the k-th is selected by halving the mask: the half that holds the k-th bit is kept, by its count. No unit is cut
out or listed, so a text costs a few passes over its bits, whatever its lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, table

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Seed of the cuts; of a hundred texts, how many are transformed, and how many of these begin with the suffix.
SEED, RATE, SPM_RATE = 7, 100, 50

_LINE_END = bytes(b"1"[0] if b == 0x0A else b"0"[0] for b in range(256))
_CHAR_START = bytes(b"0"[0] if 0x80 <= b < 0xC0 else b"1"[0] for b in range(256))


def class_mask(text: bytes, table_: bytes) -> int:
    """The integer whose bit i is the class of byte i. Reading a power of two as a base is linear in the text."""
    return int(text.translate(table_)[::-1], 2) if text else 0


def unit_ends(text: bytes) -> int:
    """The mask of last bytes of units: line ends, and the last byte of a text that goes on after its last line end."""
    lines = class_mask(text, _LINE_END)
    starts = (lines << 1 | 1) & ((1 << len(text)) - 1)
    # The byte before a start ends a unit; so does the last byte.
    return starts >> 1 | (1 << len(text) >> 1)


def select(mask: int, width: int, k: int) -> int:
    """The place of the k-th set bit (from 1) of a mask of width bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if k <= n:
            mask, width = low, half
        else:
            mask, width, at, k = mask >> half, width - half, at + half, k - n
    return at


def draws(doc_id, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(doc_id, text: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of a text in UTF-8."""
    first, second, chosen, order = draws(doc_id, seed)
    ends = unit_ends(text)
    n = ends.bit_count()
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or chosen % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((first % (n + 1), second % (n + 1)))
    cut_a, cut_b = (select(ends, len(text), k) + 1 if k else 0 for k in (a, b))
    chars = class_mask(text, _CHAR_START)
    until_a, until_b = ((chars & ((1 << cut) - 1)).bit_count() for cut in (cut_a, cut_b))
    prefix, middle, suffix = text[:cut_a], text[cut_a:cut_b], text[cut_b:]
    spm = order % 100 < spm_rate
    output = (SUFFIX + suffix + PREFIX + prefix if spm else PREFIX + prefix + SUFFIX + suffix) + MIDDLE + middle
    return n, "spm" if spm else "psm", until_a, until_b - until_a, output


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; names that docs has already get underscores.

    A row for each row, judged by itself: repeats come back as they went in. A null text is an empty one, and empty
    texts are plain, as are those that contain a mark. A null doc_id draws as an empty one. Of docs only doc_id and
    text are looked at; all its columns stay.
    """
    taken = list(docs.columns)
    names = []
    for wanted in ("n", "form", "prefix_chars", "middle_chars", "output"):
        names.append(free_name(taken, wanted))
        taken.append(names[-1])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    utf8 = free_name(taken, "_utf8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [i for i, name in enumerate(batch.schema.names) if name != utf8]
            rows = [transform(i.as_py(), t.as_py() or b"", seed, rate, spm_rate) for i, t in zip(batch.column("doc_id"), batch.column(utf8))]
            made = [pa.array(c, pa.binary()).view(pa.string()) if kind == pa.string() and name == names[-1] else pa.array(c, kind) for name, kind, c in zip(names, kinds, zip(*rows))] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *made], names=[*(batch.schema.names[i] for i in rest), *names])

    schema = docs.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in zip(names, ("bigint", "string", "bigint", "bigint", "string")))).schema
    return docs.withColumn(utf8, F.col("text").cast("binary")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part contains a mark, so the first of each is the one put in."""
    head, middle = F.substring_index(output, MIDDLE.decode(), 1), F.substring_index(output, MIDDLE.decode(), -1)
    mark, at = len(MIDDLE), F.instr(head, F.when(form == "psm", SUFFIX.decode()).otherwise(PREFIX.decode()))
    one, two = F.substring(head, mark + 1, at - mark - 1), F.substring(head, at + mark, F.length(head))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document with a middle to fill in, as digests of the output and of the text rebuilt from it. See fill_in_middle()."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
e as (select *, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) as r, string_split(t, chr(10)) as p from d),
u as (select *, case when t = '' then 0 when ends_with(t, chr(10)) then len(p) - 1 else len(p) end as n,
  t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 as plain from e),
c as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b from u),
k as (select *, case when a = 0 then '' when a = len(p) then t else array_to_string(p[1:a], chr(10)) || chr(10) end as prefix,
  case when b = 0 then '' when b = len(p) then t else array_to_string(p[1:b], chr(10)) || chr(10) end as upto from c),
s as (select *, substr(upto, length(prefix) + 1) as middle, substr(t, length(upto) + 1) as suffix, r[4] % 100 < 50 as spm from k)
select doc_id, cast(n as bigint) as n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
  case when not plain then length(prefix) end as prefix_chars, case when not plain then length(middle) end as middle_chars,
  sha256(case when plain then t when spm then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from s
"""
