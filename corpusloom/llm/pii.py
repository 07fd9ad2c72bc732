"""Personal data with offsets kept: plain identifiers, and disguised ones found through a normalising transducer.

Plain (base) identifiers are matched on the text as it is. For disguised ones a transducer reads the text and writes
a normalised one: look-alike characters and digits of other scripts become ASCII, spelled digits become digits,
at/dot disguises become @ and '.'. With each character written it keeps which source characters it stands for, so that
a span found in the normalised text maps back to code points of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive forms: these parts never give back, so a long run costs its length once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the local part is all of its characters before it, back to the end of the match before."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


_DIGITS = re.compile("[0-9]")


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers (kind, start, end) of a text, leftmost and non-overlapping for each kind."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], _RANK[x[0]]))


# ---- the transducer -------------------------------------------------------------------------------------------

#: Letters of other scripts that look like these ASCII letters.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
#: Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Words for @ and '.'.
AT_WORDS, DOT_WORDS = ("at", "arroba", "chez"), ("dot", "punto", "point", "punkt")

_FOREIGN = re.compile("[^\x00-ɏ]")
_DIGIT_WORD = "|".join(SPELLED)
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
#: Three spelled digits or more, with digits or dots among them; brackets around at/dot; an at with 'x dot y' after it.
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:(?:plus|\+) ?)?(?:{_DIGIT_WORD})(?:[ ,-]+(?:{_DIGIT_WORD}|{_DOT}|[0-9]+)){{2,}}(?![^\W_])", re.I)
_SPELLED_PAIR = re.compile(rf"(?:{_DIGIT_WORD})[ ,-]+(?:{_DIGIT_WORD}|{_DOT}|[0-9])")  # of lowered texts
_BRACKETED = re.compile(rf"[\[({{<] ?(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.)) ?[\])}}>] ?", re.I)
_BARE = re.compile(rf" (?:{_AT}) ", re.I)
_BARE_DOMAIN = re.compile(rf"[\w-]++(?:(?: (?:{_DOT}) |\.)[\w-]++)+", re.I)
_BARE_DOT = re.compile(rf" (?:{_DOT}) ", re.I)
_TOKEN = re.compile(rf"(?P<plus>(?:plus|\+) ?)|(?P<digit>{_DIGIT_WORD})|(?P<dot>{_DOT})|(?P<sep>[ ,-]+)|(?P<own>[0-9]+)", re.I)


def lowered(text: str) -> str:
    """The text in lower case, with all letters that patterns without case take for i and s as these."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


def fold(char: str) -> str:
    """The ASCII character that a single one stands for, or itself: full-width forms, other scripts' digits, look-alikes."""
    if "！" <= char <= "～":
        return chr(ord(char) - 0xFEE0)
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    digit = unicodedata.decimal(char, None)
    return char if digit is None else str(digit)


def rewrites(text: str) -> list[tuple[int, int, str]]:
    """The transducer's rewrites (start, end, what is written) beyond single characters, in order, apart."""
    found = []
    for m in _BRACKETED.finditer(text):
        found.append((m.start() - text.endswith(" ", 0, m.start()), m.end(), "@" if m["at"] else "."))
    for m in _BARE.finditer(text):
        if m.start() and text[m.start() - 1] in _LOCAL and (domain := _BARE_DOMAIN.match(text, m.end())):
            found.append((*m.span(), "@"))
            found += [(*d.span(), ".") for d in _BARE_DOT.finditer(text, *domain.span())]
    for run in _SPELLED_RUN.finditer(text) if _SPELLED_PAIR.search(lowered(text)) else ():
        for t in _TOKEN.finditer(text, *run.span()):
            found.append((*t.span(), SPELLED[lowered(t["digit"])] if t["digit"] else "." if t["dot"] else "+" if t["plus"] else t["own"] or ""))
    out: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class Spans:
    """Where the pieces of a normalised text come from: a run of each rewrite and of each stretch between two of them.

    Memory follows the number of rewrites, not the text's length.
    """

    def __init__(self):
        self.at: list[int] = []
        self.source: list[tuple[int, int, bool]] = []
        self.length = 0

    def add(self, n: int, start: int, end: int, same: bool) -> None:
        """n characters were written for source [start, end): one for one if same, else all of them for the whole."""
        if n:
            self.at.append(self.length)
            self.source.append((start, end, same))
            self.length += n

    def back(self, a: int, b: int) -> tuple[int, int]:
        """The source span of the written characters [a, b)."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        first, last = self.source[i], self.source[j]
        return first[0] + (a - self.at[i]) * first[2], last[0] + b - self.at[j] if last[2] else last[1]


def normalise(text: str) -> tuple[str, Spans]:
    """The normalised text, and the way back from its characters to the source's."""
    if _FOREIGN.search(text):
        table_ = {ord(c): fold(c) for c in set(text) if c > "ɏ"}
        text = text.translate(table_)  # one character for one, so places stay
    written: list[str] = []
    spans, at = Spans(), 0
    for a, b, new in [*rewrites(text), (len(text), len(text), "")]:
        written += (text[at:a], new)
        spans.add(a - at, at, a, True)
        spans.add(len(new), a, b, b - a == len(new))
        at = b
    return "".join(written), spans


#: Strings (of lower-cased texts) of which a disguised identifier has one at least; plain searches, so cheap.
_HINTS = tuple(f" {w} " for w in AT_WORDS)
_DIGIT_HINTS = tuple(f"{w}{sep}" for w in SPELLED for sep in " ,-")
_OPEN = re.compile(rf"[\[({{<] ?(?:{_AT}|@|{_DOT}|\.) ?[\])}}>]")


def disguised(text: str) -> bool:
    if not text.isascii() and _FOREIGN.search(text):
        return True
    low = lowered(text)
    hinted = any(h in low for h in _HINTS) or _OPEN.search(low) or any(h in low for h in _DIGIT_HINTS) and _SPELLED_PAIR.search(low)
    return bool(hinted) and bool(rewrites(text))


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base identifiers, all identifiers) of a text, as (kind, start, end) in code points, end exclusive.

    All are the base ones and those of the normalised text that are not inside a base one of their kind, overlapping
    or not: a plain e-mail with a bracketed dot after it is one, and the longer one another.
    """
    text = text or ""
    base = identifiers(text)
    if not text or not disguised(text):
        return base, base
    plain, spans = normalise(text)
    extra = [(kind, *spans.back(a, b)) for kind, a, b in identifiers(plain)]
    own = {kind: [(x, y) for k, x, y in base if k == kind] for kind in KINDS}
    out = list(base)
    for kind, a, b in extra:
        at = bisect_right(own[kind], a, key=lambda x: x[0]) - 1
        y = own[kind][at][1] if at >= 0 else 0
        if b > y:
            out.append((kind, a, b))
    return base, sorted(out, key=lambda x: (x[1], _RANK[x[0]]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): counts and digest of base identifiers, spans of all.

    Null and empty texts have none. Rows are treated apart, so repeated and null ids come back as they went in;
    other columns are not read. Base spans of a kind don't overlap; those added can overlap them, and other kinds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for text in batch.column("text"):
                base, every = find(text.as_py())
                for i, kind in enumerate(KINDS):
                    counts[i].append(sum(k == kind for k, _, _ in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: personal data in every document. See detect()."""
    return detect(table(spark, sf_dir, "documents"))
