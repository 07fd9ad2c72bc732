"""HTML to markdown, and repairs of markdown: what has no expression of its own runs in Arrow batches."""

from __future__ import annotations

import html
import itertools
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import text
from corpusloom.operators import joins

_SKIPPED = {"script", "style", "noscript", "template", "head"}
_VOID = {"br", "img", "hr", "input", "meta", "link"}
_BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "table", "tr", "ul", "ol", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr"}


class _Renderer(HTMLParser):
    """Blocks of a page as markdown, in reading order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.stack: list[str] = []
        self.counts: list[int] = []
        self.link: str | None = None
        self.skipped = 0

    def flush(self) -> None:
        raw = "".join(self.line)
        self.line = []
        pre = "pre" in self.stack
        said = raw.strip("\n") if pre else re.sub(r"[ \t\r\n]+", " ", raw).strip()
        if not said:
            return
        if pre:
            said = f"```\n{said}\n```"
        head = next((t for t in reversed(self.stack) if re.fullmatch("h[1-6]", t)), None)
        if head:
            said = f"{'#' * int(head[1])} {said}"
        elif "li" in self.stack:
            lists = [t for t in self.stack if t in ("ul", "ol")]
            mark = f"{self.counts[-1]}." if lists and lists[-1] == "ol" and self.counts else "-"
            said = f"{'  ' * max(0, len(lists) - 1)}{mark} {said}"
        if "blockquote" in self.stack:
            said = f"> {said}"
        self.blocks.append(said)

    def handle_starttag(self, tag, attributes):
        if tag in _SKIPPED:
            self.skipped += 1
        if self.skipped:
            return
        a = {k: v or "" for k, v in attributes}
        if tag in _BLOCKS:
            self.flush()
        if tag == "br":
            self.line.append("\n" if "pre" in self.stack else " ")
        elif tag == "img" and a.get("src"):
            self.line.append(f"![{a.get('alt', '')}]({a['src']})")
        elif tag in ("strong", "b"):
            self.line.append("**")
        elif tag in ("em", "i"):
            self.line.append("*")
        elif tag == "code" and "pre" not in self.stack:
            self.line.append("`")
        elif tag == "a":
            self.link = a.get("href")
            self.line.append("[" if self.link else "")
        if tag in ("ul", "ol"):
            self.counts.append(0)
        if tag == "li" and self.counts:
            self.counts[-1] += 1
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skipped = max(0, self.skipped - 1)
            return
        if self.skipped or tag not in self.stack:
            return
        if tag in ("strong", "b"):
            self.line.append("**")
        elif tag in ("em", "i"):
            self.line.append("*")
        elif tag == "code" and "pre" not in self.stack:
            self.line.append("`")
        elif tag == "a":
            self.line.append(f"]({self.link})" if self.link else "")
            self.link = None
        if tag in _BLOCKS:
            self.flush()
        if tag in ("ul", "ol") and self.counts:
            self.counts.pop()
        while self.stack and self.stack.pop() != tag:
            pass

    def handle_data(self, data):
        if not self.skipped:
            self.line.append(data)


def render(page: str | None) -> str:
    r = _Renderer()
    r.feed(page or "")
    r.close()
    r.flush()
    return "\n\n".join(r.blocks)


@F.pandas_udf(StringType())
def html_to_markdown(pages: pd.Series) -> pd.Series:
    """Headings, paragraphs, lists, quotes, code, links and images of a page; scripts and styles are left out."""
    return pages.map(render)


#: What tells the language of a piece of code, the first that holds: signs anywhere, or at its start.
CODE_LANGUAGES = (
    ("python", "anywhere", ("from ", "import ", "model.", "dataset=")),
    ("sh", "start", ("python ", "pip ", "conda ")),
)


def code_language(code: str) -> str:
    """The language named on a fence around code; text if nothing tells."""
    low = code.lower()
    for language, where, signs in CODE_LANGUAGES:
        places = [low.find(s) for s in signs] if where == "anywhere" else [0 if low.lstrip().startswith(s) else -1 for s in signs]
        if max(places) >= 0:
            return language
    return "text"


def _numbers(cell: str) -> bool:
    """Whether a cell holds line numbers, a break after each but perhaps the last."""
    parts = [p.split() for p in re.split("<br>", cell.strip(), flags=re.I)]
    parts = parts[:-1] if len(parts) > 1 and not parts[-1] else parts
    return all(p and all(map(str.isdecimal, p)) for p in parts)


def _code(cell: str) -> str:
    """The code in a cell whose lines end in breaks: no blank lines, no indentation."""
    lines = html.unescape(re.sub(r"<br\s*/?>", "\n", cell, flags=re.I)).splitlines()
    return "\n".join(x for x in map(str.strip, lines) if x)


def fence_code_tables(content: str) -> str:
    """content with each table of line numbers beside code as a fenced block.

    A table is read as what stands between its bars: two empty cells, a line's end, two rules, a line's end, the numbers
    and the code. One without code stays.
    """
    bars = [m.start() for m in re.finditer(r"\|", content)]
    out, at, i = [], 0, 0
    while i + 8 < len(bars):
        empty, also, end, rule, other, last, numbers, code = (content[a + 1 : b] for a, b in itertools.pairwise(bars[i : i + 9]))
        ruled = all(set(x.strip()) == {"-"} for x in (rule, other))
        if ruled and end == last == "\n" and not empty.strip() and not also.strip() and "<br>" in code.lower() and _numbers(numbers) and (said := _code(code)):
            out += [content[at : bars[i]], f"```{code_language(said)}\n{said}\n```"]
            at = bars[i + 8] + 1
            i += 9
        else:
            i += 1
    return "".join([*out, content[at:]])


@F.pandas_udf(StringType())
def code_tables_to_fences(texts: pd.Series) -> pd.Series:
    """Tables of line numbers beside code, as fenced code."""
    return texts.map(lambda t: None if t is None else fence_code_tables(t))


def sections(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, heading, start_seconds, body): parts of a text that begin at headings with a time stamp."""
    parts = docs.select(key, F.posexplode(F.split(text(content), r"\n(?=#{1,6} [^\n]*\d{1,2}:\d{2})")).alias("pos", "_s"))
    heading = F.regexp_extract("_s", r"^(#{1,6} [^\n]*)", 1)
    stamp = F.regexp_extract("_s", r"^#{1,6} [^\n]*?((?:\d{1,2}:)?\d{1,2}:\d{2})", 1)
    from corpusloom.functions.times import seconds_of

    return parts.select(key, "pos", heading.alias("heading"), seconds_of(stamp).alias("start_seconds"), F.when(heading == "", F.col("_s")).otherwise(F.regexp_replace("_s", r"^#{1,6} [^\n]*\n?", "")).alias("body"))


def merge_transcript(docs: DataFrame, segments: DataFrame, key: str, content: str, duration: str) -> DataFrame:
    """(key, pos, heading, section_end, spoken): each section with what is said from its start to the next one's.

    Segments: key, cue, start_seconds, text; untimed ones belong to every section of their key.
    """
    cut = sections(docs.select(key, content), key, content).where("start_seconds is not null")
    ended = joins.with_next_start(cut.join(docs.select(key, duration), key), key, "start_seconds", "pos", duration).withColumnRenamed("start_seconds", "_start").select(key, "pos", "heading", "_start", "section_end")
    timed = segments.withColumn("_end", F.col("start_seconds"))
    met = joins.overlapping(timed, ended, key, "start_seconds", "_end", "_start", "section_end", 600.0, closed=False)
    said = F.array_sort(F.collect_list(F.struct(F.coalesce("start_seconds", F.lit(-1.0)).alias("s"), "cue", "text")))
    spoken = met.groupBy(key, "pos").agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("spoken"))
    return ended.join(spoken, [key, "pos"], "left").select(key, "pos", "heading", "section_end", F.coalesce("spoken", F.lit("")).alias("spoken"))


def replace_images(docs: DataFrame, key: str, content: str, analyses: DataFrame) -> DataFrame:
    """(key, content): each markdown image replaced by what analyses (url, description) has of it; others by a note."""
    from corpusloom.operators.markdown import image_references

    refs = image_references(docs, key, content).join(analyses, "url", "left")
    pieces = refs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", F.coalesce("description", F.lit("image not available")).alias("d")))).alias("_r"))
    joined = docs.join(pieces, key, "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, r: F.struct(F.concat(acc["out"], F.substr(F.col(content), acc["at"] + 1, r["span_start"] - acc["at"]), F.lit("[Image: "), r["d"], F.lit("]")).alias("out"), r["span_end"].alias("at"))
    folded = F.aggregate(F.coalesce("_r", F.array().cast("array<struct<span_start:int,span_end:int,d:string>>")), start, step)
    return joined.select(key, F.concat(folded["out"], F.substr(text(content), folded["at"] + 1, F.length(text(content)))).alias(content))


def stitched(chunks: DataFrame, key: str, order: str, content: str) -> DataFrame:
    from corpusloom.operators.markdown import combined

    return combined(chunks, key, order, content)


def normalize_model_markdown(c: Column | str) -> Column:
    """A model's markdown without the fence around it, ending in one newline."""
    body = F.regexp_replace(F.regexp_replace(text(c), r"^\s*```(?:markdown|md)?\s*\n", ""), r"\n```\s*$", "")
    return F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n"))


#: What stands before what is said and what is shown in a section.
SPOKEN, ON_SCREEN = "**Spoken content:**", "**On-screen content:**"


def replace_spoken(section: Column, said: Column) -> Column:
    """A section with what is said put in its place: instead of what stood there, before what is shown, or at the end."""
    low = F.lower(section)
    spoken, shown = F.locate(SPOKEN.lower(), low), F.locate(ON_SCREEN.lower(), low)
    block = F.concat(F.lit(f"{SPOKEN}\n"), said, F.lit("\n"))
    rest = F.substr(section, shown)
    start = F.when((spoken > 0) & (spoken < shown), spoken).otherwise(shown)
    return (
        F.when(shown > 0, F.concat(F.left(section, start - 1), block, F.lit("\n"), rest))
        .when(spoken > 0, F.concat(F.left(section, spoken - 1), block)).otherwise(F.concat(F.regexp_replace(section, r"\s+$", ""), F.lit("\n\n"), block))
    )
