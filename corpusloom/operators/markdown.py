"""Markdown: image references, page labels, sections and front matter."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import text, yaml_scalar

_SPACE = " \t\r\n\f\v"


class _Scanner:
    """Reads images of a markdown text from left to right, by the grammar of images, links and HTML tags.

    Each method reads one construct at a place and gives what it holds and where it ends, or None if it is not there.
    """

    def __init__(self, content: str):
        self.content = content

    def blanks(self, at: int) -> int:
        while at < len(self.content) and self.content[at] in _SPACE:
            at += 1
        return at

    def target(self, at: int) -> tuple[str, int] | None:
        """'(url)' or '(url "title")'."""
        if not self.content.startswith("(", at):
            return None
        end = at + 1
        while end < len(self.content) and self.content[end] not in ")" + _SPACE:
            end += 1
        after = self.blanks(end)
        if after > end and self.content.startswith('"', after):
            closed = self.content.find('"', after + 1)
            after = closed + 1 if closed > 0 else end
            if closed > 0 and self.content.startswith(")", after):
                return self.content[at + 1 : end], after + 1
            return None
        return (self.content[at + 1 : end], end + 1) if end > at + 1 and self.content.startswith(")", end) else None

    def image(self, at: int) -> tuple[str, str, int] | None:
        """'![alt](target)': alt, url, end."""
        closed = self.content.find("]", at + 2)
        found = self.target(closed + 1) if closed > 0 else None
        return (self.content[at + 2 : closed], *found) if found else None

    def attributes(self, at: int, end: int) -> dict[str, str]:
        """name=value pairs with quoted values; of a name that comes twice the last counts."""
        out: dict[str, str] = {}
        while (equals := self.content.find("=", at, end)) >= 0:
            before = self.content[at:equals].rstrip(_SPACE)
            name = before[max((before.rfind(c) for c in _SPACE + "\"'</"), default=-1) + 1 :]
            quote = self.blanks(equals + 1)
            closed = self.content.find(self.content[quote], quote + 1, end) if quote < end and self.content[quote] in "\"'" else -1
            if closed >= 0 and name:
                out[name.lower()] = self.content[quote + 1 : closed]
            at = closed + 1 if closed >= 0 else equals + 1
        return out

    def references(self) -> Iterator[tuple[int, int, str, str, str, str | None]]:
        """(start, end, kind, url, alt, link_url) in order of place, apart."""
        at, low = 0, self.content.lower()
        while True:
            places = [p for p in (self.content.find("![", at), low.find("<img", at)) if p >= 0]
            if not places:
                return
            start = min(places)
            end = start + 1
            if self.content[start] == "!":
                found = self.image(start)
                if found:
                    alt, url, end = found
                    bracketed = start > at and self.content[start - 1] == "[" and self.content.startswith("]", end)
                    linked = self.target(end + 1) if bracketed else None
                    if linked:
                        link, end = linked
                        yield start - 1, end, "linked_markdown_image", url, alt, link
                    else:
                        yield start, end, "markdown_image", url, alt, None
            elif not low[start + 4 : start + 5].isalnum() and low[start + 4 : start + 5] != "_" and (closed := self.content.find(">", start)) >= 0:
                own = self.attributes(start + 4, closed)
                if own.get("src"):
                    end = closed + 1
                    yield start, end, "html_image", own["src"], own.get("alt", ""), None
            at = end


def image_references(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, ordinal, kind, span_start, span_end, url, alt, link_url) of each document's images, in order of place.

    Linked images, plain ones, and HTML tags with a source; spans in code points. Character references are resolved and
    blanks around URLs and descriptions dropped. Null and empty documents have none.
    """
    names = [key, "ordinal", "kind", "span_start", "span_end", "url", "alt", "link_url"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    plain = lambda x: None if x is None else html.unescape(x).strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for i, said in enumerate(batch.column(1)):
                for n, (a, b, kind, url, alt, link) in enumerate(_Scanner(said.as_py() or "").references(), 1):
                    owner.append(i)
                    rows.append((n, kind, a, b, plain(url), plain(alt), plain(link) or None))
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, content).mapInArrow(run, f"`{key}` {kind}, ordinal int, kind string, span_start int, span_end int, url string, alt string, link_url string")


def page_labels(scope: Column | str) -> Column:
    """The distinct page numbers that a reading scope asks for, in order, as text.

    Lists as 'páginas 1, 2 e 3' and ranges as 'p. 10-14' of at most 300 pages more; exercises ask for their page.
    """
    page = r"(?:p[aá]g\.?(?:ina)?|page|p\.)s?\s*(?:n[ºo.]?\s*)?"
    segments = F.filter(F.split(text(scope), r"[;\n]"), lambda s: s.rlike(r"(?i)" + page + r"\d"))
    wanted = F.transform(segments, lambda s: F.regexp_extract(s, r"(?i)" + page + r"(\d+(?:\s*(?:,|e|and)\s*\d+)*(?:\s*(?:-|–|—|a|até|to|through)\s*\d+)?)", 1))

    def numbers(s: Column) -> Column:
        a = F.regexp_extract(s, r"(\d+)\s*(?:-|–|—|a|até|to|through)\s*(\d+)", 1).try_cast("int")
        b = F.regexp_extract(s, r"(\d+)\s*(?:-|–|—|a|até|to|through)\s*(\d+)", 2).try_cast("int")
        span = F.when((a <= b) & (b - a <= 300), F.sequence(a, F.greatest(a, F.least(b, a + 300)))).otherwise(F.array().cast("array<int>"))
        each = F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
        return F.when(a.isNotNull() & b.isNotNull(), span).otherwise(each)

    return F.transform(F.filter(F.array_distinct(F.flatten(F.transform(wanted, numbers))), lambda n: n > 0), lambda n: n.cast("string"))


def front_matter(**fields: Column) -> Column:
    """YAML front matter of scalar fields, in the order given."""
    lines = [F.concat(F.lit(f"{k}: "), yaml_scalar(v.cast("string"))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def combined(pages: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, markdown): the non-blank pages of a key, in order, an empty line between."""
    listed = F.array_sort(F.collect_list(F.struct(order, content)))
    kept = F.filter(F.transform(listed, lambda x: F.trim(x[content])), lambda x: x != "")
    return pages.groupBy(key).agg(F.array_join(kept, "\n\n").alias("markdown"))
