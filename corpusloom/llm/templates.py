"""Main text of web pages, by the template that pages of a host share.

A page is a sequence of tokens: start and end tags and pieces of text, each with its place in the tree of elements, so that the
same tag in two places is two tokens. A token's occurrence vector says how often it stands in each page of its host. Vectors
are never gathered: their digests are sums over pages, made in part before any shuffle. Tokens with equal vectors are a class;
those that repeat within a page have one role for each element around them that does not.
Large classes that most pages have are kept if they are valid: in every page their tokens come in one order, cycle by
cycle, and classes nest, none straddling another. Valid classes, nested, are the template; what lies between their
tokens are slots. Pieces of text in the template are boilerplate; of the slots those of the host's main container are
returned: its <article>, else its <main>, else the container with the most prose over the host's pages. Elements that say that
they are something else (menus, notices, comments and so on) are no part of it. Hosts of few different pages share one template, of tags only.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, table

#: Different pages that a host needs for a template of its own; tokens that a class needs; part of the pages that have to have them.
HOST_PAGES, CLASS_TOKENS, SUPPORT = 5, 3, 0.5
#: Tokens of templates that are sent to all tasks at most; of more, pages are joined to them by host.
SENT_TOKENS = 1_000_000
#: Stands for all hosts with fewer pages.
EVERY = "*"

# Elements of HTML by how they are read and rendered.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SEAMLESS = INLINE | frozenset("script style template noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
CLOSED_BY_NEXT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table tbody thead tfoot select div".split())
CONTAINERS = frozenset("article main section div td body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are no main text, and roles, words of class and id that say so.
CHROME = frozenset("head nav footer aside form menu dialog select button input object canvas audio video search datalist fieldset".split()) | RAW
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    """ad ads adbox adslot adsense advert adverts advertisement advertisements advertising banner sponsor sponsors sponsored promo promos promotion promoted
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc skip topbar toolbar masthead header
    footer foot copyright colophon legal sidebar sidebars rail widget widgets related recommended recommendations trending popular
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay disclaimer paywall
    newsletter subscribe subscription signup signin login register search share sharing social follow
    comment comments commentlist disqus reply replies respond responses discussion discussions feedback form""".split()
)

_TAG = r"""</?[a-zA-Z][^\s/>]*+(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']?[^\s>]*+))?|=)*+(?:>|\Z)"""
_TOKEN = re.compile(rf"(?:[^<]++|<(?![a-zA-Z/!?]|\Z))++|{_TAG}|<!--.*?(?:-->|\Z)|<(?:[!?/].*?(?:>|\Z)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_HARD, _SOFT, _HEAD = 1, 2, 3
#: The bit that marks tokens of text.
TEXT = 2


@lru_cache(maxsize=1 << 16)
def tag(raw: str) -> tuple[bool, str, str, int]:
    """(end tag?, name, name with class and id, whether it is chrome: by element or role, by words, or a header) of a tag's text."""
    end = raw.startswith("</")
    name = re.match(r"[^\s/>]+", raw[1 + end :])[0].lower()
    if end:
        return True, name, name, 0
    at = {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(raw[1 + len(name) :].removesuffix(">")))}
    named = f"{at.get('class', '')} {at.get('id', '')}"
    words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", named).lower())
    hidden = "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", ""))
    kind = 0
    if name in CHROME or hidden or at.get("role", "").lower() in CHROME_ROLES:
        kind = _HARD
    elif name == "header":
        kind = _HEAD
    elif name not in ("html", "body", "main") and CHROME_WORDS.intersection(words):
        kind = _SOFT
    # Long numbers in names are those of pages, not of places.
    return False, name, ".".join([name, *re.sub(r"\d{3,}", "#", named).split()]), kind


@dataclass
class Page:
    """A page's elements (parents stand before children), its tokens, and its text in order."""

    parent: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [0])
    tokens: list[int] = field(default_factory=list)
    places: set[int] = field(default_factory=set)
    #: (element, text, its token), or (element, None, 0) where a block begins or ends.
    text: list[tuple[int, str | None, int]] = field(default_factory=list)


def _hash(token: str, place: int) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace"), place)


def parse(source: str, texts: bool = True) -> Page:
    """A page as a tree, by HTML's rules as far as text depends on them. A tag that the page's end cuts off is dropped.

    The last two bits of a token say what it is: none for a start tag, 1 for its end tag, TEXT for a piece of text (whose
    tokens are left out, 0, unless texts).
    """
    page, stack, open_ = Page(), [0], Counter()
    at, end = 0, len(source)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_[page.name[stack.pop()]] -= 1

    while at < end:
        m = _TOKEN.match(source, at)
        raw, at = m[0], m.end()
        if raw[0] != "<" or len(raw) > 1 and raw[1] not in "/!?" and not raw[1].isalpha():
            token = _hash(raw.strip(), page.path[stack[-1]]) | TEXT if texts else 0
            page.text.append((stack[-1], raw, token))
            if texts:
                page.tokens.append(token)
            continue
        if len(raw) < 3 or not (raw[1].isalpha() or raw[1] == "/" and raw[2].isalpha()) or not raw.endswith(">"):
            continue
        closing, name, place, kind = tag(raw)
        if name not in SEAMLESS:
            page.text.append((stack[-1], None, 0))
        if closing:
            if open_[name]:
                depth = next(i for i in range(len(stack) - 1, 0, -1) if page.name[stack[i]] == name)
                page.tokens.append(page.path[stack[depth]] ^ 1)
                pop_to(depth)
            continue
        if name in CLOSES_P and open_["p"]:
            depth = len(stack) - 1
            while page.name[stack[depth]] in INLINE:
                depth -= 1
            if page.name[stack[depth]] == "p":
                pop_to(depth)
        if name in CLOSED_BY_NEXT:
            depth = len(stack) - 1
            while depth and page.name[stack[depth]] not in LISTS and page.name[stack[depth]] not in CLOSED_BY_NEXT[name]:
                depth -= 1
            if depth and page.name[stack[depth]] in CLOSED_BY_NEXT[name]:
                pop_to(depth)
        page.parent.append(stack[-1])
        page.name.append(name)
        page.kind.append(kind)
        page.path.append(_hash(place, page.path[stack[-1]]) & ~3)
        page.places.add(page.path[-1])
        page.tokens.append(page.path[-1])
        if name in RAW:
            # What is in it is no markup, up to its end tag.
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = m.end() if m else end
        elif name not in VOID:
            stack.append(len(page.name) - 1)
            open_[name] += 1
    return page


def chrome(page: Page) -> list[bool]:
    """Whether each element is something else than main text.

    Words of class and id do not count for elements that hold the article. An article in an article is a comment. Of an
    article's own header only headings are its text.
    """
    n = len(page.name)
    inside, holds = [False] * n, [False] * n
    for i in range(1, n):
        up = page.parent[i]
        inside[i] = inside[up] or page.name[up] == "article"
        if page.name[i] in ("article", "main") and page.kind[i] == 0:
            while up and not holds[up]:
                holds[up] = True
                up = page.parent[up]
    out, head = [False] * n, [False] * n
    for i in range(1, n):
        up, kind = page.parent[i], page.kind[i]
        out[i] = out[up] or kind == _HARD or kind == _SOFT and not holds[i] or page.name[i] == "article" and inside[i]
        own = kind == _HEAD and not holds[i]
        head[i] = own or head[up] and not (inside[i] and page.name[i] in HEADINGS)
    return [a or b for a, b in zip(out, head)]


def prose(page: Page, out: list[bool], template: frozenset | set) -> dict[int, list[int]]:
    """By path of a container: (3 for articles, 2 for <main>, 1 for others; words of its slots outside links)."""
    n = len(page.name)
    link, owner = [False] * n, [0] * n
    for i in range(1, n):
        link[i] = link[page.parent[i]] or page.name[i] == "a"
        owner[i] = i if page.name[i] in CONTAINERS else owner[page.parent[i]]
    found: dict[int, list[int]] = {}
    for node, text, token in page.text:
        if text is None or out[node] or link[node] or token in template:
            continue
        words, at = len(text.split()), owner[node]
        ranks = {"article": 3, "main": 2}
        if at and words:
            found.setdefault(page.path[at], [1, 0])[1] += words
        while at:  # all of an article's text is its own, that of other containers is what stands in them directly
            if (rank := ranks.get(page.name[at])) and words:
                entry = found.setdefault(page.path[at], [rank, 0])
                entry[1] += words * (entry[0] == rank)
                entry[0] = rank
            at = owner[page.parent[at]]
    return found


def best(found: dict[int, list[int]]) -> int:
    return max(((rank, words, path) for path, (rank, words) in found.items()), default=(0, 0, 0))[2]


def main_text(source: str, template: frozenset | set, container: int) -> str:
    """The slots of a page's main container, in order, white space in one space. template: tokens of text that are none."""
    page = parse(source, bool(template))
    out = chrome(page)
    if not container or container not in page.path:
        container = best(prose(page, out, template))
    n = len(page.name)
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or page.path[i] == container
    parts = []
    for node, text, token in page.text:
        if text is None:
            parts.append(" ")
        elif inside[node] and not out[node] and token not in template:
            parts.append(html.unescape(text))
    return " ".join("".join(parts).split())


def straddled(tokens: list[int], classes: dict[int, int], sizes: dict[int, int]) -> dict[int, tuple[int, bool]]:
    """For each class in a page: a digest of its tokens' order, and whether it is ordered and nested there.

    A stack holds the occurrences that are open. A token of a class below the top means that those above it are straddled.
    """
    stack: list[int] = []
    open_: set[int] = set()
    at: dict[int, int] = {}
    order: dict[int, list[int]] = {}
    fine: dict[int, bool] = {}
    for t in tokens:
        if (c := classes.get(t)) is None:
            continue
        seen = order.setdefault(c, [])
        fine.setdefault(c, True)
        size, k = sizes[c], at.get(c, 0)
        if len(seen) < size:
            fine[c] &= t not in seen
            seen.append(t)
        else:
            fine[c] &= seen[k % size] == t
        if c not in open_:
            fine[c] &= k % size == 0
            stack.append(c)
            open_.add(c)
        while stack[-1] != c:
            fine[above := stack.pop()] = False
            open_.discard(above)
        at[c] = k + 1
        if at[c] % size == 0:
            open_.discard(stack.pop())
    return {c: (xxhash.xxh64_intdigest(b"".join(t.to_bytes(8) for t in seen)) >> 1, fine[c] and at[c] % sizes[c] == 0) for c, seen in order.items()}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, pages, a, b, least, most): in how many pages of a host a token stands, the digest of its vector, its regions' bounds.

    The digest's halves are sums of 30-bit hashes of page and count, so partial sums add up and cannot overflow.
    """
    mask = (1 << 30) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, page_id, source in zip(*(batch.column(c) for c in ("host", "page_id", "html"))):
                host, source = host.as_py(), source.as_py() or ""
                page = parse(source)
                identity = xxhash.xxh64_intdigest(source.encode("utf-8", "replace"), hash_of(page_id.as_py()))
                counts = Counter(page.tokens)
                within = regions(page, counts)
                for token, n in counts.items():
                    mixed = xxhash.xxh64_intdigest(n.to_bytes(8), identity)
                    region = _signed(within[token]) if n > 1 else 0
                    for key in (host, EVERY) if token & ~1 in page.places else (host,):
                        if entry := sums.get((key, token)):
                            entry[:] = entry[0] + 1, entry[1] + (mixed & mask), entry[2] + (mixed >> 30 & mask), min(entry[3], region), max(entry[4], region)
                        else:
                            sums[key, token] = [1, mixed & mask, mixed >> 30 & mask, region, region]
            cols = list(zip(*((h, _signed(t), *v) for (h, t), v in sums.items()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string()] + [pa.int64()] * 6)], names=["host", "token", "pages", "a", "b", "least", "most"])

    found = pages.select("host", "page_id", "html").mapInArrow(run, "host string, token bigint, pages bigint, a bigint, b bigint, least bigint, most bigint")
    sums = (F.sum(c).alias(c) for c in ("pages", "a", "b"))
    return found.groupBy("host", "token").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"))


def regions(page: Page, counts: Counter) -> dict[int, int]:
    """By token the innermost element around it that comes once in the page. Tokens with one vector in two regions have two roles."""
    once = {0: 0}
    out: dict[int, int] = {}
    for i in range(1, len(page.path)):
        path = page.path[i]
        if path not in once:
            once[path] = path if counts[path] == 1 else once[page.path[page.parent[i]]]
            out[path] = out[path ^ 1] = once[path]
    for node, text, token in page.text:
        if text is not None:
            out[token] = once[page.path[node]]
    return out


def hash_of(value) -> int:
    return xxhash.xxh64_intdigest(repr(value))


def candidates(pages: DataFrame) -> DataFrame:
    """(host, tokens, classes): the classes of hosts with pages enough, and of all pages under EVERY, not yet validated."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("html")).alias("different"))
    sizes = sizes.where(F.col("different") >= HOST_PAGES).select("host", "n").unionByName(pages.agg(F.lit(EVERY).alias("host"), F.count("*").alias("n")))
    frequent = occurrences(pages).join(sizes, "host").where(F.col("pages") > SUPPORT * F.col("n"))
    classes = frequent.groupBy("host", "pages", "a", "b", "least", "most").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= CLASS_TOKENS)
    return classes.groupBy("host").agg(F.array_sort(F.collect_list("tokens")).alias("classes"))


def _with_templates(pages: DataFrame, templates: DataFrame, columns: list[str]) -> DataFrame:
    """pages with the columns of their host's template, null where it has none of its own."""
    held = templates.where(F.col("host") != EVERY).select("host", *columns)
    few = held.agg(F.coalesce(F.sum(F.size(F.flatten(columns[0]) if columns[0] == "classes" else F.col(columns[0]))), F.lit(0))).first()[0] <= SENT_TOKENS
    return pages.join(F.broadcast(held) if few else held.hint("merge"), "host", "left")


def _shared_template(templates: DataFrame, columns: list[str], empty: tuple) -> tuple:
    """The template of hosts without one; as large as a page's tags at most."""
    found = templates.where(F.col("host") == EVERY).select(*columns).first()
    return tuple(found) if found else empty


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, container): pieces of text in the valid classes of each host with pages enough, and the path of its main
    container. What lies between tags of the template is told by their paths."""
    found = materialise(candidates(pages), "html-classes")
    (shared,) = _shared_template(found, ["classes"], ([],))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def indexed(flat: tuple) -> tuple[dict[int, int], dict[int, int], bool]:
            by_token = {_unsigned(t): i for i, c in enumerate(flat) for t in c}
            return by_token, {i: len(c) for i, c in enumerate(flat)}, any(t & TEXT for t in by_token)

        for batch in batches:
            orders: dict[tuple[str, int], list[int]] = {}
            words: dict[tuple[str, int], list[int]] = {}
            for host, source, classes in zip(*(batch.column(c) for c in ("host", "html", "classes"))):
                host, classes = (host.as_py(), classes.as_py()) if classes.is_valid else (EVERY, shared)
                by_token, sizes, texts = indexed(tuple(map(tuple, classes)))
                page = parse(source.as_py() or "", texts)
                for c, (order, fine) in straddled(page.tokens, by_token, sizes).items():
                    entry = orders.setdefault((host, c), [order, order, 1])
                    entry[:] = min(entry[0], order), max(entry[1], order), entry[2] & fine
                for path, (rank, n) in prose(page, chrome(page), by_token.keys()).items():
                    entry = words.setdefault((host, _signed(path)), [0, rank, n])
                    entry[2] += n * (entry[0] > 0)
                    entry[0] = 1
            rows = [(h, c, 0, a, b, fine, 0) for (h, c), (a, b, fine) in orders.items()] + [(h, p, rank, 0, 0, 1, n) for (h, p), (_, rank, n) in words.items()]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string()] + [pa.int64()] * 6)], names=["host", "id", "rank", "least", "most", "fine", "words"])

    seen = _with_templates(pages.select("host", "html"), found, ["classes"]).mapInArrow(run, "host string, id bigint, rank bigint, least bigint, most bigint, fine bigint, words bigint")
    seen = seen.groupBy("host", "rank", "id").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("fine").alias("fine"), F.sum("words").alias("words"))
    main = F.max_by(F.when(F.col("rank") > 0, F.col("id")), F.when(F.col("rank") > 0, F.struct("rank", "words", "id")))
    valid = F.collect_list(F.when((F.col("rank") == 0) & (F.col("least") == F.col("most")) & (F.col("fine") == 1), F.col("id")))
    decided = seen.groupBy("host").agg(main.alias("container"), valid.alias("valid"))
    tokens = F.filter(F.flatten(F.transform("valid", lambda i: F.element_at("classes", (i + 1).cast("int")))), lambda t: t.bitwiseAND(F.lit(TEXT)) != 0)
    return materialise(found.join(decided, "host", "left").select("host", F.coalesce(tokens, F.array().cast("array<bigint>")).alias("tokens"), F.coalesce("container", F.lit(0)).alias("container")), "html-templates")


def with_host(pages: DataFrame) -> DataFrame:
    """pages with the host of their address, lower case, without user and port; '' where there is none."""
    authority = F.regexp_extract(F.lower("url"), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", 1)
    return pages.withColumn("host", F.coalesce(F.regexp_replace(authority, r"^.*@|:\d*$", ""), F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page has an empty text. Rows are extracted one by one, so repeats and null ids come back as they
    went in; the template is learned from all of them. Columns other than the three are not read; an empty table gives an empty one.
    """
    rows = with_host(pages.select("page_id", "url", "html"))
    found = templates(rows)
    shared = _shared_template(found, ["tokens", "container"], ([], 0))
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def template(tokens: tuple) -> frozenset:
            return frozenset(map(_unsigned, tokens))

        for batch in batches:
            texts = []
            for source, tokens, container in zip(*(batch.column(c) for c in ("html", "tokens", "container"))):
                known, main = (tokens.as_py(), container.as_py()) if tokens.is_valid else shared
                texts.append(main_text(source.as_py() or "", template(tuple(known)), _unsigned(main)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = _with_templates(rows, found, ["tokens", "container"]).select("page_id", "url", "html", "tokens", "container")
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the main text of every page. See extract()."""
    return extract(table(spark, sf_dir, "pages"))
