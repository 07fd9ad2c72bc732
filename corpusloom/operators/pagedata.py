"""Pages whose content comes as a JSON tree (text nodes, and elements with a tag, properties and children), as markdown.

Each kind of element says what it takes of its children (a line, plain text, blocks, or nothing) and how it is written around
that. A tree is written with a stack of open elements of its own, so its depth is bounded by memory and not by the interpreter.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Notes for what markdown has nothing for.
CODE_NOTE, SLIDES_NOTE, CHOICE_NOTE = "> spaCy interactive code block: `{}`\n\n", "> spaCy slide deck: `{}`\n\n", "> spaCy multiple-choice exercise\n\n"

LINE, PLAIN, BLOCKS, NOTHING = "line", "plain", "blocks", "nothing"


class Kind(NamedTuple):
    """How an element is written: what it takes of its children, and the text made of that, its properties and its depth."""

    takes: str
    write: Callable[[str, dict, int], str]
    deepens: int = 0


def _ended(line: str, before: str = "", after: str = "\n\n") -> str:
    """A block of a line or lines, nothing if they are blank."""
    return f"{before}{line}{after}" if line else ""


def _as_is(inner: str, props: dict, depth: int) -> str:
    return inner


def _between(mark: str, inner: str, props: dict, depth: int) -> str:
    return f"{mark}{inner}{mark}"


def _picture(end: str, inner: str, props: dict, depth: int) -> str:
    return _ended(f"![{props.get('alt') or ''}]({props['src']})" if props.get("src") else "", after=end)


def _link(inner: str, props: dict, depth: int) -> str:
    target = props.get("href")
    return f"[{inner}]({target})" if target else inner


def _exercise(inner: str, props: dict, depth: int) -> str:
    words = [f"{props['id']}." if props.get("id") else "", props.get("title") or "Exercise", f"({props['type']})" if props.get("type") else ""]
    return f"## {' '.join(str(w) for w in words if w)}\n\n{inner}\n"


def _quote(inner: str, props: dict, depth: int) -> str:
    return _ended("\n".join(f"> {x}" for x in inner.strip().splitlines()))


def _item(inner: str, props: dict, depth: int) -> str:
    return f"{'  ' * max(0, depth - 1)}- {inner.strip()}\n"


#: Where a line is written.
IN_LINE = {
    **{tag: Kind(LINE, partial(_between, mark)) for tag, mark in {"code": "`", "strong": "**", "em": "_"}.items()},
    "a": Kind(LINE, _link),
    "img": Kind(NOTHING, partial(_picture, "")),
    "br": Kind(NOTHING, lambda inner, props, depth: "\n"),
}
#: Where blocks are written. The text of an item is one of its parts, its lists are others.
AS_BLOCKS = {
    **{f"h{n}": Kind(LINE, lambda inner, props, depth, n=n: f"{'#' * n} {inner.strip()}\n\n") for n in range(1, 7)},
    **{tag: Kind(BLOCKS, lambda inner, props, depth: f"{inner}\n", deepens=1) for tag in ("ul", "ol")},
    "p": Kind(LINE, lambda inner, props, depth: _ended(inner.strip())),
    "li": Kind(BLOCKS, _as_is, deepens=1),
    "item text": Kind(LINE, _item),
    **{tag: Kind(PLAIN, lambda inner, props, depth: _ended(inner.strip("\n"), "```\n", "\n```\n\n")) for tag in ("pre", "codeblock")},
    "named codeblock": Kind(NOTHING, lambda inner, props, depth: CODE_NOTE.format(props["id"])),
    "blockquote": Kind(BLOCKS, _quote),
    "exercise": Kind(BLOCKS, _exercise),
    "choice": Kind(BLOCKS, lambda inner, props, depth: CHOICE_NOTE + inner),
    "slides": Kind(NOTHING, lambda inner, props, depth: SLIDES_NOTE.format(props["source"]) if props.get("source") else ""),
    "img": Kind(NOTHING, partial(_picture, "\n\n")),
}
KINDS = {LINE: IN_LINE, BLOCKS: AS_BLOCKS, PLAIN: {}}


class Open(NamedTuple):
    """An element that is being written: its parts so far, and what is still to come, the next one last."""

    finish: Callable[[str], str]
    parts: list[str]
    coming: list[tuple[Any, str, int]]


def _mapping(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def _leaf(node: Any, view: str) -> str | None:
    """What a node without children is in a view; None for an element."""
    if isinstance(node, str):
        return node if view == PLAIN else ""
    if not isinstance(node, dict):
        return ""
    if node.get("type") != "text":
        return None
    value = str(node.get("value") or "")
    return "" if view == BLOCKS and not value.strip() else value


def _opened(node: dict, view: str, depth: int) -> Open:
    props, children = _mapping(node.get("properties")), node.get("children")
    children = children if isinstance(children, list) else []
    tag = node.get("tagName")
    name = "named codeblock" if tag == "codeblock" and props.get("id") else tag
    kind = KINDS[view].get(name) if isinstance(name, str) else None
    kind = kind or Kind(view, _as_is)
    below = depth + 1 if kind.deepens else 0
    coming = [(c, kind.takes, below) for c in children] if kind.takes != NOTHING else []
    if kind is AS_BLOCKS["li"]:
        coming = [({"tagName": "item text", "children": children}, BLOCKS, depth)] + [x for x in coming if isinstance(x[0], dict) and x[0].get("tagName") in ("ul", "ol")]
    return Open(lambda inner: kind.write(inner, props, depth), [], coming[::-1])


def render(root: Any, view: str = BLOCKS) -> str:
    """A tree as blocks of markdown, as a line of it, or as plain text."""
    stack = [Open(str, [], [(root, view, 0)])]
    while True:
        top = stack[-1]
        if top.coming:
            node, seen_as, depth = top.coming.pop()
            found = _leaf(node, seen_as)
            if found is None:
                stack.append(_opened(node, seen_as, depth))
            else:
                top.parts.append(found)
            continue
        written = stack.pop().finish("".join(top.parts))
        if not stack:
            return written
        stack[-1].parts.append(written)


def page_markdown(payload: str | None, title: str | None) -> str | None:
    """A page's data as markdown: its title, its description and its tree; null for what is no JSON object."""
    try:
        page = json.loads(payload or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(page, dict):
        return None
    remark = _mapping(_mapping(_mapping(page.get("result")).get("data")).get("markdownRemark"))
    front = _mapping(remark.get("frontmatter"))
    head = [f"# {front.get('title') or title or ''}", *(str(d) for d in [front.get("description")] if d)]
    body = render({"children": _mapping(remark.get("htmlAst")).get("children")}).strip()
    return "\n\n".join([*head, body]).rstrip() + "\n"


@F.pandas_udf(StringType())
def page_data_to_markdown(payloads: pd.Series, titles: pd.Series) -> pd.Series:
    """page_markdown() of each row."""
    return pd.Series([page_markdown(p, t) for p, t in zip(payloads, titles)], dtype=object)
