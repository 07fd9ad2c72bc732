"""Text expressions: words, slugs, normal forms, token sets, markdown counts. All are Columns, evaluated in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a text of which a short slug is made at first; where these give too few, the whole text follows.
HEAD = 512

#: A Unicode word, as \w is understood where it means letters, marks, digits and the underscore of any script.
WORD = r"[\p{L}\p{M}\p{N}_]+"

#: Words that carry no meaning when labels and descriptions are compared.
MEANING_STOPWORDS = ("a", "an", "and", "as", "by", "can", "concept", "definition", "de", "do", "does", "for", "in", "is", "of", "or", "student", "the", "to", "with")
#: Words that carry no meaning when titles are compared.
TITLE_STOPWORDS = ("a", "an", "and", "com", "de", "do", "da", "das", "dos", "e", "em", "for", "in", "o", "of", "os", "the", "to", "um", "uma", "with")

def _folds(last: int = 0x1FFFF) -> tuple[dict[str, str], dict[str, str]]:
    """Characters that decompose to one character of ASCII beside marks, and those that decompose to several."""
    one, several = {}, {}
    for c in map(chr, range(0x80, last + 1)):
        if ascii_ := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode():
            (one if len(ascii_) == 1 else several)[c] = ascii_
    return one, several


_ONE, _SEVERAL = _folds()


def _class(runs: list[tuple[int, int]]) -> str:
    """A regular expression's class of runs of characters, ranges instead of single ones, which are looked through one by one."""
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def _runs(chars: list[int]) -> list[tuple[int, int]]:
    first = [c for i, c in enumerate(chars) if not i or chars[i - 1] != c - 1]
    last = [c for i, c in enumerate(chars) if i + 1 == len(chars) or chars[i + 1] != c + 1]
    return list(zip(first, last))


_TELLING = sorted({0x7F, 0x110000, *map(ord, _ONE), *map(ord, _SEVERAL)})
#: Long runs of characters beyond ASCII that decompose to none of ASCII; and those that decompose to several.
_NOTHING = _class([(a + 1, b - 1) for a, b in zip(_TELLING, _TELLING[1:]) if b - a > 256])
_WIDE = _class(_runs(sorted(map(ord, _SEVERAL))))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """A text, empty for null."""
    return F.coalesce(col(c), F.lit(""))


def word_count(c: Column | str) -> Column:
    """Unicode words; 0 for null."""
    return F.regexp_count(text(c), F.lit(WORD)).cast("bigint")


def space_word_count(c: Column | str) -> Column:
    """Words between white space; 0 for null."""
    return F.regexp_count(text(c), F.lit(r"\S+")).cast("bigint")


def collapse_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def strip(c: Column | str) -> Column:
    """A text without white space around it; null for null."""
    return F.btrim(col(c), F.lit(" \t\n\r\f\x0b"))


def normalize_text(c: Column | str) -> Column:
    """Line feeds only, no trailing blanks on lines, at most one empty line in a row, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(text(c), r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def normalize_lines(c: Column | str) -> Column:
    """White space collapsed within lines; blank lines dropped."""
    lines = F.transform(F.split(text(c), r"\r\n|\r|\n"), collapse_space)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def fold_accents(c: Column | str) -> Column:
    """A text decomposed (compatibility forms included) and cut to ASCII; 0 characters for letters that don't decompose."""
    c = F.regexp_replace(text(c), f"{_NOTHING}+", "")
    pairs = F.create_map(*(F.lit(x) for kv in _SEVERAL.items() for x in kv))
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x < "\x80", x).otherwise(F.coalesce(F.try_element_at(pairs, x), x))), "")
    wide = F.when(F.regexp_replace(c, r"[\x00-\x7F]+", "").rlike(_WIDE), spread).otherwise(c)
    cut = F.regexp_replace(F.translate(wide, "".join(_ONE), "".join(_ONE.values())), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), cut).otherwise(c)


def _dashes(c: Column, dash: str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", dash), F.lit(dash))


def ascii_slug(c: Column | str, default: str, limit: int = 90) -> Column:
    """Accents folded, lower case, runs of others to dashes, at most limit characters; default if nothing is left.

    Folding goes by characters, so where the first HEAD of a text give limit characters already, those after them change nothing.
    """
    c = text(c)
    head = _dashes(fold_accents(F.left(c, F.lit(HEAD))), "-")
    whole = F.when((F.length(head) >= limit) | (F.length(c) <= HEAD), head).otherwise(_dashes(fold_accents(c), "-"))
    return F.coalesce(F.nullif(F.rtrim(F.left(whole, F.lit(limit)), F.lit("-")), F.lit("")), F.lit(default))


def plain_slug(c: Column | str, default: str = "untitled", dash: str = "-") -> Column:
    """As ascii_slug without folding: an accented letter becomes a dash."""
    return F.coalesce(F.nullif(_dashes(text(c), dash), F.lit("")), F.lit(default))


def concept_text(c: Column | str, fold: bool = True) -> Column:
    """Words of ASCII letters and digits in lower case, one space between; fold first takes accents off."""
    folded = fold_accents(c) if fold else text(c)
    return F.trim(F.regexp_replace(F.lower(folded), r"[^a-z0-9]+", " "))


def meaning_tokens(label: Column | str, description: Column | str) -> Column:
    """The set of telling words of a label and a description."""
    words = F.split(concept_text(F.concat_ws(" ", text(label), text(description))), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*MEANING_STOPWORDS)))


def title_tokens(c: Column | str) -> Column:
    words = F.regexp_extract_all(F.lower(text(c)), F.lit(r"[a-zA-ZÀ-ÖØ-öø-ÿ0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*TITLE_STOPWORDS)))


def overlap_tokens(c: Column | str) -> Column:
    """The set of lower-case words, apostrophes included."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"[\p{L}\p{M}\p{N}_']+"), F.lit(0)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two sets (arrays of distinct values); 0 if either is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def containment(a: Column | str, b: Column | str) -> Column:
    """The part of the smaller set that is in the other; 0 if either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def any_word(c: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words or phrases stands in c between word boundaries."""
    return c.rlike(r"(^|[^a-z0-9_])(" + "|".join(words) + r")([^a-z0-9_]|$)")


def markdown_images(c: Column | str) -> Column:
    return F.regexp_count(text(c), F.lit(r"!\[[^\]]*\]\(")).cast("bigint")


def markdown_links(c: Column | str) -> Column:
    """Links that are no images."""
    return (F.regexp_count(text(c), F.lit(r"\[[^\]]*\]\(")) - F.regexp_count(text(c), F.lit(r"!\[[^\]]*\]\("))).cast("bigint")


def strip_fence(c: Column | str) -> Column:
    """A text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def first_sentence(c: Column | str, limit: int = 280) -> Column:
    return F.left(F.trim(F.split_part(F.regexp_replace(collapse_space(c), r"([.!?]) ", "$1\n"), F.lit("\n"), F.lit(1))), F.lit(limit))


def strip_trailing_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"[),.;]+$", "")


def role_token(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(text(c))), r"[\s-]+", "_")


def split_labels(c: Column | str) -> Column:
    """Labels between semicolons, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text(c), ";"), lambda x: F.trim(x)), lambda x: x != "")


def display_prefix(c: Column | str, default: str = "CG") -> Column:
    """Up to six upper-case letters or digits."""
    cut = F.left(F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]", ""), F.lit(6))
    return F.when(cut == "", default).otherwise(cut)


def clean_cell(c: Column | str) -> Column:
    """A spreadsheet number as text: nothing for null, no fraction for whole numbers."""
    c = col(c)
    return F.when(c.isNull(), "").when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def yaml_scalar(c: Column | str) -> Column:
    """A string as a YAML scalar: quoted where it would be read otherwise."""
    c = col(c)
    plain = c.rlike(r"^[A-Za-z0-9][A-Za-z0-9 _./-]*$") & ~F.lower(c).isin("true", "false", "null", "yes", "no")
    return F.when(c.isNull(), "null").when(plain, c).otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def directory_name(c: Column | str, default: str = "cluster") -> Column:
    """An identifier as a folder's name: other characters than letters, digits, '_', '.' and '-' are one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text(c), r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit(default))


def id_fragment(c: Column | str, default: str = "candidate") -> Column:
    """A part for an identifier: other characters than letters, digits and '_' are one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text(c), r"[^a-zA-Z0-9_]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))
