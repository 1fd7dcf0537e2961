"""Text expressions shared by the operators, all on the JVM side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the byte order mark; Java's \s is ASCII only.
SPACE = r"\s\x{85}\p{Z}\x{FEFF}"


def strip(c: Column) -> Column:
    """Without outer white space of any script."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_end(c: Column) -> Column:
    """Without white space at the end."""
    return F.regexp_replace(c, f"[{SPACE}]+\\z", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def title_key(c: Column) -> Column:
    """What counts of a cited title: no section or alias part, no outer space, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"(?s)[#|].*$", "")))


def path_key(c: Column) -> Column:
    """A path with forward slashes and without a leading ./"""
    return F.regexp_replace(F.translate(strip(c), "\\", "/"), r"^(?:\./)+", "")


def tag_key(c: Column) -> Column:
    """A tag as it is compared: trimmed, without leading #, lower case."""
    return F.lower(strip(F.regexp_replace(strip(c), "^#+", "")))


def _foldable() -> tuple[str, str]:
    """Letters that decompose into one base character and combining marks, and those bases, by Unicode's rule."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _foldable()
_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)


def fold(c: Column) -> Column:
    """Lower case without diacritics, inside the JVM: precomposed letters by table, combining and spacing marks dropped."""
    bare = F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), "[\\p{Mn}^`¨¯´·¸]", "")
    return F.lower(bare)


def fold_text(s: str) -> str:
    """The same fold for a query string on the driver."""
    if s.isascii():
        return s.translate({94: None, 96: None}).lower()
    s = s.translate(_TABLE)
    return "".join(x for x in s if unicodedata.category(x) != "Mn" and x not in "^`¨¯´·¸").lower()


def slug(c: Column, empty: str) -> Column:
    """Lower-case ASCII letters, digits, _ and - only; other runs become one hyphen; the given word if nothing is left."""
    dashed = F.regexp_replace(F.lower(F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{Mn}", "")), "[^a-z0-9_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit(empty))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, in which note and chunk sizes are limited."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def count_hits(text: Column, token: str) -> Column:
    """How often the token occurs in the text, without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int")


def query_tokens(query: str) -> list[str]:
    """Folded runs of letters, digits, _ and - of a query that are longer than one character; repeats are kept."""
    import regex

    return [t for t in (fold_text(x) for x in regex.findall(r"[\p{L}\p{N}_-]+", query)) if len(t) > 1]
