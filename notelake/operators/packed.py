r"""Several values packed in one field (problem 2).

The grammar, with ordered alternatives tried at each place of the string (first match wins, and a failed alternative is
given back before the next is tried):

    field   <- (value / noise)*
    value   <- quoted / bracketed / bare
    quoted  <- open body close        for each kind of mark; body may hold doubled or backslashed marks
    bracketed <- "(" (value / noise)* ")"    likewise with [ ] and { }: its values are values of the field
    bare    <- sign* alnum (alnum / sign)*   taken whole, so a mark inside a run of letters opens nothing
    malformed quote  <- open          no close follows: the mark is given back as noise and its text is read as bare
    malformed bracket  <- "(" / ")"   without its other half: given back as noise, the values around it stay
    separator, any other character  <- noise

Java's regular expressions are exactly this - ordered choice with backtracking - so the grammar is one pattern and the
work is ``regexp_extract_all`` and ``posexplode`` inside the JVM; brackets come out as tokens, and how deep a value lies is
the balance of those before it. A closing mark must be followed by the end, white space, a separator or a bracket; a
mark that is not closed like that is malformed.

Defined results: a null, empty or blank field, and one without any value, gives no row; repeated values keep their own
places; a quoted value that is blank inside takes no place; ``malformed`` is true on every value of a field in which a
quotation mark had to be given back, ``unbalanced`` where the brackets do not match in number or order (kinds of brackets
are not told apart); then ``bracketed`` goes by the balance alone. Other columns of the input do not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sums_before
from ..functions.text import SPACE, strip

#: Opening and closing quotation marks.
MARKS = (('"', '"'), ("'", "'"), ("`", "`"), ("“", "”"), ("‘", "’"), ("«", "»"), ("„", "“"), ("「", "」"))
OPEN, SHUT = "([{", ")]}"
ALNUM = r"[\p{L}\p{M}\p{N}]"


def signs_of(*tag_columns: DataFrame) -> str:
    """The characters other than letters and digits that occur inside the tags of the given one-column frames.

    What comes back is a set of single characters, bounded by the alphabet and not by the data.
    """
    union = None
    for df in tag_columns:
        one = df.select(F.explode(df.columns[0]).alias("t")).distinct()
        union = one if union is None else union.unionByName(one)
    inner = strip(F.regexp_replace(strip(F.col("t")), "^#+", ""))
    odd = F.regexp_replace(inner, rf"[\p{{L}}\p{{M}}\p{{N}}{SPACE}]", "")
    chars = union.select(F.explode(F.split(odd, "")).alias("c")).where("c <> ''").distinct()
    return "".join(sorted(r["c"] for r in chars.collect()))


def grammar(signs: str) -> str:
    """The pattern of a quoted or bare value, or of noise that is taken whole (runs of signs, marks given back)."""
    inside = re.sub(r"([\\\]\[^&\-])", r"\\\1", signs)
    run = rf"[\p{{L}}\p{{M}}\p{{N}}{inside}]"
    after = rf"(?!{run})"
    quoted = []
    for a, b in MARKS:
        plain, inner = f"[^{a}{b}\\\\]*+", r"\\."
        if a == b:
            inner += f"|{b}{b}"
        if b in "'’":
            inner += f"|(?<={ALNUM}){b}(?={ALNUM})"
        quoted.append(f"{a}{plain}(?:(?:{inner}){plain})*+{b}{after}")
    signs_only = f"|[{inside}]++" if inside else ""
    bare = f"[{inside}]*+{ALNUM}{run}*+" if inside else f"{ALNUM}++"
    marks = "".join(a for a, _ in MARKS)
    brackets = re.sub(r"([\[\]])", r"\\\1", OPEN + SHUT)
    return f"(?s)(?<!{run})(?:{'|'.join(quoted)})|{bare}{signs_only}|[{brackets}]|[{marks}]"


def _is_quoted(c: Column) -> Column:
    out = F.lit(False)
    for a, b in MARKS:
        out = out | (c.startswith(a) & c.endswith(b))
    return out & (F.length(c) > 1)


def unquote(c: Column) -> Column:
    """The text inside the marks as the writer meant it, without outer white space."""
    out = F.when(~_is_quoted(c), c)
    for a, b in MARKS:
        body = c.substr(F.lit(2), F.length(c) - 2)
        body = F.regexp_replace(body, rf"\\([\\{a}])|{a}({a})" if a == b else rf"\\([\\{a}{b}])", "$1$2" if a == b else "$1")
        out = out.when(c.startswith(a), strip(body))
    return out


def unpack(df: DataFrame, key: str, field: str, signs: str) -> DataFrame:
    """One row per value of df.field: key, pos (from 1), tag, quoted, bracketed, malformed, unbalanced."""
    marks = [a for a, _ in MARKS]
    turn = lambda v: F.when(v.isin(*OPEN), 1).when(v.isin(*SHUT), -1).otherwise(0).cast("bigint")
    depth = sums_before(F.transform("found", turn))
    tokens = F.zip_with("found", "depth", lambda v, d: F.struct(v.alias("v"), d.alias("d")))
    real = F.filter(tokens, lambda t: _is_quoted(t["v"]) | t["v"].rlike(ALNUM))
    values = F.transform(real, lambda t: F.struct(unquote(t["v"]).alias("tag"), _is_quoted(t["v"]).alias("quoted"), (t["d"] > 0).alias("bracketed")))
    uneven = F.exists("depth", lambda d: d < 0) | (F.get("depth", F.size("depth") - 1) + turn(F.get("found", F.size("found") - 1)) != 0)
    return (
        df.where(F.col(field).isNotNull())
        .select(F.col(key), F.regexp_extract_all(F.col(field), F.lit(grammar(signs)), F.lit(0)).alias("found"))
        .where(F.size("found") > 0)
        .select(key, "found", depth.alias("depth"))
        .select(
            key,
            F.exists("found", lambda v: v.isin(marks)).alias("malformed"),
            uneven.alias("unbalanced"),
            F.posexplode(F.filter(values, lambda x: x["tag"] != "")).alias("p", "x"),
        )
        .select(key, (F.col("p") + 1).cast("int").alias("pos"), "x.tag", "x.quoted", "x.bracketed", "malformed", "unbalanced")
    )
