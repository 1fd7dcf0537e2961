r"""Sentence boundaries across languages and scripts (problem 8).

Method: everything is SQL expressions over one text column. Full stops that end nothing - decimals, URLs, initials,
abbreviations, and whatever stands inside code spans, links, brackets and quotations - are masked by private-use
characters, one for one; the masked text is split by terminator patterns of the scripts; and the text is restored from
the places, which the masks have not moved. Separators put in on the way are private-use characters too and do not
count when places are added up.

Steps: line ends and stray private-use characters are neutralized; front matter, fenced code and lines of tags are cut
out as void blocks; headings, list items, quote blocks and paragraphs become blocks with their markers apart; spans and
abbreviations are masked; sentences are split; lengths are added up inside the row. There is no shuffle. Nothing is looked
for within a fixed number of characters or lines, and masks are left out where a block holds no sign they are for.

Defined results: null, empty and blank texts give no sentence; a text of any length is processed whole; repeated rows give
repeated rows; a piece without a letter, digit or symbol is no sentence; an unclosed fence runs to the end of the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, sums_before

SEP, VOID, MARK, HEAD, PROSE = "", "", "", "", ""
CUT, SPAN = "", ""
#: After a quotation that ends in a terminator: introduced by a colon, amid a sentence, at its start (cased script or not).
END_COLON, END_MID, END_CASED, END_OTHER = "", "", "", ""
#: Characters that may end a sentence, and the placeholders that stand for them while they do not.
STOPS = ".!?。！？…।؟;；．｡;॥"
MASKS = "".join(chr(0xE010 + i) for i in range(len(STOPS)))
DOT, ASKS = MASKS[0], "\ue030"
CLOSE = "\\)\\]\\}\"'”’»›」』）】\\*_"
BLANK = " \\t\\x{A0}\\x{3000}"
#: White space of Unicode and the byte order mark.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

FRONT = r"\A\x{FEFF}?---[ \t]*\n(?:[\s\S]*?\n)??---[ \t]*(?=\n|\z)"
FENCE = r"(?m)^\x{FEFF}?[ ]{0,3}(`{3,}|~{3,})[^\n]*(?:\n(?:[\s\S]*?\n)??[ ]{0,3}\1[`~]*[ \t]*(?=\n|\z)|[\s\S]*\z)"
TAGS = r"(?m)^[ \t\x{FEFF}]*(?:#[^\s#\x{E000}-\x{E00F}]+[ \t]*)+$"
HEADING = r"(?m)^([ \t\x{FEFF}]{0,4}#{1,6}[ \t]+)([^\n]*?)([ \t]+#+[ \t]*|[ \t]*)$"
#: A numbered item; only in paragraphs that begin with one, or from an item numbered 1 on.
ITEM = r"(?m)^([ \t\x{FEFF}]*\d{1,9}[.)][ \t]+(?:\[[ xX]\][ \t]+)?)"
ITEM_ONE = r"(?s)\A(.*?)(?m:^)(?=[ \t\x{FEFF}]*1[.)][ \t])"
BULLET = r"(?m)^([ \t\x{FEFF}]*[-*+•][ \t]+(?:\[[ xX]\][ \t]+)?)"
RULE = r"(?m)^[ \t]*(?:[-*_=][ \t]*){3,}$"

_IN = r"\x{E000}-\x{E00F}"
SPANS = r"(?=[`\[(（【hfw])(?:" + "|".join(
    (
        rf"`[^`{_IN}]+`",
        rf"\[\[[^\]{_IN}]*\]\]",
        rf"\[[^\[\]{_IN}]*\]\([^()\s{_IN}]*\)",
        r"(?:https?|ftp)://[!-~]*[A-Za-z0-9/=#&_\-]",
        r"www\.[!-~]*[A-Za-z0-9/=#&_\-]",
        rf"\([^(){_IN}]*+(?:\([^(){_IN}]*+\)[^(){_IN}]*+)*+\)",
        rf"（[^（）{_IN}]*+）",
        rf"【[^【】{_IN}]*+】",
        rf"\[[^\[\]{_IN}]*+\]",
    )
) + ")"
#: One of these is in each span.
SPAN_SIGNS = ("`", "[", "(", "（", "【", "://", "www.")
QUOTE = "|".join(
    (
        rf"“[^“”„{_IN}]*+”",
        rf"„[^“”„{_IN}]*+[“”]",
        rf"«[^«»{_IN}]*+»",
        rf"»(?=\p{{L}})[^«»{_IN}]*+«",
        rf"「[^「」{_IN}]*+」",
        rf"『[^『』{_IN}]*+』",
        rf"‘[^‘’{_IN}]*+’(?!\p{{L}})",
        rf"\"(?<![\p{{L}}\p{{N}}]\")(?=\S)[^\"{_IN}]*+\"",
    )
)

#: Abbreviations whose full stop does not end a sentence, by what has to follow.
TITLES = (
    "Dr|Mr|Mrs|Ms|Prof|Rev|Gen|Sen|Rep|Capt|Lt|Col|St|Jr|Sr|Sra|Srta|Dra|Dres|Lic|Ing|Hr|Fr|Frl|Mlle|Mme|MM|Mgr|Me|"
    "Проф|проф|акад|Акад|доц|Др|гр|тов|г-н|г-жа|δρ|Δρ|κ|κα|Κ|Κα|καθ|डॉ|श्री|श्रीमती|प्रो|कु|पं|د|أ|م|ص|"
    "EE|UU|vs|cf|Cf|approx|ca|Ca|viz|esp|incl|excl|resp|bzw|vgl|Vgl|sog|inkl|evtl|ggf|Nr|Abs|Abb|Bd|"
    "Fig|fig|Figs|No|Nos|no|nos|Vol|vol|Ch|ch|Sec|sec|Eq|eq|pp|p|pág|págs|Pág|pag|fl|núm|n|nº|art|Art|cap|Cap|"
    "стр|Стр|см|См|рис|Рис|гл|Гл|табл|ул|им|ср|Ср|напр|руб|млн|млрд|тыс|σελ|Σελ|αρ|Αρ|δηλ|βλ|Βλ|πρβλ|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|ene|abr|ago|dic|janv|févr|juil|déc|Okt|Dez|Mrz|fev|set|out|dez"
)
#: Abbreviations of several parts; every full stop in them is masked.
PARTS = (
    r"[eE]\._g\.", r"[iI]\._e\.", r"p\._(?:ex|ej)\.", r"[zZ]\._B\.", r"[dD]\._h\.", r"[uU]\._a\.", r"[oO]\._ä\.", r"[uU]\._U\.",
    r"[iI]\._d\._R\.", r"[sS]\._o\.", r"[vV]\._a\.", r"т\._(?:е|н|к|ч)\.", r"т\._(?=[дп](?!\p{L}))", r"[дп]\._р\.", r"др\.(?=\s+\p{Ll})",
    r"π\._χ\.", r"κ\._ά\.(?=\s+\p{Ll})", r"μ\._Χ\.", r"π\._Χ\.", r"मि\._से\.", r"कि\._मी\.", r"ई\._पू\.", r"[ap]\._m\.(?=\s+[^\p{Lu}\s])",
    r"ق\._م\.", r"n\._[ºª]", r"(?:\p{Lu}\.){2,}(?=\s|-)", r"(?:U\._S|U\._N)\.(?=\s)",
)
_WORD = r"\p{L}\p{M}\p{N}"
_LETTER = rf"(?<![{_WORD}])"


def _either_form(pattern: str) -> str:
    """The alternatives of a pattern with composed and with decomposed accents."""
    forms = [unicodedata.normalize(f, pattern) for f in ("NFC", "NFD")]
    return "|".join(dict.fromkeys(forms))


#: Words after which a number with a full stop is a German ordinal, and month names.
ORDINAL = (
    rf"{_LETTER}((?:[Aa]m|[Dd]er|[Dd]ie|[Dd]as|[Dd]en|[Dd]em|[Dd]es|[Vv]om|[Zz]um|[Zz]ur|[Ii]m|[Bb]eim|[Ss]eit|[Aa]b|[Bb]is|[Vv]or|[Nn]ach|[Uu]nd)"
    r"\s+\d{1,4})\.(?=\s+\p{Lu})"
)
MONTH = rf"(?<={_LETTER}\d{{1,2}}\.)(?=\s+(?:Januar|Februar|März|{unicodedata.normalize('NFD', 'März')}|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember))"
YEAR = r"(\d\s*+г)\.(?=\s+[^\p{Lu}\s])"
INITIAL = rf"(?=\s)(?<={_LETTER}\p{{Lu}}\.)"
#: Words that go on with a sentence after a quotation inside it.
GOES_ON = (
    "and|or|but|then|so|yet|as|if|in|on|at|to|of|by|for|from|with|before|after|because|when|while|which|who|that|he|she|it|they|we|"
    "said|says|asked|wrote|replied|is|was|und|oder|aber|sagte|fragte|et|ou|mais|dit|y|o|pero|dijo|e|mas|disse|и|но|а|или"
)


def _each(c: Column, f: Callable[[Column], Column]) -> Column:
    """f over the parts between separators, joined again."""
    return F.array_join(F.transform(F.split(c, SEP), f), SEP)


def _rest(c: Column) -> Column:
    return F.substring(c, 2, 1 << 30)


def _void(c: Column, pattern: str) -> Column:
    """What the pattern matches becomes a void block whose characters are neutral."""
    blank = lambda p: F.when(p.startswith(VOID), F.concat(F.lit(VOID), F.regexp_replace(_rest(p), r"[\s\S]", "x"))).otherwise(p)
    cut = F.regexp_replace(c, pattern, f"{SEP}{VOID}$0{SEP}{PROSE}")
    return let(cut, lambda t: F.when(t.contains(VOID), _each(t, blank)).otherwise(t))


def _items(p: Column) -> Column:
    """A paragraph with its numbered items as blocks."""
    cut = lambda x: F.regexp_replace(x, ITEM, f"{SEP}{MARK}$1{SEP}{PROSE}")
    start = F.length(F.regexp_extract(p, ITEM_ONE, 1))
    later = F.concat(F.substring(p, F.lit(1), start), cut(F.substring(p, start + 1, F.length(p))))
    return F.when(~p.rlike(ITEM), p).when(p.rlike(rf"\A{PROSE}?[\s\x{{FEFF}}]*+\d{{1,9}}[.)][ \t]"), cut(p)).when(p.rlike(ITEM_ONE), later).otherwise(p)


def blocks(text: Column) -> Column:
    """The text with separators before blocks and their markers, each followed by the block's kind."""

    def quotes(t: Column) -> Column:
        # a quote block begins where a line without its mark goes before; then the marks are blanks
        t = F.regexp_replace(t, r"(?m)^(?![ \t]{0,3}>)([ \t]*+[^\s>][^\n]*+\n)(?=[ \t]{0,3}>)", f"$1{SEP}{PROSE}")
        for _ in range(3):
            t = F.regexp_replace(t, rf"(?m)^([ \t\x{{FEFF}}]*|{SEP}{PROSE}[ \t]*)>", "$1 ")
        return t

    t = F.regexp_replace(text, r"[\x{E000}-\x{E0FF}]", "x")
    t = let(t, lambda t: F.when(t.contains("\r"), F.translate(F.regexp_replace(t, r"\r(?=\n)", " "), "\r", "\n")).otherwise(t))
    t = let(t, lambda t: F.when(t.startswith("---") | t.startswith("\ufeff---"), _void(t, FRONT)).otherwise(t))
    t = let(t, lambda t: F.when(t.contains("```") | t.contains("~~~"), _void(t, FENCE)).otherwise(t))
    t = let(t, lambda t: F.when(t.contains("#"), _void(t, TAGS)).otherwise(t))
    t = _void(t, RULE)
    t = let(t, lambda t: F.when(t.contains(">"), quotes(t)).otherwise(t))
    t = let(t, lambda t: F.when(t.contains("#"), F.regexp_replace(t, HEADING, f"{SEP}{MARK}$1{SEP}{HEAD}$2{SEP}{MARK}$3{SEP}{PROSE}")).otherwise(t))
    t = _each(F.regexp_replace(t, rf"\n[{BLANK}]*+(?=\n)", f"$0{SEP}{PROSE}"), _items)
    return F.regexp_replace(t, BULLET, f"{SEP}{MARK}$1{SEP}{PROSE}")


def _mask(c: Column) -> Column:
    return F.translate(c, STOPS, MASKS)


def _masked(c: Column, pattern: str, mask: Callable[[Column], Column]) -> Column:
    """c with the mask over what the pattern matches."""
    cut = F.regexp_replace(c, pattern, f"{CUT}{SPAN}$0{CUT}")
    one = lambda s: F.when(s.startswith(SPAN), mask(_rest(s))).otherwise(s)
    return let(cut, lambda t: F.when(t.contains(CUT), F.array_join(F.transform(F.split(t, CUT), one), "")).otherwise(t))


def mask_spans(c: Column) -> Column:
    """No terminator in code spans, links, URLs and brackets."""
    return _masked(c, SPANS, _mask)


def mask_words(c: Column) -> Column:
    """No terminator in decimals, file names, initials, ordinals and abbreviations."""
    parts = _either_form("|".join(PARTS).replace("_", r"\s*+"))
    short = rf"{_LETTER}(?=[\p{{L}}\p{{M}}]{{1,5}}\.)(?:{parts})"
    c = _masked(c, short, lambda s: F.translate(s, ".", DOT))
    title = rf"(?=[\s{DOT}])(?<={_LETTER}(?:{_either_form(TITLES)})\.)"
    c = F.regexp_replace(c, rf"\.(?:(?=[\d\p{{Ll}}\-_/\\@])|{title}|{MONTH}|{INITIAL})", DOT)
    c = let(c, lambda t: F.when(t.rlike(r"\d\.\s"), F.regexp_replace(t, ORDINAL, f"$1{DOT}")).otherwise(t))
    return let(c, lambda t: F.when(t.contains("г."), F.regexp_replace(t, YEAR, f"$1{DOT}")).otherwise(t))


def mask_quotes(c: Column) -> Column:
    """No terminator in quotations; those that end in one are followed by a sign of how they stand."""
    tagged = F.regexp_replace(c, rf"(?=[“„«»「『‘\"])(?:{QUOTE})", f"{CUT}{SPAN}$0{CUT}")

    def all_(parts: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            ends = s.rlike(rf"[{STOPS.replace('.', chr(92) + '.')}][\s\x{{A0}}]*[”“»«」』’\"]$")
            uncased = s.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsDevanagari}\p{IsArabic}\p{IsThai}]")
            earlier = F.concat(F.coalesce(F.right(F.get(parts, i - 2), F.lit(1)), F.lit("")), F.get(parts, i - 1))
            before = F.right(F.rtrim(earlier, F.lit(" \t\n\x0b\f\r")), F.lit(1))  # the last character that is not white space
            amid = before.rlike(r"[\p{L}\p{M}\p{N},，、;)\]`’%" + MASKS + "]")
            sign = (
                F.when(~ends, F.lit(""))
                .when(before.isin(":", "："), F.lit(END_COLON))
                .when(uncased, F.lit(END_OTHER))
                .when(amid, F.lit(END_MID))
                .otherwise(F.lit(END_CASED))
            )
            return F.when(s.startswith(SPAN), F.concat(_mask(_rest(s)), sign)).otherwise(s)

        return F.array_join(F.transform(parts, one), "")

    return let(tagged, lambda t: F.when(t.contains(CUT), let(F.split(t, CUT), all_)).otherwise(t))


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def split_prose(c: Column, greek: Column) -> Column:
    """A separator after each sentence of a prose block whose terminators are masked where they end nothing.

    greek: does the block hold Greek letters? There the semicolon is the question mark.
    """
    closers = f"[{CLOSE}]*"
    no_stop = rf"\s*[,;{ASKS}]"
    rules = (
        rf"[。！？｡．॥]+[!?！？。]*{closers}(?!\d)",
        rf"।+{closers}",
        rf"[!?؟\x{{203C}}\x{{2047}}-\x{{2049}}\x{{37E}}]+[!?.]*{closers}(?=\s|$|\p{{Lu}}|¿|¡|«|“|„|[\p{{IsHangul}}\p{{IsArabic}}\p{{IsDevanagari}}])",
        rf"\.(?<!\.\.){closers}(?=\s|$)",
        r"\.(?=\p{Lu}[\p{Ll}\p{M}]|[¿¡«“„`\[]|\p{IsHangul})(?<=[\p{L}\p{M}\p{N}\])”»`]\.)",
        r"\.(?=\p{Lu}[\s.\p{Lu}])(?<=[\p{Ll}\p{Lo}\p{M}\p{N}\])”»`]\.)",
        r"\.(?=\p{IsArabic}{2})(?<=\p{IsArabic}{3}\.)",
        rf"(?:\.\.+|…+){closers}(?=\s+\p{{Lu}})",
        rf"{END_COLON}(?!{no_stop}|\s*[，、)]|\s+(?:{GOES_ON})(?![\p{{L}}.]))",
        rf"{END_MID}(?=\s)(?!\s+(?:{GOES_ON})(?![\p{{L}}.])|{no_stop}|\s*\))",
        rf"{END_CASED}(?=\s+(?:\p{{Lu}}|[`¿¡«“„\"]))",
        rf"{ASKS}{closers}(?=\s|$)",
    )
    marks = rf"[.。！？｡．॥।!?؟\x{{203C}}\x{{2047}}-\x{{2049}}\x{{37E}}…{END_COLON}{END_MID}{END_CASED}{ASKS}]"
    asks = let(c, lambda c: F.when(greek, F.translate(c, ";", ASKS)).otherwise(c))
    return F.regexp_replace(asks, rf"(?={marks})(?:{'|'.join(rules)})", f"$0{SEP}{PROSE}")


def split_thai(c: Column) -> Column:
    """A separator after white space between two Thai letters."""
    blank = r"[ \n\t\x{A0}](?<=\p{IsThai}[ \n\t\x{A0}])[ \n\t\x{A0}]*+(?=\p{IsThai})"
    return F.regexp_replace(c, blank, f"$0{SEP}{PROSE}")


def pieces(text: Column) -> Column:
    """The text cut into pieces, each with its kind in front; private-use signs are taken out again."""

    def prose(c: Column) -> Column:
        plain = _is_ascii(c)
        no_quote = plain & ~c.contains('"')
        spans = reduce(or_, (c.contains(x) for x in SPAN_SIGNS))
        masked = F.when(spans, mask_spans(c)).otherwise(c)
        masked = let(masked, lambda m: F.when(m.contains("."), mask_words(m)).otherwise(m))
        masked = let(masked, lambda m: F.when(no_quote, m).otherwise(mask_quotes(m)))
        done = split_prose(masked, ~plain & c.rlike(r"\p{IsGreek}"))
        return let(done, lambda d: F.when(~plain & c.rlike(r"\p{IsThai}"), split_thai(d)).otherwise(d))

    def one(p: Column) -> Column:
        body = let(F.when(p.startswith(PROSE), _rest(p)).otherwise(p), prose)
        return F.when(p.rlike(f"^[{VOID}{MARK}{HEAD}]"), p).otherwise(F.concat(F.lit(PROSE), body))

    return F.split(F.translate(_each(blocks(text), one), END_COLON + END_MID + END_CASED + END_OTHER, ""), SEP)


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_pos, end_pos of every sentence, in code points counted from 1."""

    def measure(p: Column) -> Column:
        there = (p.startswith(HEAD) | p.startswith(PROSE)) & p.rlike(r"[\p{L}\p{N}\p{S}]")
        inside = lambda left: F.when(F.right(left, F.lit(1)).isin(*WHITE), F.length(F.rtrim(left, F.lit(WHITE)))).otherwise(F.length(left))
        size = let(F.ltrim(_rest(p), F.lit(WHITE)), lambda left: F.struct(F.length(left).alias("left"), inside(left).alias("core")))
        return F.struct((F.length(p) - 1).cast("bigint").alias("n"), F.when(there, size).alias("s"))

    cut = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.transform(pieces(F.col(text)), measure).alias("_m"))
    before = sums_before(F.transform("_m", lambda m: m["n"]))
    placed = cut.select("_k", F.explode(F.arrays_zip(F.col("_m").alias("m"), before.alias("b"))).alias("_s")).where("_s.m.s.core > 0")
    start = F.col("_s.b") + F.col("_s.m.n") - F.col("_s.m.s.left") + 1
    return placed.select(F.col("_k").alias(key), start.cast("bigint").alias("start_pos"), (start + F.col("_s.m.s.core") - 1).cast("bigint").alias("end_pos"))
