"""Cutting note texts into chunks of bounded length.

Packing is a left fold over the paragraphs of one note, so it is a small helper run over Arrow batches at index time;
lengths are in UTF-16 units. Everything around it stays in the JVM.

Defined results: null and blank texts give no chunk; a single sentence longer than the limit inside a longer paragraph is
kept whole, a paragraph that is one such sentence is cut into slices; repeated rows of a note give repeated chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.embed import embedding
from .documents import FRONT, stable_id

MAX_CHARACTERS = 1200
#: Fixed value: white space of the limits' pattern.
WHITE = "\t-\r \xa0  -     　﻿"
_TRIM = WHITE.replace("\t-\r", "\t\n\x0b\x0c\r").replace(" - ", "".join(chr(x) for x in range(0x2000, 0x200B)))


def units(s: str) -> int:
    """UTF-16 units."""
    return len(s) + sum(c > "￿" for c in s)


def _slices(paragraph: str, most: int) -> list[str]:
    raw = paragraph.encode("utf-16-le", "surrogatepass")
    cut = (raw[i : i + 2 * most].decode("utf-16-le", "surrogatepass") for i in range(0, len(raw), 2 * most))
    return [c for c in (x.strip(_TRIM).encode("utf-8", "replace").decode() for x in cut) if c]


def _pack(parts: list[str], glue: str, most: int) -> list[str]:
    out: list[list[str]] = []
    size = 0
    for p in parts:
        n = units(p)
        if out and size + len(glue) + n <= most:
            out[-1].append(p)
            size += len(glue) + n
        else:
            out.append([p])
            size = n
    return [glue.join(x) for x in out]


def split_text(text: str, most: int = MAX_CHARACTERS) -> list[str]:
    """The chunks of a note's text without its front matter."""
    lines = "\n".join(line.strip(_TRIM) for line in text.split("\n"))
    whole = re.sub(r"\n{3,}", "\n\n", lines).strip(_TRIM)
    parts: list[str] = []
    for paragraph in filter(None, re.split(r"\n{2,}", whole)):
        if units(paragraph) <= most:
            parts.append(paragraph)
            continue
        found = [s for s in (x.strip(_TRIM) for x in re.split(rf"(?<=[.!?])[{WHITE}]+", paragraph)) if s]
        parts += _slices(paragraph, most) if len(found) <= 1 else _pack(found, " ", most)
    return _pack(parts, "\n\n", most)


def _splitter(most: int):
    @pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([split_text(t, most) if t else [] for t in batch])

    return split


def chunks(docs: DataFrame, most: int = MAX_CHARACTERS, embed: bool = False) -> DataFrame:
    """id, document_id, ordinal, content, token_count of each chunk, with its embedding if asked for."""
    body = F.regexp_replace(F.coalesce("content", F.lit("")), FRONT, "")
    cut = docs.select(F.col("id").alias("document_id"), _splitter(most)(body).alias("parts"))
    each = cut.select("document_id", F.posexplode("parts").alias("ordinal", "content"))
    squeezed = F.trim(F.regexp_replace("content", r"[\s\x{A0}]+", " "))
    key = F.concat_ws(":", "document_id", F.col("ordinal").cast("string"), "content")
    out = each.select(stable_id(key).alias("id"), "document_id", "ordinal", "content", F.ceil(F.length(squeezed) / 4).cast("int").alias("token_count"))
    return out.withColumn("embedding", embedding(F.col("content"))) if embed else out
