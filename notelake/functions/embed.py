"""The deterministic local embedding: hashed word and word-pair features in 192 dimensions.

``embed`` is for one query string on the driver, ``embedding`` for a column (an Arrow UDF used when notes are indexed,
not on the query path). ``cosine`` and ``signature`` stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import fold_text

WIDTH = 192
TOKEN = regex.compile(r"[\p{L}\p{N}_-]+")
#: Words that carry no meaning, and what a word also stands for.
STOP_WORDS = frozenset("a as and ao aos com da das de do dos e em for is o os para por que the to um uma use uses using".split())
ALIASES = {
    "ai": ("agent", "model"),
    "api": ("interface", "client"),
    "auth": ("authentication", "authorization", "identity"),
    "authentication": ("auth", "identity"),
    "backend": ("server", "api"),
    "cli": ("terminal", "command"),
    "context": ("memory", "knowledge"),
    "db": ("database", "storage"),
    "frontend": ("ui", "browser"),
    "jwt": ("token", "auth", "authentication"),
    "llm": ("ai", "agent", "model"),
    "mcp": ("agent", "tool", "integration"),
    "memory": ("context", "knowledge"),
    "nodejs": ("node", "runtime"),
    "test": ("tests", "testing", "validation"),
    "tests": ("test", "testing", "validation"),
    "token": ("jwt", "auth"),
    "ui": ("frontend", "browser"),
}


def features(text: str) -> list[tuple[str, float]]:
    """Words and their aliases at weight 1, neighbouring pairs of that list at 0.65."""
    words = [w for w in (fold_text(x) for x in TOKEN.findall(text)) if len(w) > 1 and w not in STOP_WORDS]
    wide = [x for w in words for x in (w, *ALIASES.get(w, ()))]
    return [(f"t:{w}", 1.0) for w in wide] + [(f"b:{a}:{b}", 0.65) for a, b in zip(wide, wide[1:], strict=False)]


@lru_cache(maxsize=200_000)
def feature_hash(feature: str) -> int:
    """32-bit FNV-1a over code points."""
    h = 2166136261
    for c in feature:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def embed(text: str) -> list[float]:
    """The unit vector of a text; all zero if it has no feature."""
    v = [0.0] * WIDTH
    for name, weight in features(text):
        h = feature_hash(name)
        v[h % WIDTH] += weight if h & 1 else -weight
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def embed_all(texts: list[str]) -> np.ndarray:
    """What ``embed`` gives for each text, row by row, to the last bit; the features are hashed together."""
    names, weights, count = [], [], []
    for text in texts:
        found = features(text)
        names += [name for name, _ in found]
        weights += [weight for _, weight in found]
        count.append(len(found))
    size = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    order = np.argsort(-size, kind="stable")
    start, long_to_short = (np.cumsum(size) - size)[order], size[order]
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.full(len(names), 2166136261, dtype=np.uint64)
    for i in range(int(long_to_short[0]) if len(names) else 0):
        n = int(np.searchsorted(-long_to_short, -i))  # so many are longer than i
        h[:n] = ((h[:n] ^ codes[start[:n] + i]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    hashes = np.empty_like(h)
    hashes[order] = h
    at = np.repeat(np.arange(len(texts)), count) * WIDTH + (hashes % np.uint64(WIDTH)).astype(np.int64)
    signed = np.where(hashes & np.uint64(1) == 1, 1.0, -1.0) * np.asarray(weights, dtype=np.float64)
    out = np.bincount(at, weights=signed, minlength=len(texts) * WIDTH).reshape(-1, WIDTH)
    for v in out:
        norm = math.sqrt(sum(x * x for x in v.tolist()))
        if norm:
            v /= norm
    return out


@pandas_udf(T.ArrayType(T.DoubleType()))
def embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([np.asarray(embed(t)) if t is not None else None for t in batch])


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector over the shorter of both lengths; 0 for null, empty, zero or unusable vectors."""
    n = F.least(F.size(vector), F.lit(len(query)))
    q = F.array(*(F.lit(float(x)) for x in query))
    left, right = F.slice(vector, 1, n), F.slice(q, 1, n)
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    dot = add(F.zip_with(left, right, lambda a, b: a * b))
    norms = F.sqrt(add(F.transform(left, lambda x: x * x))) * F.sqrt(add(F.transform(right, lambda x: x * x)))
    value = dot / F.nullif(norms, F.lit(0.0))
    return F.when(F.size(vector) > 0, F.when(F.isnan(value), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))).otherwise(F.lit(0.0))


def signature(vector: Column, buckets: int = 24) -> Column:
    """The dimensions of largest size, each with its sign: p:i or n:i, by size and then by place."""
    sized = F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("i"), x.alias("x")))
    top = F.slice(F.array_sort(F.filter(sized, lambda s: s["x"] != 0)), 1, buckets)
    return F.transform(top, lambda s: F.concat(F.when(s["x"] >= 0, F.lit("p:")).otherwise(F.lit("n:")), s["i"].cast("string")))
