"""Duplicate notes: exact by body hash, semantic by cosine; and what becomes of them.

Exact groups come out as a star (the first note by path against each other member), so a group of any size costs one
hash aggregation. Semantic candidates share a band of signs of random projections (20 signs, 150 bands: a pair at
cosine 0.92 is missed with a probability of about 5e-5), in place of a cap on pairs per bucket, and a sketch of 128 signs
sorts out most of the others. Equal vectors are one class first, so copies never meet each other in the bands; the join
on bands is a plain equi-join that adaptive execution splits. Classes of up to ``all_pairs_up_to`` rows come out as all
pairs; in larger ones the smallest key stands for all, and ``vector_classes`` gives every row its class.

Defined results: notes with null content have an empty body and equal each other; rows without a usable vector take no
part in the semantic scan; every pair comes once, smaller key first; a limit below 1 counts as 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions.embed import WIDTH, embed, embed_all, embedding
from ..functions.text import strip
from ..session import cut_lineage
from .notes import add_related, merged, merged_into

SIGNS, BANDS, SKETCH = 20, 150, 128
#: The least cosine of semantic duplicates, and that from which they need no word in common.
AT_LEAST, CERTAIN = 0.92, 0.975


def comparable_body(content: Column) -> Column:
    """Without the first front-matter block and the first top heading, LF line ends, trimmed."""
    text = F.coalesce(content, F.lit(""))
    text = F.regexp_replace(text, r"(?s)\A(.*?)(?m:^)---\n.*?\n---\n?", "$1")
    text = F.regexp_replace(text, r"(?s)\A(.*?)(?m:^)#\s+[^\n]+\n+", "$1")
    return strip(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def _stars(hashed: DataFrame) -> DataFrame:
    """left_path, right_path of hashed(path, h): the first path of each hash against each other one."""
    first = hashed.groupBy("h").agg(F.min("path").alias("left_path"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(first, "h").where("path <> left_path").select("left_path", F.col("path").alias("right_path"))


def exact_duplicates(notes: DataFrame) -> DataFrame:
    """left_path, right_path of notes with equal bodies: the first by path against each other one."""
    return _stars(notes.select(F.translate("path", "\\", "/").alias("path"), F.sha2(comparable_body(F.col("content")), 256).alias("h")).distinct())


def shared_words(a: Column, b: Column) -> Column:
    """Do the texts share a word of more than two characters, whatever its case?"""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_\-]{3,}"), F.lit(0))
    return F.arrays_overlap(words(a), words(b))


def _signed(df: DataFrame, width: int) -> DataFrame:
    """id, unit (vector of length 1), bands array<bigint>, s1, s2 (sketch) of the usable rows of (id, vec)."""
    planes = np.random.default_rng(23).standard_normal((width, SIGNS * BANDS)).astype(np.float32)
    powers = (1 << np.arange(SIGNS, dtype=np.int64))[None, None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 1000):
                batch = big.slice(start, 1000)
                x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, width)
                with np.errstate(all="ignore"):
                    ok = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1, initial=0) > 0)
                x = x[ok]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                flat = x.astype(np.float32) @ planes > 0
                keys = (flat.reshape(len(x), BANDS, SIGNS) * powers).sum(axis=2)
                short = np.packbits(flat[:, :SKETCH], axis=1).view(np.int64).reshape(-1, 2)
                lists = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1] if len(a) else 1, dtype=np.int32)[: len(a) + 1]), pa.array(a.ravel(), t))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(ok)), lists(x, pa.float64()), lists(keys, pa.int64()), pa.array(short[:, 0]), pa.array(short[:, 1])],
                    names=["id", "unit", "bands", "s1", "s2"],
                )

    return df.mapInArrow(run, "id string, unit array<double>, bands array<bigint>, s1 bigint, s2 bigint")


def _most_different(at_least: float) -> int:
    """Sketch signs in which a pair of this cosine differs at most, 4.5 standard deviations above the mean."""
    p = float(np.arccos(at_least) / np.pi)
    return int(SKETCH * p + 4.5 * np.sqrt(SKETCH * p * (1 - p)))


def _classes(df: DataFrame, key: str, vector: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep of the usable rows; signed representatives)."""
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == width)).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    member = cut_lineage(rows.groupBy("id").agg(F.min("vec").alias("vec")).select("id", "vec", F.xxhash64("vec").alias("h")), "vectors")
    rep = member.groupBy("h", "vec").agg(F.min("id").alias("rep"))
    signed = cut_lineage(_signed(rep.select(F.col("rep").alias("id"), "vec"), width), "signed")
    of = member.join(rep, ["h", "vec"]).select("id", "rep").join(signed.select(F.col("id").alias("rep")), "rep", "left_semi")
    return cut_lineage(of, "vector-classes"), signed


def _close(signed: DataFrame, at_least: float) -> DataFrame:
    """l < r, score of representatives whose cosine is at least at_least."""
    banded = signed.select("id", "s1", "s2", F.posexplode("bands").alias("band", "bucket"))
    differ = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
    near = (F.col("a.id") < F.col("b.id")) & (differ <= _most_different(at_least))
    pairs = banded.alias("a").join(banded.alias("b"), ["band", "bucket"]).where(near).select(F.col("a.id").alias("l"), F.col("b.id").alias("r")).distinct()
    unit = signed.select("id", "unit")
    both = pairs.join(unit.select(F.col("id").alias("l"), F.col("unit").alias("x")), "l").join(unit.select(F.col("id").alias("r"), F.col("unit").alias("y")), "r")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return both.select("l", "r", dot.alias("score")).where(F.col("score") >= at_least)


def vector_classes(df: DataFrame, key: str, vector: str, width: int, at_least: float = AT_LEAST) -> DataFrame:
    """id, class_id (the smallest id with an equal vector), n_links (other classes with a cosine of at least at_least)."""
    of, signed = _classes(df, key, vector, width)
    ends = _close(signed, at_least).select(F.explode(F.array("l", "r")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return of.join(ends, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def semantic_duplicates(df: DataFrame, key: str, vector: str, width: int, at_least: float = AT_LEAST, all_pairs_up_to: int = 50) -> DataFrame:
    """left_id < right_id, score (rounded to 4 decimals) of rows whose vectors have a cosine of at least at_least."""
    of, signed = _classes(df, key, vector, width)
    close = _close(signed, at_least)
    size = of.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    large = size.where(F.col("n") > all_pairs_up_to).select("rep")
    # copies of one vector: all pairs in small classes, pairs with the smallest id in large ones
    spread = of.join(large.withColumn("large", F.lit(True)), "rep", "left").where("large IS NULL OR id = rep").select("id", "rep")
    a, b = spread.select(F.col("rep").alias("l"), F.col("id").alias("i")), spread.select(F.col("rep").alias("r"), F.col("id").alias("j"))
    across = close.join(a, "l").join(b, "r").select("i", "j", "score")
    small = spread.join(size.where(F.col("n") <= all_pairs_up_to).select("rep"), "rep", "left_semi")
    within = small.select("rep", F.col("id").alias("i")).join(small.select("rep", F.col("id").alias("j")), "rep").where("i < j").select("i", "j", F.lit(1.0).alias("score"))
    star = of.join(large, "rep", "left_semi").where("id <> rep").select(F.col("rep").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("score"))
    out = across.unionByName(within).unionByName(star)
    return out.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"), F.round("score", 4).alias("score")).distinct()


#: The scan for the best pairs begins at a high cosine, with (cosine, signs of a band, bands), and goes on only where these
#: give fewer pairs than are asked for. Few notes are searched at the least cosine at once.
STAGES, AT_ONCE = ((0.9999, 64, 8), (0.98, 24, 44)), 20_000
#: Keys up to so many are sent to every task; more are joined by a shuffle.
SENT_UP_TO = 100_000
#: As focus: the first note that has an exact duplicate.
FIRST = object()


def _picked(rows: DataFrame, keys: DataFrame, name: str, how: str = "left_semi") -> DataFrame:
    """rows that have one of the keys (written before), by a shuffle of the rows only if the keys are many."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT_UP_TO else keys, name, how)


def _plain(docs: DataFrame) -> DataFrame:
    """path, title, body, h (hash of the comparable body) of docs(path, title, content): the least title and content of each path."""
    plain = F.regexp_replace(F.translate("path", "\\", "/"), r"^\./", "")
    rows = docs.where("path IS NOT NULL").select(plain.alias("path"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    rows = rows.withColumn("k", F.xxhash64("path"))
    several = cut_lineage(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "several")
    least = lambda df: df.groupBy("path").agg(F.min(F.struct("title", "content")).alias("n")).select("path", "n.*")
    if several.count() <= SENT_UP_TO:  # the texts of paths with one row stay where they are
        one = _picked(rows, several, "k", "left_anti").drop("k").unionByName(least(_picked(rows, several, "k")))
    else:
        one = least(rows)
    strict = comparable_body(F.col("content"))
    body = strip(F.regexp_replace(strict, r"[\s\x{A0}]+", " "))
    return one.select("path", "title", body.alias("body"), F.unhex(F.sha2(strict, 256)).alias("h"))


def _signed_notes(notes: DataFrame, signs: int, bands: int) -> DataFrame:
    """path, h, t (hash of title and body), v (hash of the vector, null if it is not usable), s1, s2 (sketch), bands of the notes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(23)
        sketch = random.standard_normal((WIDTH, SKETCH)).astype(np.float32)
        planes = random.standard_normal((WIDTH, signs * bands)).astype(np.float32)
        of_band = np.arange(bands, dtype=np.uint64) << np.uint64(signs) if signs + bands.bit_length() < 64 else np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for big in batches:
            for start in range(0, big.num_rows, 1000):
                batch = big.slice(start, 1000)
                x = embed_all(batch.column("text").to_pylist()) + 0.0  # no negative zeros
                y = x.astype(np.float32)
                bits = (y @ planes > 0).reshape(len(x), bands, signs)
                packed = np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, 64 - signs))), axis=2, bitorder="little").view(np.uint64).reshape(len(x), bands)
                keys = (packed ^ of_band).view(np.int64)
                short = np.packbits(y @ sketch > 0, axis=1).view(np.int64).reshape(-1, 2)
                v = [hashlib.md5(row.tobytes()).digest() if row.any() else None for row in x]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("path", "h", "t")), pa.array(v, pa.binary()), pa.array(short[:, 0]), pa.array(short[:, 1]), lists], names=["path", "h", "t", "v", "s1", "s2", "bands"]
                )

    texts = notes.select("path", "h", F.xxhash64("title", "body").alias("t"), F.concat("title", F.lit("\n"), "body").alias("text"))
    return cut_lineage(texts.mapInArrow(run, "path string, h binary, t bigint, v binary, s1 bigint, s2 bigint, bands array<bigint>"), "signed-notes")


def _near_notes(notes: DataFrame, signed: DataFrame, at_least: float, limit: int | None) -> DataFrame:
    """left_path, right_path, score of pairs with a cosine of at least at_least: all of them, or those among the first
    ``limit`` of a score by path, to which each class of equal texts gives its first limit + 1 notes at most."""
    usable = signed.where("v IS NOT NULL")
    rep = cut_lineage(usable.groupBy("v").agg(F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("s1", "s2", "bands"))), "representatives")
    banded = rep.select("v", "s1", "s2", F.explode("bands").alias("bucket"))
    differ = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
    near = (F.col("a.v") < F.col("b.v")) & (differ <= _most_different(at_least))
    pairs = cut_lineage(banded.alias("a").join(banded.alias("b"), "bucket").where(near).select(F.col("a.v").alias("l"), F.col("b.v").alias("r")).distinct(), "candidates")
    ends = cut_lineage(rep.select("v", "path").join(pairs.select(F.explode(F.array("l", "r")).alias("v")).distinct(), "v", "left_semi"), "ends")
    units = _picked(notes, ends.select("path"), "path").select("path", embedding(F.concat("title", F.lit("\n"), "body")).alias("unit"))
    units = cut_lineage(units.join(ends, "path").select("v", "unit"), "units")
    both = pairs.join(units.select(F.col("v").alias("l"), F.col("unit").alias("x")), "l").join(units.select(F.col("v").alias("r"), F.col("unit").alias("y")), "r")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    close = cut_lineage(both.select("l", "r", dot.alias("score")).where(F.col("score") >= at_least), "close")
    member = usable.select("path", "v", "t")

    def first(*of: str) -> DataFrame:
        ranked = member.withColumn("_n", F.row_number().over(Window.partitionBy(*of).orderBy("path")))
        return (member if limit is None else ranked.where(F.col("_n") <= limit + 1)).select("path", "v")

    a, b = first("v", "t").select(F.col("v").alias("l"), F.col("path").alias("i")), first("v", "t").select(F.col("v").alias("r"), F.col("path").alias("j"))
    across = close.join(a, "l").join(b, "r").select("i", "j", "score")
    equal = first("v")
    within = equal.select("v", F.col("path").alias("i")).join(equal.select("v", F.col("path").alias("j")), "v").where("i < j").select("i", "j", F.lit(1.0).alias("score"))
    return across.unionByName(within).select(F.least("i", "j").alias("left_path"), F.greatest("i", "j").alias("right_path"), F.round("score", 4).alias("score"))


def _near_note(notes: DataFrame, focus: str, at_least: float) -> DataFrame:
    """left_path, right_path, score of the note of a path with every other one: one pass over the notes."""
    one = notes.where(F.col("path") == focus).select("title", "body").first()
    vector = np.asarray(embed(f"{one.title}\n{one.body}")) if one else np.zeros(WIDTH)

    @pandas_udf("double")
    def cosine_to(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.concatenate([embed_all(list(batch[i : i + 1000])) @ vector for i in range(0, len(batch), 1000)]) if len(batch) else [], dtype="float64")

    score = cosine_to(F.concat("title", F.lit("\n"), "body"))
    words = shared_words(F.col("title"), F.lit(one.title if one else "")) | shared_words(F.col("body"), F.lit(one.body if one else ""))
    found = notes.where(F.col("path") != focus).withColumn("score", score).where(F.col("score") >= at_least).where((F.round("score", 4) >= CERTAIN) | words)
    return found.select(F.least("path", F.lit(focus)).alias("left_path"), F.greatest("path", F.lit(focus)).alias("right_path"), F.round("score", 4).alias("score"))


def _with_words(notes: DataFrame, near: DataFrame) -> DataFrame:
    """Of near pairs those that are certain or share a word of more than two characters in their titles or their bodies."""
    unsure = cut_lineage(near.where(F.col("score") < CERTAIN), "unsure")
    paths = cut_lineage(unsure.select(F.explode(F.array("left_path", "right_path")).alias("path")).distinct(), "unsure-paths")
    texts = cut_lineage(_picked(notes, paths, "path").select("path", "title", "body"), "unsure-texts")
    l = texts.select(F.col("path").alias("left_path"), F.col("title").alias("lt"), F.col("body").alias("lb"))  # noqa: E741
    r = texts.select(F.col("path").alias("right_path"), F.col("title").alias("rt"), F.col("body").alias("rb"))
    alike = shared_words(F.col("lt"), F.col("rt")) | shared_words(F.col("lb"), F.col("rb"))
    return near.where(F.col("score") >= CERTAIN).unionByName(unsure.join(l, "left_path").join(r, "right_path").where(alike).select("left_path", "right_path", "score"))


def scan(docs: DataFrame, agent: str | None = None, focus: str | object | None = None, limit: int | None = 25, at_least: float = AT_LEAST, semantic: bool = True, at_once: int = AT_ONCE) -> DataFrame:
    """left_path, right_path, kind, score of docs(path, agent_id, title, content): exact pairs, then semantic ones, the best first.

    Semantic pairs below CERTAIN share a word of more than two characters in their titles or their bodies.
    focus: only pairs with this path, or with that of the first note that has an exact duplicate (FIRST). limit: None for all.
    """
    docs = docs if agent is None else docs.where(F.col("agent_id") == agent)
    notes = _plain(docs)
    limit = None if limit is None else max(1, limit)
    keys = ["left_path", "right_path"]
    pairs = lambda hashed: _stars(hashed.select("path", "h")).select(*keys, F.lit("exact").alias("kind"), F.lit(1.0).alias("score"))
    merge = lambda exact, near: exact.unionByName(near.join(exact, keys, "left_anti").select(*keys, F.lit("semantic").alias("kind"), "score"))
    best = lambda found: found.orderBy(F.desc("score"), *keys) if limit is None else found.orderBy(F.desc("score"), *keys).limit(limit)
    if focus is not None:
        exact = pairs(cut_lineage(notes.select("path", "h"), "hashed"))
        if focus is FIRST:
            focus = exact.agg(F.min("left_path")).first()[0]
        exact = cut_lineage(exact.where((F.col("left_path") == focus) | (F.col("right_path") == focus)), "exact")
        return best(merge(exact, _near_note(notes, focus, at_least)) if semantic and focus is not None else exact)
    if not semantic:
        return best(pairs(cut_lineage(notes.select("path", "h"), "hashed")))
    early = [] if limit is None or docs.count() <= at_once else [s for s in STAGES if s[0] > at_least]
    for least, signs, bands in [*early, (at_least, SIGNS, BANDS)]:
        signed = _signed_notes(notes, signs, bands)
        near = _near_notes(notes, signed, least, limit)
        near = near if least >= CERTAIN else _with_words(notes, near)
        found = merge(pairs(signed), near)
        if least == at_least:
            return best(found)
        # all pairs are known whose rounded score is above the stage's cosine
        top = cut_lineage(best(found.where(F.col("score") > least)), "best")
        if top.count() >= limit:
            return best(top)


ACTIONS = ("merge", "link", "ignore")


def resolve(docs: DataFrame, pairs: DataFrame, action: str) -> DataFrame:
    """path, content of the notes that change when pairs(left_path, right_path) of docs(path, title, content) are resolved.

    link: each note gets a low-priority link to the other; ignore: the left one does; merge: the left one gets the body of
    the right as well, and the right a note of where it went. A pair that names a path twice or one that is not there fails
    the job; a note in several pairs is changed by the first of them, by path.
    """
    if action not in ACTIONS:
        raise ValueError(f"action must be one of {', '.join(ACTIONS)}")
    side = lambda s: docs.select(F.col("path").alias(f"{s}_path"), F.coalesce("title", F.lit("")).alias(f"{s}_title"), F.coalesce("content", F.lit("")).alias(f"{s}_content"))
    both = pairs.select("left_path", "right_path").join(side("left"), "left_path", "left").join(side("right"), "right_path", "left")
    bad = (F.col("left_path") == F.col("right_path")) | F.col("left_content").isNull() | F.col("right_content").isNull()
    both = both.withColumn("left_path", F.when(bad, F.raise_error(F.lit("a pair needs two different notes that exist"))).otherwise(F.col("left_path")))
    left, right = add_related(F.col("left_content"), F.col("right_title")), add_related(F.col("right_content"), F.col("left_title"))
    if action == "merge":
        left = merged(left, F.col("right_title"), comparable_body(F.col("right_content")))
        right = merged_into(right, F.col("left_title"))
    one = F.struct(F.col("left_path").alias("path"), left.alias("content"))
    two = F.struct(F.col("right_path").alias("path"), right.alias("content"))
    changed = both.select("left_path", "right_path", F.explode(F.array(one) if action == "ignore" else F.array(one, two)).alias("c"))
    return changed.groupBy("c.path").agg(F.min_by("c.content", F.struct("left_path", "right_path")).alias("content"))
