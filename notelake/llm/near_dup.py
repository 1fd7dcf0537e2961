"""Near-duplicate records with small edits (problem 4).

Method: DartMinHash. Every element (a word) owns the strip [0, weight) x [0, infinity) of a weight and a rank axis, and hashed
darts fall on the strip at a rate of one per unit of area: their number, places and coordinates follow from the word
alone. A record is hit by the darts that land inside the strips of its words, and its signature keeps, for each of k
coordinates, the earliest dart. Two records agree in a coordinate with a probability equal to their weighted Jaccard
similarity. Signatures are cut into bands; records that agree in a whole band are candidates, and candidates are
checked exactly.

Elements may carry weights (``banded``); the queries here are on plain sets, where every word weighs 1. Records with the
same set of words are one class and are signed once, so copies never meet in the bands. The self-join on bands is one plain
equi-join, both sides of which read the same shuffle: no band is counted, gathered or capped, and a band that holds a third
of all records is split over tasks by adaptive execution; what it costs are the pairs of different texts that agree in a
band, which is what the result consists of. With k = rows x bands = 8 x 96 a pair at similarity s becomes a candidate with
probability 1 - (1 - s^8)^96: 0.9966 at 0.70, 0.9999 at 0.74.

Exact copies come out as all pairs in classes of up to ``all_pairs_up_to`` records. In larger classes the smallest key
stands for all: it is paired with each copy, and with the similar records of other classes. ``groups`` gives every record
its class, so no link between different texts is lost.

Defined results: records with null or blank text take no part; a null title counts as empty; repeated rows of a key count
once; records without a single word take no part; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.graph import components
from ..session import cut_lineage

ROWS, BANDS = 8, 96
#: Bits of the sketch that sorts out most candidates before they are checked (misses 3 in 100,000 pairs at the limit).
SKETCH_BITS = 128
#: Height of the rank levels in which darts are thrown.
STEP = 16.0
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=64)
def _poisson_steps(mean: float) -> np.ndarray:
    """The distribution function of a Poisson number, for drawing it from a uniform one."""
    top = int(mean + 12 * math.sqrt(mean) + 20)
    return np.cumsum([math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(top)])


def _throw(owner, element, weight, first, last, k: int, sig: np.ndarray) -> None:
    """Throw the darts of levels first..last-1 of each element at the signature (flat, k per record)."""
    slabs = np.where(weight <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weight, 1)))).astype(np.int64)
    rep = np.repeat(np.arange(len(owner)), slabs)
    slab = np.arange(len(rep)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    levels = (last - first)[rep]
    at = np.repeat(np.arange(len(rep)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels) + first[rep[at]]
    slab, who = slab[at], rep[at]
    low = np.where(slab == 0, 0.0, 2.0 ** (slab - 1.0))
    wide = np.where(slab == 0, 1.0, low)
    seed = mix(mix(element[who] ^ (slab.astype(np.uint64) << np.uint64(48))) + level.astype(np.uint64))
    u = (seed >> np.uint64(11)).astype(np.float64) / 2.0**53
    darts = np.zeros(len(seed), dtype=np.int64)
    for s in np.unique(slab):
        here = slab == s
        darts[here] = np.searchsorted(_poisson_steps(STEP * (1.0 if s == 0 else 2.0 ** (s - 1))), u[here])
    at = np.repeat(np.arange(len(seed)), darts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(seed[at] + nth.astype(np.uint64) * M1)
    if slab.any() or (weight < 1).any():  # a dart above the weight misses
        y = low[at] + wide[at] * ((mix(dart ^ M2) >> np.uint64(11)).astype(np.float64) / 2.0**53)
        hit = y < weight[who[at]]
        at, dart = at[hit], dart[hit]
    # rank in the high bits, so that the smallest value is the earliest dart
    rank = (level[at].astype(np.uint64) << np.uint64(44)) | (dart >> np.uint64(20))
    column = ((dart & np.uint64(0xFFFFF)) * np.uint64(k) >> np.uint64(20)).astype(np.int64)  # from the bits that the rank leaves
    np.minimum.at(sig, owner[who[at]] * k + column, rank)


def signatures(element: np.ndarray, weight: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """k earliest darts of each record; record i has the elements ends[i]:ends[i + 1], at least one."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    total = np.bincount(owner, weights=weight, minlength=n)
    sig = np.full(n * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    done = np.zeros(n, dtype=np.int64)
    to = np.ceil((k * math.log(k) + 2 * k) / total / STEP).astype(np.int64)
    open_ = np.ones(n, dtype=bool)
    while open_.any():
        e = open_[owner]
        _throw(owner[e], element[e], weight[e], done[owner[e]], to[owner[e]], k, sig)
        open_ = (sig.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        done, to = to, to + np.maximum(1, to // 4)
    return sig.reshape(n, k)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of so many signature values; bands have keys of their own."""
    parts = sig.reshape(len(sig), -1, rows)
    key = np.broadcast_to(mix(np.arange(parts.shape[1], dtype=np.uint64)), parts.shape[:2])
    for i in range(rows):
        key = mix(key ^ parts[:, :, i])
    return key.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two 64-bit words of one bit each of SKETCH_BITS values; two records differ in a bit with probability (1 - s) / 2."""
    bits = (sig[:, :: sig.shape[1] // SKETCH_BITS][:, :SKETCH_BITS] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def most_different(at_least: float) -> int:
    """Sketch bits in which a pair of this similarity differs at most, 4.5 standard deviations above the mean."""
    p = (1 - at_least) / 2
    return math.floor(SKETCH_BITS * p + 4.5 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def words(*texts: Column) -> Column:
    """The distinct lower-case runs of letters, digits, _ and - of the texts together, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(r"[\p{L}\p{N}_\-]+"), F.lit(0))))


def banded(df: DataFrame, key: str, elements: str, weights: str | None = None, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """key, bucket, s1, s2: one row per band of each record, with its sketch.

    elements is an array of distinct 64-bit hashes, weights an array of as many positive numbers (1 each if there is none).
    Records without an element, and those in which a weight is missing, null or not a positive number, take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 128):  # bounds the darts in memory
                batch = big.slice(start, 128)
                lists = batch.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                weight = np.ones(len(flat)) if weights is None else batch.column(2).flatten().to_numpy(zero_copy_only=False)
                sig = signatures(flat, weight, ends, rows * bands)
                where = np.repeat(np.arange(batch.num_rows), bands)
                s = sketch(sig)[where]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where)), pa.array(band_keys(sig, rows).ravel()), pa.array(s[:, 0]), pa.array(s[:, 1])],
                    names=[key, "bucket", "s1", "s2"],
                )

    narrow = df.where(F.size(elements) > 0).select(key, elements, *([] if weights is None else [F.col(weights).cast("array<double>").alias("_weights")]))
    if weights is not None:
        narrow = narrow.where((F.size("_weights") == F.size(elements)) & F.forall("_weights", lambda w: (w > 0) & (w < float("inf"))))
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, bucket bigint, s1 bigint, s2 bigint")


def classes(df: DataFrame, key: str, title: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(members, reps): members has key and class_id, reps has class_id and the hashes of the class's words."""
    worded = (
        df.where(F.col(key).isNotNull() & ~is_blank(F.col(content)))
        .select(F.col(key).alias("key"), words(F.coalesce(F.col(title), F.lit("")), F.col(content)).alias("w"))
        .where(F.size("w") > 0)
        .select("key", F.struct(F.xxhash64("w").alias("h1"), F.hash("w").alias("h2"), F.transform("w", lambda x: F.xxhash64(x)).alias("e")).alias("s"))
        .groupBy("key")
        .agg(F.min("s").alias("s"))  # of rows of one key that differ, always the same one
        .select("key", "s.*")
    )
    worded = cut_lineage(worded, "word-sets")
    rep = worded.groupBy("h1", "h2").agg(F.min("key").alias("class_id"))
    members = worded.select("key", "h1", "h2").join(rep, ["h1", "h2"]).select("key", "class_id")
    reps = worded.select(F.col("key").alias("class_id"), "e").join(rep, "class_id", "left_semi")
    return members, reps


def similar_classes(reps: DataFrame, at_least: float) -> DataFrame:
    """class_a < class_b whose word sets have a Jaccard similarity of at least at_least, and that similarity."""
    reps = cut_lineage(reps.withColumn("n", F.monotonically_increasing_id()), "numbered")  # a short key for the shuffles
    shared = banded(reps, "n", "e")
    left = shared.select(F.col("n").alias("a"), "bucket", F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    right = shared.select(F.col("n").alias("b"), "bucket", F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    differ = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    candidates = left.join(right, "bucket").where((F.col("a") < F.col("b")) & (differ <= most_different(at_least))).select("a", "b").distinct()
    ea = reps.select(F.col("n").alias("a"), F.col("e").alias("ea"), F.col("class_id").alias("ca"))
    eb = reps.select(F.col("n").alias("b"), F.col("e").alias("eb"), F.col("class_id").alias("cb"))
    common = F.size(F.array_intersect("ea", "eb"))
    either = F.size("ea") + F.size("eb") - F.col("common")
    return (
        candidates.join(ea, "a").join(eb, "b")
        .select("ca", "cb", common.alias("common"), "ea", "eb")
        .select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"), (F.col("common") / either).alias("similarity"))
        .where(F.col("similarity") >= at_least)
    )


def similar_pairs(df: DataFrame, key: str, title: str, content: str, at_least: float = 0.7, all_pairs_up_to: int = 50) -> DataFrame:
    """key_a < key_b of all records whose word sets are similar; all_pairs_up_to: see the module."""
    members, reps = classes(df, key, title, content)
    members = cut_lineage(members, "members")
    reps = cut_lineage(reps, "reps")
    linked = similar_classes(reps, at_least)
    size = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1")
    many = members.join(size, "class_id")
    # a class too large for all its pairs stands for itself by its smallest key, which is its class_id
    spread = members.join(size.where(F.col("n") > all_pairs_up_to), "class_id", "left").where("n IS NULL OR key = class_id").select("key", "class_id")
    a, b = spread.select(F.col("key").alias("ka"), F.col("class_id").alias("class_a")), spread.select(F.col("key").alias("kb"), F.col("class_id").alias("class_b"))
    across = linked.join(a, "class_a").join(b, "class_b").select("ka", "kb")
    small = many.where(F.col("n") <= all_pairs_up_to)
    within = small.select("class_id", F.col("key").alias("ka")).join(small.select("class_id", F.col("key").alias("kb")), "class_id").where("ka < kb").select("ka", "kb")
    star = many.where((F.col("n") > all_pairs_up_to) & (F.col("key") != F.col("class_id"))).select(F.col("class_id").alias("ka"), F.col("key").alias("kb"))
    return (
        across.unionByName(within).unionByName(star)
        .where("ka <> kb")
        .select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
        .distinct()
    )


def groups(df: DataFrame, key: str, title: str, content: str, at_least: float = 0.7) -> DataFrame:
    """key, class_id, n_links, group_id, group_size of every record that takes part.

    class_id is the smallest key with the same words, n_links the number of similar classes, group_id the smallest
    class that the record's class is connected with over similar ones.
    """
    members, reps = classes(df, key, title, content)
    members, reps = cut_lineage(members, "members"), cut_lineage(reps, "reps")
    linked = cut_lineage(similar_classes(reps, at_least), "linked")
    ends = linked.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    label = components(reps.select(F.col("class_id").alias("id")), linked.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    each = members.join(label.select(F.col("id").alias("class_id"), F.col("component").alias("group_id")), "class_id").join(ends, "class_id", "left")
    size = each.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return each.join(size, "group_id").select(F.col("key").alias(key), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id", "group_size")
