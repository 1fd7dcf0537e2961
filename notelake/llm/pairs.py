"""Items that appear together (problem 5).

Method: an incremental pair table. The state is three Parquet tables in the shared folder, bucketed by a hash of their
key: the baskets, the counts of items, and the counts of pairs with the counts of both items, which is all a score needs
(the number of baskets is one factor of all scores and stands in the manifest). A batch of changed baskets is compared
with the stored ones and emits signed deltas - minus one for every pair and item of the old basket, plus one for those of
the new - which are summed on the map side and merged into the buckets they touch. Pairs whose items changed in number
are affected too: their buckets get the new counts, all others stay as they are.

A batch writes a new version of each bucket it touches and at the end a manifest that names the version of every bucket;
a bucket that ends empty is named no more. What is read is what the last manifest names, so a batch that fails leaves
the table as it was, and frames of an older version stay readable. The number of buckets follows the number of baskets
(``PER_BUCKET`` of them in one, re-bucketed when there are twice as many), so that a bucket is one task at every size.

Stored baskets, item counts and pair counts are read only in the buckets that a batch touches; of the other pairs only the
keys are read, to find those whose items changed. Counts are sums, so a hot item is combined before the shuffle. Pairs
stream out of a basket one item at a time, no array of all pairs is built.

Defined results: a basket is the set of its items, so repeated rows change nothing; null and empty items do not count, nor
do rows without a basket key; a changed basket without items is removed, once or again; empty tables give empty counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tag_key
from ..session import cut_lineage, shared_dir

PER_BUCKET, LEAST_BUCKETS = 200_000, 4
TABLES = {
    "baskets": "basket string, items array<string>, bucket int",
    "items": "item string, n bigint, bucket int",
    "pairs": "item_a string, item_b string, n bigint, n_a bigint, n_b bigint, bucket int",
}
KEYS = {"baskets": ["basket"], "items": ["item"], "pairs": ["item_a", "item_b"]}


def baskets(rows: DataFrame, key: str, items: str) -> DataFrame:
    """basket, items (sorted and distinct) from rows that each carry an array of items."""
    each = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("basket"), F.explode_outer(items).alias("item"))
    tidy = each.select("basket", F.nullif(tag_key(F.col("item")), F.lit("")).alias("item")).distinct()
    return tidy.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))


def pairs_of(df: DataFrame, items: str) -> DataFrame:
    """item_a < item_b of each row, beside its other columns."""
    rest = [c for c in df.columns if c != items]
    first = df.select(*rest, items, F.posexplode(items).alias("_i", "item_a"))
    after = F.slice(items, F.col("_i") + 2, F.greatest(F.size(items) - F.col("_i") - 1, F.lit(0)))
    return first.select(*rest, "item_a", F.explode(after).alias("item_b"))


@dataclass(frozen=True)
class State:
    """What a manifest says: the version of each bucket by table, the number of baskets, the number of buckets."""

    version: int
    n_baskets: int
    n_buckets: int
    buckets: dict[str, dict[int, int]]


class PairTable:
    """Persistent counts of pairs and items, in hash buckets below ``path``."""

    def __init__(self, spark: SparkSession, path: str, state: State, per_bucket: int = PER_BUCKET) -> None:
        self.spark, self.path, self.state, self.per_bucket = spark, path, state, per_bucket

    @classmethod
    def new(cls, spark: SparkSession, per_bucket: int = PER_BUCKET, n_buckets: int = LEAST_BUCKETS) -> PairTable:
        """An empty table in a fresh folder."""
        return cls(spark, shared_dir(spark, "pair-table"), State(0, 0, n_buckets, {t: {} for t in TABLES}), per_bucket)

    @classmethod
    def open(cls, spark: SparkSession, path: str, per_bucket: int = PER_BUCKET) -> PairTable:
        """The table in a folder, as its last finished batch left it."""
        manifests = spark.read.parquet(f"{path}/manifest")
        rows = manifests.where(F.col("v") == manifests.agg(F.max("v")).first()[0]).collect()  # one row per bucket and table
        found: dict[str, dict[int, int]] = {t: {} for t in TABLES}
        for r in rows:
            if r["table"]:
                found[r["table"]][r["bucket"]] = r["version"]
        return cls(spark, path, State(rows[0]["v"], rows[0]["n_baskets"], rows[0]["n_buckets"], found), per_bucket)

    def read(self, table: str, only: set[int] | None = None) -> DataFrame:
        """A table as the current manifest names it, or only some of its buckets."""
        there = self.state.buckets[table]
        paths = [f"{self.path}/{table}/v={v}/bucket={b}" for b, v in sorted(there.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).option("basePath", f"{self.path}/{table}").parquet(*paths).drop("v")

    def stored_baskets(self) -> DataFrame:
        return self.read("baskets")

    def pair_counts(self) -> DataFrame:
        return self.read("pairs")

    def item_counts(self) -> DataFrame:
        return self.read("items")

    def n_baskets(self) -> int:
        return self.state.n_baskets

    def _bucket(self, table: str, n_buckets: int | None = None) -> F.Column:
        return F.pmod(F.xxhash64(*KEYS[table]), F.lit(n_buckets or self.state.n_buckets)).cast("int")

    def _put(self, table: str, version: int, df: DataFrame) -> set[int]:
        """Write df as a version of its buckets; gives the buckets that have rows."""
        path = f"{self.path}/{table}/v={version}"
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)  # over what a failed batch left
        files = self.spark.read.schema(TABLES[table]).parquet(path).inputFiles()  # one file per bucket
        return {int(re.search(r"/bucket=(\d+)/", f)[1]) for f in files}

    def _commit(self, state: State) -> None:
        rows = [(t, b, v, state.n_baskets, state.n_buckets) for t, bs in state.buckets.items() for b, v in bs.items()]
        rows = rows or [(None, None, None, state.n_baskets, state.n_buckets)]
        ddl = "table string, bucket int, version int, n_baskets bigint, n_buckets int"
        self.spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{self.path}/manifest/v={state.version}")
        self.state = state

    @staticmethod
    def _touched(df: DataFrame) -> set[int]:
        return {r[0] for r in df.select("bucket").distinct().collect()}  # at most n_buckets numbers

    def apply(self, changed: DataFrame) -> None:
        """Merge a batch of whole changed baskets (basket, items) into the counts."""
        now = cut_lineage(changed.select("basket", "items").withColumn("bucket", self._bucket("baskets")), "changed-baskets")
        if not any(self.state.buckets.values()):  # an empty table takes the number of buckets its first batch asks for
            self.state = State(self.state.version, 0, max(self.state.n_buckets, -(-now.count() // self.per_bucket)), self.state.buckets)
            now = now.withColumn("bucket", self._bucket("baskets"))
        version, buckets = self.state.version + 1, {t: dict(b) for t, b in self.state.buckets.items()}

        def switch(table: str, df: DataFrame, touched: set[int]) -> None:
            filled = self._put(table, version, df)
            for b in touched:
                if b in filled:
                    buckets[table][b] = version
                else:
                    buckets[table].pop(b, None)

        touched = self._touched(now)
        old = self.read("baskets", touched)
        both = now.join(old.select("basket", F.col("items").alias("was")), "basket", "left").where(~F.col("items").eqNullSafe(F.coalesce("was", F.array().cast("array<string>"))))
        sides = F.array(F.struct(F.lit(-1).cast("bigint").alias("n"), F.col("was").alias("items")), F.struct(F.lit(1).cast("bigint").alias("n"), "items"))
        deltas = cut_lineage(both.select("basket", "bucket", F.explode(sides).alias("s")).select("basket", "bucket", "s.*").where(F.size("items") > 0), "basket-deltas")

        d_items = deltas.select("n", F.explode("items").alias("item")).groupBy("item").agg(F.sum("n").alias("n")).where("n <> 0")
        d_items = cut_lineage(d_items.withColumn("bucket", self._bucket("items")), "item-deltas")
        in_items = self._touched(d_items)
        merged = self.read("items", in_items).unionByName(d_items).groupBy("item", "bucket").agg(F.sum("n").alias("n")).where("n > 0")
        switch("items", merged, in_items)
        by_bucket = {r["bucket"]: r["n"] for r in deltas.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most n_buckets rows
        n_baskets = self.state.n_baskets + sum(by_bucket.values())

        d_pairs = pairs_of(deltas.select("n", "items"), "items").groupBy("item_a", "item_b").agg(F.sum("n").alias("n")).where("n <> 0")
        d_pairs = cut_lineage(d_pairs.withColumn("bucket", self._bucket("pairs")), "pair-deltas")
        keys = self.read("pairs").select("item_a", "item_b", "bucket")
        moved = d_items.select("item")
        affected = keys.join(moved.withColumnRenamed("item", "item_a"), "item_a", "left_semi").select("bucket").unionByName(keys.join(moved.withColumnRenamed("item", "item_b"), "item_b", "left_semi").select("bucket"))
        in_pairs = self._touched(d_pairs.select("bucket").unionByName(affected))
        counts = self.read("pairs", in_pairs).select("item_a", "item_b", "bucket", "n").unionByName(d_pairs)
        merged = counts.groupBy("item_a", "item_b", "bucket").agg(F.sum("n").alias("n")).where("n > 0")

        before, self.state = self.state, State(version, n_baskets, self.state.n_buckets, buckets)  # the new item counts
        items = self.read("items").select("item", F.col("n").alias("c"))
        self.state = before
        scored = merged.join(items.select(F.col("item").alias("item_a"), F.col("c").alias("n_a")), "item_a").join(items.select(F.col("item").alias("item_b"), F.col("c").alias("n_b")), "item_b")
        switch("pairs", scored.select("item_a", "item_b", "n", "n_a", "n_b", "bucket"), in_pairs)

        kept = old.join(deltas.where("n < 0").select("basket"), "basket", "left_anti")
        switch("baskets", kept.select("basket", "items", "bucket").unionByName(deltas.where("n > 0").select("basket", "items", "bucket")), set(by_bucket))
        self._commit(State(version, n_baskets, self.state.n_buckets, buckets))
        if n_baskets > 2 * self.per_bucket * self.state.n_buckets:
            self._rebucket(-(-n_baskets // self.per_bucket))

    def _rebucket(self, n_buckets: int) -> None:
        """Write everything anew in so many buckets."""
        version = self.state.version + 1
        filled = {t: self._put(t, version, self.read(t).withColumn("bucket", self._bucket(t, n_buckets))) for t in TABLES}
        self._commit(State(version, self.state.n_baskets, n_buckets, {t: dict.fromkeys(b, version) for t, b in filled.items()}))

    def scores(self, min_count: int = 1, min_share: float = 0.0) -> DataFrame:
        """item_a, item_b, n_ab, n_a, n_b, n, lift, pmi of the pairs that reach both bounds: one scan of the stored pairs."""
        n = self.state.n_baskets
        common = self.read("pairs").where((F.col("n") >= min_count) & (F.col("n") >= min_share * n))
        return (
            common.select("item_a", "item_b", F.col("n").alias("n_ab"), "n_a", "n_b", F.lit(n).cast("bigint").alias("n"))
            .withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")))
            .withColumn("pmi", F.log2("lift"))
        )
