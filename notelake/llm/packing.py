"""Filling fixed-capacity containers with items (problem 7).

Method: harmonic packing. With capacity C an item of size s belongs to class j = C div s, so j items of class j always fit
one container, and a class's containers take exactly j of its items each: which container an item goes to follows from
its rank within its class by a division, so every worker fills its containers by itself. The room that a class's
containers leave is a smaller container; it is filled by count in the same way: a filler of size t goes into a room r
exactly r div t times, the fillers coming from the later classes, and what is left of a class after that forms
containers of its own.

How many containers of each make there are depends on the histogram of sizes alone, at most C numbers whatever the
number of items, so it is worked out on the driver (``plan``). Items are numbered within their size by a range-partitioned
rank and find their container by two lookups: no group of items is gathered anywhere, and one size may hold all items.
An item longer than C is cut into pieces of C and a rest; no other item is cut.

Defined results: items of size 0 or null take no room and come out once with a null container; repeated rows are items of
their own; an empty table gives an empty result; items of one size are numbered by key and piece, so containers are the
same at every run up to the order of rows that are equal.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import rank_within
from ..session import cut_lineage


class _Sizes:
    """How many items of each size are left, with the largest that fits a room."""

    def __init__(self, counts: Mapping[int, int]) -> None:
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.left)

    def fitting(self, room: int) -> int | None:
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.order.pop(bisect_right(self.order, size) - 1)


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(size, first, per, container): the items of a size from rank ``first`` on go ``per`` at a time to containers from there on.

    counts: the number of items by size, sizes from 1 to capacity. The ranges of a size follow one another without gaps.
    """
    sizes, used = _Sizes(counts), dict.fromkeys(counts, 0)
    slots: list[tuple[int, int, int, int]] = []
    opened = 0

    def put(size: int, per: int, containers: int, at: int) -> None:
        slots.append((size, used[size], per, at))
        used[size] += per * containers
        sizes.take(size, per * containers)

    while sizes.order:
        j = capacity // sizes.order[-1]
        rooms: list[tuple[int, int, int]] = []  # room, first container, containers
        while sizes.order and capacity // sizes.order[-1] == j:  # the class's containers, j items in each
            size = sizes.order[-1]
            if sizes.left[size] >= j:
                n = sizes.left[size] // j
                put(size, j, n, opened)
                room = capacity - j * size
            else:  # one container across sizes
                n, room, need = 1, capacity, j
                while need and sizes.order and capacity // (size := sizes.order[-1]) == j:
                    some = min(need, sizes.left[size])
                    put(size, some, 1, opened)
                    room, need = room - some * size, need - some
            rooms.append((room, opened, n))
            opened += n
        while rooms:  # the rooms of the whole class, one filler size each in a round, the smallest rooms first
            rooms.sort()
            later = []
            for room, at, n in rooms:
                while n and (size := sizes.fitting(room)) is not None:
                    per = min(room // size, sizes.left[size])
                    some = min(n, sizes.left[size] // per)
                    put(size, per, some, at)
                    later.append((room - per * size, at, some))
                    at, n = at + some, n - some
            rooms = [r for r in later if r[0] > 0]
    return slots


def harmonic_packs(items: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """pack_id, key, piece, start_token, n_tokens: one row per item or piece of an item."""
    spark = items.sparkSession
    s = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    last = F.greatest(F.ceil(F.col("_s") / capacity).cast("int") - 1, F.lit(0))
    pieces = (
        items.select(F.col(key).alias("_k"), s.alias("_s"))
        .select("_k", "_s", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .select("_k", "piece", (F.col("piece").cast("bigint") * capacity).alias("start_token"), F.least(F.col("_s") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("n_tokens"))
    )
    pieces = cut_lineage(pieces.withColumn("_tie", F.monotonically_increasing_id()), "pieces")
    sized = pieces.where("n_tokens > 0")
    counts = {r[0]: r[1] for r in sized.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for t, first, per, at in plan(counts, capacity):
        by_size.setdefault(t, []).append((first, per, at))
    lookup = spark.createDataFrame([(t, *map(list, zip(*xs, strict=True))) for t, xs in by_size.items()], "n_tokens bigint, first array<bigint>, per array<bigint>, at array<bigint>")
    ranked = rank_within(sized, ["n_tokens"], [F.asc("_k"), F.asc("piece"), F.asc("_tie")]).withColumn("r", F.col("rank") - 1)
    slot = F.size(F.filter("first", lambda x: x <= F.col("r"))) - 1
    placed = ranked.join(F.broadcast(lookup), "n_tokens").withColumn("i", slot)  # one row per size
    pack = F.get("at", F.col("i")) + F.floor((F.col("r") - F.get("first", F.col("i"))) / F.get("per", F.col("i")))
    columns = [F.col("_k").alias(key), "piece", "start_token", "n_tokens"]
    none = F.lit(None).cast("bigint").alias("pack_id")
    return placed.select(pack.cast("bigint").alias("pack_id"), *columns).unionByName(pieces.where("n_tokens <= 0").select(none, *columns))


def fill_report(packs: DataFrame, capacity: int = 2048) -> DataFrame:
    """How full the containers are: packs, tokens, fill, and the packs by tenths of fill."""
    per = packs.where("pack_id IS NOT NULL").groupBy("pack_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("parts"))
    tenth = F.least(F.floor(F.col("used") * 10 / capacity), F.lit(10)).cast("int").alias("tenth")
    return per.groupBy(tenth).agg(
        F.count("*").alias("packs"), F.sum("parts").alias("parts"), F.sum("used").alias("tokens"),
        F.round(F.avg(F.col("used") / capacity), 4).alias("mean_fill"),
    )
