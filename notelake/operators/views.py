"""What is shown of a placed graph: clusters by level, samples, the neighbourhood of nodes, and the edges worth drawing.

nodes are (id, title, path, degree, x, y), edges are (a, b, weight) between them. Every sample is a filter on a
range-partitioned rank or a top-k over narrow rows; a top-k per node is one aggregation with a bounded array.

Defined results: nodes without coordinates take no part where distances count; ties go by degree and id; without a hub
nothing is added or measured for it; empty tables give empty results; limits below 1 give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import buckets, hub_score, primary_hub
from .ranges import rank_within

#: Numbers of nodes from which a graph is large, and how many edges it shows then.
LARGE, EDGES_SHOWN = 4_000, 120_000
#: Scales from which every node, every second one and so on is shown of a large graph, and the last stride.
STRIDES, LAST_STRIDE = ((0.95, 1), (0.7, 2), (0.48, 3), (0.28, 5)), 8
#: What makes an edge relevant.
PER_WEIGHT, REAL, SELECTED, HOVERED, AT_HUB = 10, 8, 120, 70, 42
PER_HUB = 1000


def _placed(nodes: DataFrame) -> DataFrame:
    return nodes.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def cluster_levels(nodes: DataFrame, sizes: tuple[int, ...] = (1000, 250, 60)) -> DataFrame:
    """size, bucket, parent, x, y, n, representative, folder of the clusters of each level, sizes from large to small.

    A cluster's parent is the one of the level before that its first node lies in; its representative has the highest
    degree, hubs first.
    """
    of = buckets(nodes, sizes).join(nodes.select("id", "title", "degree", "x", "y"), "id")
    levels = F.array(*(F.struct(F.lit(s).alias("size"), F.col(f"bucket_{s}").alias("bucket"), (F.col(f"bucket_{s}") * s).alias("first")) for s in sizes))
    above = {s: sizes[i - 1] for i, s in enumerate(sizes) if i}
    each = of.select("id", "folder", "degree", "x", "y", (F.col("degree") + hub_score(F.col("title")) * PER_HUB).alias("worth"), F.explode(levels).alias("l")).select("*", "l.*").drop("l")
    found = each.groupBy("size", "bucket", "first").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"), F.min_by("id", F.struct((-F.col("worth")).alias("w"), "id")).alias("representative"), F.min("folder").alias("folder")
    )
    parent = F.lit(None).cast("bigint")
    for s, up in above.items():
        parent = F.when(F.col("size") == s, F.floor(F.col("first") / up).cast("bigint")).otherwise(parent)
    return found.select("size", "bucket", parent.alias("parent"), "x", "y", "n", "representative", "folder")


def stride_for(n_nodes: int, scale: float) -> int:
    """Every how many-th node of a graph is shown at a scale."""
    return 1 if n_nodes <= LARGE else next((n for least, n in STRIDES if scale >= least), LAST_STRIDE)


def every_nth(nodes: DataFrame, stride: int) -> DataFrame:
    """Every stride-th node in the order of titles and ids, from the first on."""
    ranked = rank_within(nodes.withColumn("_all", F.lit(0)), ["_all"], [F.asc("title"), F.asc("id")])
    return ranked.where((F.col("rank") - 1) % max(1, stride) == 0).drop("_all", "rank")


def even_sample(nodes: DataFrame, limit: int) -> DataFrame:
    """At most limit nodes, evenly spread over the order of titles and ids."""
    return every_nth(nodes, -(-nodes.count() // limit)) if limit > 0 else nodes.limit(0)


def extent(nodes: DataFrame) -> DataFrame:
    """One row: x0, y0, x1, y1 of the nodes, the primary hub and how far its nearest neighbour is (null without any)."""
    hub = primary_hub(_placed(nodes)).select(F.col("id").alias("hub"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    both = _placed(nodes).join(hub, F.lit(True), "left")  # at most one hub
    away = F.when(F.col("id") != F.col("hub"), F.hypot(F.col("x") - F.col("hx"), F.col("y") - F.col("hy")))
    return both.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.max("hub").alias("hub"), F.min(away).alias("nearest"))


def nearest_sample(nodes: DataFrame, x: float, y: float, limit: int, shown: DataFrame | None = None, by_distance: bool = True) -> DataFrame:
    """The limit nodes nearest to a place; shown(id) are those shown before, which go first at equal distance or altogether."""
    kept = nodes.withColumn("_old", F.lit(0)) if shown is None else nodes.join(shown.select("id").distinct().withColumn("_old", F.lit(1)), "id", "left")
    away = F.hypot(F.col("x") - x, F.col("y") - y)
    order = [F.asc("_away"), F.desc("_was")] if by_distance else [F.desc("_was"), F.asc("_away")]
    found = _placed(kept).withColumns({"_away": away, "_was": F.coalesce("_old", F.lit(0))})
    return found.orderBy(*order, F.desc("degree"), "id").limit(max(0, limit)).drop("_old", "_away", "_was")


def layered_sample(nodes: DataFrame, target: int, core_ratio: float, core_radius: float, shell_center: float, shell_width: float) -> DataFrame:
    """id: the core around the primary hub by degree, and a shell by how near its nodes lie to the shell's centre."""
    placed = _placed(nodes)
    hub = primary_hub(placed).select(F.col("x").alias("hx"), F.col("y").alias("hy"))
    away = placed.join(hub, F.lit(True)).select("id", "degree", F.hypot(F.col("x") - F.col("hx"), F.col("y") - F.col("hy")).alias("d"))
    far = away.agg(F.max("d").alias("most"), F.count("*").alias("n")).first()
    if not far.n or far.most <= 0.001:
        return placed.select("id")
    desired = max(260, min(far.n, target * 2))
    core = max(36, min(desired - 8, int(desired * core_ratio)))
    share = F.round(F.col("d") / far.most, 12)
    inner = away.where(share <= core_radius).orderBy(F.desc("degree"), "id").limit(core)
    off = F.round(F.abs(share - shell_center), 12)
    outer = away.orderBy((off > shell_width / 2).cast("int"), off, F.desc("degree"), "id").limit(max(12, desired - core))
    return inner.select("id").unionByName(outer.select("id")).distinct()


def with_neighbours(sample: DataFrame, edges: DataFrame, per_node: int = 3, more: int = 200) -> DataFrame:
    """id, added: the sample(id) and up to ``more`` neighbours over the heaviest edges of its nodes."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    mine = both.where("id <> other").join(sample.select("id").distinct(), "id", "left_semi")
    ranked = rank_within(mine, ["id"], [F.desc("weight"), F.asc("other")]).where(F.col("rank") <= per_node)
    fresh = ranked.groupBy(F.col("other").alias("id")).agg(F.max("weight").alias("w")).join(sample.select("id"), "id", "left_anti")
    added = fresh.orderBy(F.desc("w"), "id").limit(max(0, more)).select("id", F.lit(True).alias("added"))
    return sample.select("id").distinct().withColumn("added", F.lit(False)).unionByName(added)


def heaviest_edges(edges: DataFrame, n_nodes: int, limit: int = EDGES_SHOWN) -> DataFrame:
    """All edges of a small graph, the limit heaviest of a large one."""
    return edges.orderBy(F.desc("weight"), "a", "b").limit(limit) if n_nodes > LARGE else edges


def relevant_edges(edges: DataFrame, limit: int, selected: str | None = None, hovered: str | None = None, hub: str | None = None) -> DataFrame:
    """a, b, weight, inferred, score: the most relevant of edges(a, b, weight, inferred), each pair once per kind."""
    at = lambda id_: F.lit(False) if id_ is None else (F.col("a") == id_) | (F.col("b") == id_)
    bonus = lambda cond, n: F.when(cond, n).otherwise(0)
    once = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "inferred").agg(F.max("weight").alias("weight"))
    score = F.col("weight") * PER_WEIGHT + bonus(~F.col("inferred"), REAL) + bonus(at(selected), SELECTED) + bonus(at(hovered), HOVERED) + bonus(at(hub), AT_HUB)
    return once.select("a", "b", "weight", "inferred", score.cast("bigint").alias("score")).orderBy(F.desc("score"), "a", "b", "inferred").limit(max(0, limit))
