"""Placing the graph of notes on a plane, and the views of a placed graph at several levels of detail.

Segments grow from seeds by breadth-first levels, all seeds at once; a note reached from several seeds in one level goes
to the first of them, which is what a queue filled in seed order gives. Positions follow from ranks and hashes. Collisions
are relaxed in rounds in which all pairs act at once (grid join), instead of one pair after another.

Ranks over hot groups do not go through one task (``rank_within``).

Defined results: nodes without coordinates take no part in the views; ties go by title and id; empty tables give empty
results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .ranges import rank_within

#: Names of well-known folders, and angles of well-known segments.
GROUP_LABELS = {
    "00-maps": "maps",
    "10-agent-memory": "agent-memory",
    "20-concepts": "concepts",
    "30-architecture": "architecture",
    "40-agents": "agents",
    "50-retrieval": "retrieval",
    "60-operations": "operations",
    "70-evaluation": "evaluation",
    "80-sessions": "sessions",
    "90-security": "security",
    "root": "root",
}
SEGMENT_ANGLES = {"Architecture": -0.74, "Agents": -0.05, "Retrieval": 0.68, "Operations": 1.34, "Evaluation": 2.08, "Security": 2.82}
GOLDEN = 2.399963
MIN_DISTANCE = 132.0
_W = lambda words: rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


def group_label(path: Column) -> Column:
    """The folder a note is in, below its agent."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    key = F.when(F.get(parts, F.lit(0)) == "agents", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0)))
    key = F.coalesce(key, F.lit("root"))
    label = F.create_map(*(F.lit(x) for kv in GROUP_LABELS.items() for x in kv))
    return F.coalesce(label[key], key)


def text_hash(c: Column) -> Column:
    """h * 31 + code of each character, in 32 bits with sign."""
    codes = F.filter(F.split(c, ""), lambda x: x != "")
    wrap = lambda v: F.pmod(v + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: wrap(h * 31 + F.ascii(x)))


def jitter(c: Column, span: float) -> Column:
    return (F.abs(text_hash(c) % 1000) / 1000 - 0.5) * span


def hub_score(title: Column) -> Column:
    t = F.lower(F.trim(title))
    return F.when(t == "memory hub", 5).when(t == "knowledge root", 4).when(title.rlike(_W("moc")), 3).when(title.rlike(_W(r"memory\s*hub|knowledge\s*root|moc|map")), 2).otherwise(0)


def primary_hub(nodes: DataFrame) -> DataFrame:
    """The one hub of nodes(id, title, degree): by score, degree, title; one row or none."""
    return nodes.withColumn("hub_score", hub_score(F.col("title"))).where("hub_score > 0").orderBy(F.desc("hub_score"), F.desc("degree"), "title", "id").limit(1)


def segments(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """id, segment: of nodes(id, title, path, degree), undirected edges(a, b) and components(id, component).

    Each level is written once; a level needs those written so far only to leave out the nodes that have a segment.
    """
    n = nodes.join(components, "id")
    natural = (group_label(F.col("path")) == "maps") | F.col("title").rlike(_W("moc|map"))
    n = n.withColumn("natural", natural.cast("int"))
    per = n.groupBy("component").agg(F.min("title").alias("first_title"), F.max("natural").alias("has"), F.max(F.struct("degree")).alias("d"))
    top = n.groupBy("component").agg(F.min(F.struct((-F.col("degree")).alias("nd"), "title", "id")).alias("top"))
    marked = n.join(per.join(top, "component"), "component")
    seed = marked.where(F.when(F.col("has") == 1, F.col("natural") == 1).otherwise(F.col("id") == F.col("top.id")))
    name = F.trim(F.regexp_replace(F.regexp_replace("title", r"(?i)^MOC\s+", ""), r"(?i)\s+Memory Map$", ""))
    rank = F.struct("first_title", (-F.col("degree")).alias("nd"), "title", "id")
    frontier = cut_lineage(seed.select("id", rank.alias("rank"), F.coalesce(F.nullif(name, F.lit("")), "title").alias("segment")), "segments")
    levels = [frontier]
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both-ways")
    while True:
        done = reduce(DataFrame.unionByName, levels)
        step = frontier.select(F.col("id").alias("a"), "rank", "segment").join(both, "a")
        near = step.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("rank", "segment")).alias("m")).join(done.select("id"), "id", "left_anti")
        frontier = cut_lineage(near.select("id", "m.rank", "m.segment"), "frontier")
        if frontier.isEmpty():
            return nodes.select("id", "path").join(done.select("id", "segment"), "id", "left").select("id", F.coalesce("segment", group_label(F.col("path"))).alias("segment"))
        levels.append(frontier)
        if len(levels) > 30:  # a long path: fewer files to read
            levels = [cut_lineage(reduce(DataFrame.unionByName, levels), "segments")]


def place(nodes: DataFrame) -> DataFrame:
    """x, y of nodes(id, title, path, degree, segment): petals around the segment's centre by rank."""
    sized = cut_lineage(nodes.groupBy("segment").agg(F.count("*").alias("size")), "segment-sizes")
    k = sized.count()
    one = rank_within(sized.withColumn("_all", F.lit(0)), ["_all"], [F.asc("segment")])
    numbered = one.select("segment", "size", (F.col("rank") - 1).alias("s"), F.lit(k).cast("bigint").alias("k"))
    known = F.create_map(*(x for k, v in SEGMENT_ANGLES.items() for x in (F.lit(k), F.lit(v))))
    angle = F.coalesce(known[F.col("segment")], F.lit(6.283185307179586) * F.col("s") / F.col("k") - 1.5707963267948966)
    radius = F.when(F.col("k") == 1, 0.0).otherwise(340.0 + F.least("size", F.lit(22)) * 10)
    centre = numbered.select("segment", "k", angle.alias("angle"), radius.alias("radius"), (180 + F.log2(F.col("size") + 1) * 6).alias("spread"))
    ranked = rank_within(nodes, ["segment"], [F.desc("degree"), F.asc("title"), F.asc("id")]).join(centre, "segment")
    local = (F.col("rank") - 1) * GOLDEN + jitter(F.col("title"), 0.42)
    out = F.sqrt("rank") * F.col("spread")
    pull = F.when(F.col("k") == 1, 0.0).otherwise(F.least("degree", F.lit(12)) * 12)
    x = F.cos("angle") * F.col("radius") + F.cos(local) * out - F.cos("angle") * pull + jitter(F.col("id"), 24)
    y = F.sin("angle") * F.col("radius") * 0.78 + F.sin(local) * out * 0.78 - F.sin("angle") * pull + jitter(F.col("path"), 24)
    return ranked.select(*nodes.columns, group_label(F.col("path")).alias("group"), x.alias("x"), y.alias("y"))


def _cells(df: DataFrame, cell: float) -> DataFrame:
    return df.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))


def near_pairs(points: DataFrame, distance: float) -> DataFrame:
    """a, b, distance, dx, dy of ordered pairs of points(id, x, y) nearer than the distance, by cells of that size."""
    p = _cells(points.select("id", "x", "y"), distance)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = p.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    right = p.select("*", around.alias("o")).select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    d = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return left.join(right, ["cx", "cy"]).where("a <> b").select("a", "b", d.alias("distance"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy")).where(F.col("distance") < distance)


def rounds_for(n: int) -> int:
    """Rounds of relaxation of n notes."""
    return 12 if n > 1000 else 20 if n > 500 else 26


def relax(nodes: DataFrame, rounds: int | None = None, distance: float = MIN_DISTANCE) -> DataFrame:
    """nodes moved apart: in each round every pair that is too near pushes both ends by half of what is missing."""
    out = cut_lineage(nodes, "relaxed")
    for i in range(rounds_for(out.count()) if rounds is None else rounds):
        out = cut_lineage(out, "relaxed") if i else out
        near = near_pairs(out, distance)
        far = F.greatest("distance", F.lit(0.001))
        push = (distance - far) / 2
        moved = near.groupBy(F.col("a").alias("id")).agg(F.sum(-F.col("dx") / far * push).alias("mx"), F.sum(-F.col("dy") / far * push).alias("my"))
        out = out.join(moved, "id", "left").withColumn("x", F.col("x") + F.coalesce("mx", F.lit(0.0))).withColumn("y", F.col("y") + F.coalesce("my", F.lit(0.0))).drop("mx", "my")
    return out


def centred(nodes: DataFrame) -> DataFrame:
    """nodes(id, title, degree, x, y) with the primary hub at 0, 0; as they are if there is none."""
    hub = primary_hub(nodes).select(F.col("x").alias("hub_x"), F.col("y").alias("hub_y"))
    both = nodes.join(hub, F.lit(True), "left")  # at most one row
    return both.withColumn("x", F.col("x") - F.coalesce("hub_x", F.lit(0.0))).withColumn("y", F.col("y") - F.coalesce("hub_y", F.lit(0.0))).drop("hub_x", "hub_y")


#: How many edges a large graph may show, by its number of nodes.
EDGE_LIMITS = ((100_000, 15_000), (50_000, 22_000), (25_000, 30_000), (0, 60_000))


def edge_limit(n_nodes: int) -> int:
    """The edges that a graph of so many nodes may show."""
    return next(limit for above, limit in EDGE_LIMITS if n_nodes > above or above == 0)


def edge_budget(links: DataFrame, limit: int) -> DataFrame:
    """Resolved links within a budget: the heaviest of each endpoint first, then the heaviest of all."""
    e = links.where("to_document_id IS NOT NULL AND to_document_id <> ''").select("from_document_id", "to_document_id", "to_title", "weight", "priority")
    order = F.struct((-F.col("weight")).alias("w"), "from_document_id", "to_document_id", "priority", "to_title")
    best = e.select(F.explode(F.array("from_document_id", "to_document_id")).alias("end"), order.alias("o")).groupBy("end").agg(F.min("o").alias("o"))
    first = best.select("o.from_document_id", "o.to_document_id", "o.priority", "o.to_title").distinct().withColumn("tier", F.lit(0))
    keys = ["from_document_id", "to_document_id", "priority", "to_title"]
    return e.join(first, keys, "left").orderBy(F.coalesce("tier", F.lit(1)), F.desc("weight"), *keys).limit(limit).select("from_document_id", "to_document_id", "to_title", "weight", "priority")


def in_viewport(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def grid_clusters(points: DataFrame, cell: float, limit: int = 900) -> DataFrame:
    """cell_x, cell_y, x, y, n, representative (of the highest degree) of points(id, x, y, degree) by grid cell."""
    top = F.min_by("id", F.struct((-F.col("degree")).alias("d"), "id"))
    by = _cells(points, cell).groupBy("cx", "cy").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"), top.alias("representative"))
    return by.orderBy(F.desc("n"), "cx", "cy").limit(limit).withColumnsRenamed({"cx": "cell_x", "cy": "cell_y"})


#: Cells of the mesh are a third as wide each time, until their points share them with so many on average, or they are the finest.
CROWD, FINEST = 24, 14


def _crowding(points: DataFrame, cell: float) -> float:
    """With how many points a point shares its cell on average."""
    n = _cells(points, cell).groupBy("cx", "cy").agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0


def mesh_edges(points: DataFrame, edges: DataFrame, distance: float, k: int = 3) -> DataFrame:
    """a < b: each point with its k nearest within the distance that edges(a, b) do not link already.

    The search begins with narrow cells and goes on with wider ones for the points that have not found k within a cell's
    width, so that the work follows the points and not the pairs within the distance. Of the points at one place those
    with the smallest ids are enough: k, one for the point itself, and as many as the most links of a point to near ones.
    """
    p = cut_lineage(points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("id", "x", "y"), "points")
    end = lambda s: p.select(F.col("id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    near = edges.select("a", "b").join(end("a"), "a").join(end("b"), "b").where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) < distance)
    ends = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    linked = cut_lineage(ends.groupBy("e.a").agg(F.collect_set("e.b").alias("linked")), "linked")
    most = linked.agg(F.max(F.size("linked"))).first()[0] or 0
    at_place = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    there = cut_lineage(p.withColumn("_n", at_place).where(F.col("_n") <= k + 1 + most).drop("_n"), "places")
    step = 0
    while step < FINEST and _crowding(there, distance / 3**step) > CROWD:
        step += 1
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    moved = lambda df: df.withColumn("o", around).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    open_, found, first = p.withColumnRenamed("id", "a").join(linked, "a", "left"), [], True
    while True:
        cell = distance / 3**step
        left = _cells(open_, cell).withColumnsRenamed({"x": "ax", "y": "ay"})
        right = _cells(there, cell)
        if not first:  # few points are left: only what lies around them
            right = right.join(moved(left.select("cx", "cy").distinct()).distinct(), ["cx", "cy"], "left_semi")
        right = moved(right).select(F.col("cx").alias("rx"), F.col("cy").alias("ry"), F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        d = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
        within = d < (cell - 1e-8 if step else distance)  # what is nearer lies in the cells around, and rounding doesn't reorder it
        on = (F.col("cx") == F.col("rx")) & (F.col("cy") == F.col("ry")) & (F.col("a") != F.col("b")) & within & ~F.coalesce(F.array_contains("linked", F.col("b")), F.lit(False))
        pair = F.when(F.col("b").isNotNull(), F.struct(F.round(d, 9).alias("d"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
        near = left.join(right, on, "left").groupBy("cx", "cy", "a").agg(F.first("ax").alias("x"), F.first("ay").alias("y"), F.first("linked").alias("linked"), F.slice(F.array_sort(F.collect_list(pair)), 1, k).alias("xs"))
        tried = cut_lineage(near.drop("cx", "cy"), "tried")
        done = F.size("xs") >= k if step else F.lit(True)
        found.append(tried.where(done).select(F.explode("xs").alias("x")))
        if not step:
            break
        open_, step, first = tried.where(~done).drop("xs"), step - 1, False
    return reduce(DataFrame.unionByName, found).select(F.col("x.lo").alias("a"), F.col("x.hi").alias("b")).distinct()


def buckets(nodes: DataFrame, sizes: tuple[int, ...] = (1000, 250, 60)) -> DataFrame:
    """id, and one bucket number per size, of nodes(id, path, degree, title) in the order of folder, degree and title."""
    folder = F.coalesce(F.nullif(F.array_join(F.slice(F.filter(F.split("path", "/"), lambda p: F.trim(p) != ""), 1, 2), "/"), F.lit("")), F.lit("root"))
    ranked = rank_within(nodes.withColumn("folder", folder).withColumn("_all", F.lit(0)), ["_all"], [F.asc("folder"), F.desc("degree"), F.asc("title"), F.asc("id")])
    return ranked.select("id", "folder", *(F.floor((F.col("rank") - 1) / s).cast("bigint").alias(f"bucket_{s}") for s in sizes))


def cluster_edges(assigned: DataFrame, edges: DataFrame, limit: int = 520) -> DataFrame:
    """a < b, weight: links between clusters, of assigned(id, cluster) and edges(a, b, weight)."""
    s, t = assigned.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), assigned.select(F.col("id").alias("b"), F.col("cluster").alias("cb"))
    both = edges.join(s, "a").join(t, "b").where("ca <> cb")
    return both.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(limit)
