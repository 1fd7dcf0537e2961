"""Questions to the graph of notes: joined links, backlinks, broken links, orphans, degrees, components, statistics.

docs are documents (id, agent_id, title, path, tags, ...), links are links (from_document_id, to_title, to_document_id,
weight, priority). An agent, where given, is slugged like those of the notes; None stands for all.

Defined results: a link whose source is unknown keeps its id as title and an empty path; a broken outgoing link counts as
a link of its source, so that source is no orphan; empty tables give empty results or zeros.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text
from ..session import shared_dir


def of_agent(docs: DataFrame, agent: str | None) -> DataFrame:
    return docs if agent is None else docs.where(F.col("agent_id") == agent)


def links_of(docs: DataFrame, links: DataFrame, agent: str | None = None) -> DataFrame:
    """Links of the agent's documents; their targets may lie elsewhere."""
    if agent is None:
        return links
    return links.join(of_agent(docs, agent).select(F.col("id").alias("from_document_id")), "from_document_id", "left_semi")


def joined_links(docs: DataFrame, links: DataFrame) -> DataFrame:
    """agent_id, from_title, from_path, to_title, to_path, weight, priority."""
    source = docs.select(F.col("id").alias("from_document_id"), "agent_id", F.col("title").alias("from_title"), F.col("path").alias("from_path"))
    target = docs.select(F.col("id").alias("to_document_id"), F.col("title").alias("target_title"), F.col("path").alias("to_path"))
    return links.join(source, "from_document_id", "left").join(target, "to_document_id", "left").select(
        F.coalesce("agent_id", F.lit("shared")).alias("agent_id"),
        F.coalesce("from_title", F.lit("Unknown")).alias("from_title"),
        F.coalesce("from_path", F.lit("")).alias("from_path"),
        F.coalesce("target_title", "to_title").alias("to_title"),
        "to_path",
        "weight",
        "priority",
        F.col("to_title").alias("written_title"),
    )


def listed_links(docs: DataFrame, links: DataFrame, limit: int, agent: str | None = None) -> DataFrame:
    """The first ``limit`` joined links by the title of their source."""
    found = of_agent(joined_links(docs, links), agent).drop("written_title")
    return found.orderBy(F.lower("from_title"), "from_title", "from_path", F.lower("to_title"), "to_title", "weight").limit(max(0, limit))


def node(docs: DataFrame, id_: str, agent: str | None = None) -> DataFrame:
    """The one node of an id, with its content; nothing if it is not there or another agent's."""
    return of_agent(docs.where(F.col("id") == id_), agent).select("id", "agent_id", "title", "path", "content", "tags").limit(1)


def summary_nodes(docs: DataFrame, agent: str | None = None) -> DataFrame:
    """The nodes of a graph without their contents."""
    return of_agent(docs, agent).select("id", "agent_id", "title", "path", F.lit("").alias("content"), "tags")


def summary_edges(docs: DataFrame, links: DataFrame, agent: str | None = None) -> DataFrame:
    """source, target, target_title, weight, priority of the links of the nodes; a target may be null or lie elsewhere."""
    known = links.join(of_agent(docs, agent).select(F.col("id").alias("from_document_id")), "from_document_id", "left_semi")
    return known.select(F.col("from_document_id").alias("source"), F.col("to_document_id").alias("target"), F.col("to_title").alias("target_title"), "weight", "priority")


def tag_counts(docs: DataFrame) -> DataFrame:
    """tag, documents: every distinct tag of the documents, by name."""
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("documents")).orderBy("tag")


def backlinks(docs: DataFrame, links: DataFrame, title: str, agent: str | None = None) -> DataFrame:
    """Links whose written title is the given one, whatever its case; heaviest first."""
    found = joined_links(docs, links.where(F.lower("to_title") == title.lower()))
    return of_agent(found, agent).drop("written_title").orderBy(F.desc("weight"), F.lower("from_title"), "from_path")


def broken_links(docs: DataFrame, links: DataFrame) -> DataFrame:
    """title, path, missing: links without a target."""
    source = docs.select(F.col("id").alias("from_document_id"), "title", "path")
    return links.where("to_document_id IS NULL").join(source, "from_document_id", "left").select(
        F.coalesce("title", "from_document_id").alias("title"), F.coalesce("path", F.lit("")).alias("path"), F.col("to_title").alias("missing")
    )


def orphans(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Documents at neither end of any link."""
    ends = links.select(F.col("from_document_id").alias("id")).unionByName(links.where("to_document_id IS NOT NULL").select(F.col("to_document_id").alias("id")))
    return docs.join(ends, "id", "left_anti")


def degrees(docs: DataFrame, links: DataFrame) -> DataFrame:
    """id, degree: weights clamped to 1..8 at both ends, at the source alone of broken links."""
    w = F.least(F.greatest(F.col("weight"), F.lit(1)), F.lit(8))
    ends = links.select(F.explode(F.array_compact(F.array("from_document_id", "to_document_id"))).alias("id"), w.alias("w"))
    total = ends.groupBy("id").agg(F.sum("w").alias("degree"))
    return docs.select("id").join(total, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def stats(docs: DataFrame, links: DataFrame) -> DataFrame:
    """One row: documents, links, resolved, broken, orphans, tags, and whether the graph is valid (no broken link)."""
    d = docs.agg(F.count("*").alias("documents"))
    t = docs.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("tags"))
    e = links.agg(F.count("*").alias("links"), F.count("to_document_id").alias("resolved_links"))
    o = orphans(docs, links).agg(F.count("*").alias("orphans"))
    row = d.join(t).join(e).join(o)  # each side is one row
    return row.withColumn("broken_links", F.col("links") - F.col("resolved_links")).withColumn("ok", F.col("broken_links") == 0)


def extended_stats(docs: DataFrame, links: DataFrame) -> DataFrame:
    """stats with ratios to four decimals and the number of links per priority."""
    count = lambda p: F.count_if(F.col("priority") == p).alias(f"{p}_links")
    by = links.agg(*(count(p) for p in ("low", "normal", "high", "critical")))
    ratio = lambda a, b: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4), F.lit(0.0))
    return (
        stats(docs, links)
        .join(by)  # one row
        .withColumn("resolved_ratio", ratio("resolved_links", "links"))
        .withColumn("broken_ratio", ratio("broken_links", "links"))
        .withColumn("orphan_ratio", ratio("orphans", "documents"))
    )


def edges_between(docs: DataFrame, links: DataFrame) -> DataFrame:
    """a < b: undirected distinct edges whose ends both exist."""
    known = docs.select("id")
    e = links.where("to_document_id IS NOT NULL AND to_document_id <> from_document_id")
    e = e.join(known.withColumnRenamed("id", "from_document_id"), "from_document_id", "left_semi")
    e = e.join(known.withColumnRenamed("id", "to_document_id"), "to_document_id", "left_semi")
    return e.select(F.least("from_document_id", "to_document_id").alias("a"), F.greatest("from_document_id", "to_document_id").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id each node is connected with.

    Alternating large-star and small-star steps over the edges (each node is re-linked to its smallest neighbour), which
    settle in about log2 of the longest path; every round is written to the shared folder and read again. Nothing but
    two sums per round comes to the driver.
    """
    spark = edges.sparkSession
    base = shared_dir(spark, "components")

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    current = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "r0")
    mark = None
    for i in count(1):
        current = save(star(save(star(current, True), f"l{i}"), False), f"r{i}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    label = current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def checks(docs: DataFrame, links: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """check, ok, n: is the vault there, does it hold notes, are they indexed, and is no link broken?

    notes are the files of the vault; None: the documents were made from all of them.
    """
    row = stats(docs, links).join((docs if notes is None else notes).agg(F.count("*").alias("files")))  # one row
    check = lambda name, ok, n: F.struct(F.lit(name).alias("check"), ok.alias("ok"), n.cast("bigint").alias("n"))
    four = F.array(
        check("vault", F.lit(True), F.lit(1)),
        check("markdown-files", F.col("files") > 0, F.col("files")),
        check("index", F.col("documents") > 0, F.col("documents")),
        check("broken-links", F.col("ok"), F.col("broken_links")),
    )
    return row.select(F.explode(four).alias("c")).select("c.*")


def signature(docs: DataFrame, links: DataFrame) -> DataFrame:
    """One row that changes whenever a node or an edge does: counts and order-free sums of row hashes."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = lambda *c: F.conv(F.substring(F.sha2(F.concat_ws("|", *map(text, c)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = lambda *c: F.coalesce(F.sum(row(*c)), F.lit(0)).cast("string")
    n = docs.agg(F.count("*").alias("nodes"), total("id", "agent_id", "title", "path").alias("node_sum"))
    e = links.agg(F.count("*").alias("edges"), total("from_document_id", "to_document_id", "to_title", "weight", "priority").alias("edge_sum"))
    return n.join(e).select("nodes", "edges", F.sha2(F.concat_ws("|", "nodes", "node_sum", "edges", "edge_sum"), 256).alias("signature"))  # one row each


def filter_nodes(docs: DataFrame, query: str, limit: int = 1200) -> DataFrame:
    """id, score: 4 where the folded title, path and tags begin with the folded query, 1 where they hold it."""
    wanted = fold_text(query).strip()
    empty = F.array().cast("array<string>")
    text = fold(F.concat_ws(" ", "title", "path", F.array_join(F.coalesce("tags", empty), " ")))
    score = F.when(text.startswith(wanted), 4).when(text.contains(wanted), 1).otherwise(0)
    found = docs.select("id", score.alias("score")).where("score > 0")
    return (found if wanted else found.limit(0)).orderBy(F.desc("score"), "id").limit(max(1, limit))


def storage(notes: DataFrame) -> DataFrame:
    """One row: files, bytes, mean bytes (rounded), first and last change."""
    size = F.octet_length(F.coalesce("content", F.lit("")))
    return notes.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce(F.round(F.avg(size)), F.lit(0)).cast("bigint").alias("mean_bytes"),
        F.min("updated_at").cast("string").alias("first_change"),
        F.max("updated_at").cast("string").alias("last_change"),
    )
