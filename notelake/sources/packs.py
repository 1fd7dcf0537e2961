"""Search packs: chunk rows in files of bounded size, with a report per pack.

Parquet takes the place of a private row format: column pruning, statistics, compression and, where wanted, Bloom filters
come with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_PACK = 5000
COLUMNS = ["document_id", "agent_id", "title", "path", "chunk_id", "chunk_ordinal", "content", "tags"]


def numbered(rows: DataFrame, rows_per_pack: int = ROWS_PER_PACK) -> DataFrame:
    """Distinct rows with the pack they belong to: agent by agent, by document and ordinal."""
    from ..operators.ranges import rank_within

    ranked = rank_within(rows.select(*COLUMNS).distinct().withColumn("_all", F.lit(0)), ["_all"], [F.asc(c) for c in ("agent_id", "document_id", "chunk_ordinal", "chunk_id")])
    return ranked.withColumn("pack", F.floor((F.col("rank") - 1) / rows_per_pack).cast("int")).drop("_all", "rank")


def report(df: DataFrame) -> DataFrame:
    """pack, n, documents, agents, bytes of numbered rows."""
    return df.groupBy("pack").agg(
        F.count("*").alias("n"),
        F.count_distinct("document_id").alias("documents"),
        F.sort_array(F.collect_set("agent_id")).alias("agents"),
        F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("bytes"),
    )


def write(df: DataFrame, path: str) -> None:
    """Packs as compressed Parquet, one folder per agent, files of at most ROWS_PER_PACK rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_PACK).option("compression", "zstd").partitionBy("agent_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*COLUMNS)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Packs of an older kind: one JSON row per line, gzip or plain; rows of another shape are dropped."""
    ddl = "document_id string, agent_id string, title string, path string, chunk_id string, chunk_ordinal int, content string, tags array<string>"
    return spark.read.schema(ddl).json(path).where("document_id IS NOT NULL AND chunk_id IS NOT NULL AND content IS NOT NULL")


def upgrade(spark: SparkSession, old: str, new: str) -> None:
    """Write packs of an older kind as packs of this one."""
    write(read_lines(spark, old).distinct(), new)


def compression(spark: SparkSession, path: str) -> DataFrame:
    """One row: in_bytes (texts, titles, paths and tags of the rows), out_bytes of the files, ratio and saved share."""
    rows = read(spark, path)
    size = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in ("title", "path", "content", "document_id", "chunk_id")), F.octet_length(F.coalesce(F.array_join("tags", " "), F.lit(""))))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    both = rows.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("in_bytes")).join(files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("out_bytes")))  # one row each
    ratio = F.coalesce(F.round(F.col("out_bytes") / F.nullif(F.col("in_bytes"), F.lit(0)), 4), F.lit(0.0))
    return both.withColumn("ratio", ratio).withColumn("saved", F.greatest(F.lit(0.0), 1 - F.col("ratio")))
