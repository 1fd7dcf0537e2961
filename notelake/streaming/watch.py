"""Following a vault that changes.

A file stream reports new paths only, so edits and deletions need the comparison of snapshots: ``follow`` runs it on a
clock, each tick inside foreachBatch against the snapshot of the tick before, which lives in the shared folder. For tables
that only grow, ``late_reference_counts`` counts with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import snapshots
from ..session import shared_dir
from ..sources import markdown

SNAPSHOT = "path string, mtime timestamp, size bigint"


def snapshot_of(spark: SparkSession, vault: str) -> DataFrame:
    return markdown.list_notes(spark, vault).select("path", F.col("updated_at").alias("mtime"), F.col("size_bytes").alias("size"))


def follow(spark: SparkSession, vault: str, on_change: Callable[[DataFrame, int], None], every: str = "5 seconds", checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Call on_change(changes, tick) with the new, changed and deleted paths of each tick that has any.

    Ticks never overlap; what changes during a tick is seen by the next. once: stop after what is there now.
    """
    base = checkpoint or shared_dir(spark, "watch")

    def tick(_: DataFrame, n: int) -> None:
        before = spark.read.schema(SNAPSHOT).parquet(f"{base}/snapshot-{n - 1}") if n > 0 else spark.createDataFrame([], SNAPSHOT)
        snapshot_of(spark, vault).write.mode("overwrite").parquet(f"{base}/snapshot-{n}")
        now = spark.read.schema(SNAPSHOT).parquet(f"{base}/snapshot-{n}")
        changed = snapshots.changes(before, now).where("change <> 'unchanged'")
        if not changed.isEmpty():
            on_change(changed, n)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", f"{base}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def late_reference_counts(links: DataFrame, lateness: str = "14 days", window: str = "30 days") -> DataFrame:
    """Streaming or not: links per window of indexed_at, counted once per link_id, rows later than the watermark left to a rerun."""
    at = links.withColumn("indexed_at", F.col("indexed_at").cast("timestamp"))
    kept = at.withWatermark("indexed_at", lateness).dropDuplicatesWithinWatermark(["link_id"]) if at.isStreaming else at.dropDuplicates(["link_id"])
    return kept.groupBy(F.window("indexed_at", window).alias("w")).agg(F.count("*").alias("links"))
