"""Comparing states of a vault: incremental indexing, migration between vaults, trails of conflicts.

Defined results: a path that is null is ignored; of repeated rows of a path the latest counts; an empty side makes
everything new, or everything deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(notes: DataFrame) -> DataFrame:
    """path, mtime, size (bytes of the content), one row per path."""
    return notes.where("path IS NOT NULL").groupBy("path").agg(
        F.max("updated_at").alias("mtime"), F.max_by(F.octet_length(F.coalesce("content", F.lit(""))), F.col("updated_at")).cast("bigint").alias("size")
    )


def changes(previous: DataFrame, current: DataFrame, settings_changed: bool = False) -> DataFrame:
    """path, change of each path of two snapshots: new, changed, deleted or unchanged."""
    p = previous.select("path", F.col("mtime").alias("p_mtime"), F.col("size").alias("p_size"), F.lit(True).alias("p"))
    c = current.select("path", F.col("mtime").alias("c_mtime"), F.col("size").alias("c_size"), F.lit(True).alias("c"))
    same = F.col("p_mtime").eqNullSafe(F.col("c_mtime")) & F.col("p_size").eqNullSafe(F.col("c_size"))
    kind = (
        F.when(F.col("c").isNull(), "deleted")
        .when(F.col("p").isNull(), "new")
        .when(~same | F.lit(settings_changed), "changed")
        .otherwise("unchanged")
    )
    return p.join(c, "path", "full_outer").select("path", kind.alias("change"))


def needs_rebuild(n_changed: int, n_all: int, pending: int) -> bool:
    """Are packs rebuilt at once: 400 changed notes, 4 % of all, or 1,200 changes waiting."""
    return n_changed >= 400 or (n_all > 0 and n_changed / n_all >= 0.04) or pending >= 1200


def migration_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """path, bytes, kind of each note of the source: copy, unchanged or conflict; nothing is ever overwritten."""
    one = lambda df, name: df.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.coalesce("content", F.lit("")), F.col("updated_at")).alias(name))
    s, t = one(source, "body"), one(target, "there").select("path", F.xxhash64("there").alias("h"), F.sha2("there", 256).alias("there_hash"))
    kind = F.when(F.col("there_hash").isNull(), "copy").when(F.col("there_hash") == F.sha2("body", 256), "unchanged").otherwise("conflict")
    return s.join(t, "path", "left").select("path", F.octet_length("body").cast("bigint").alias("bytes"), kind.alias("kind"))
