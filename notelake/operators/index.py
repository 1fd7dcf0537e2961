"""The stored index of a vault, kept up to date run by run.

An index is a folder of versions, each with documents, chunks (with embeddings), links and the snapshot they were made
from, and a state row written last: a run that fails leaves the version before. A run compares the snapshot of the notes
with the stored one; only new and changed notes are parsed, cut and embedded, the stored rows of all others are taken
over, those of deleted notes are left out, and the links of every document are resolved anew, since a title that
appears or goes away changes links of notes that did not change.

Defined results: rows without a path are ignored, of repeated rows of a path the latest counts; other settings make every
note changed; a run over an unchanged vault writes nothing and counts what is there; an empty vault gives an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir
from . import chunks as chunking
from . import documents as parsing
from . import snapshots

STATE = "v bigint, max_characters int, pending bigint, packs_due boolean, n_documents bigint, n_chunks bigint, n_links bigint, n_changed bigint, n_deleted bigint"
SNAPSHOT = "path string, mtime timestamp_ntz, size bigint"


@dataclass
class VaultIndex:
    """The index below ``path``."""

    spark: SparkSession
    path: str

    @classmethod
    def new(cls, spark: SparkSession) -> VaultIndex:
        return cls(spark, shared_dir(spark, "index"))

    def state(self):
        """The row of the last finished run, or None."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(STATE).parquet(f"{self.path}/state").orderBy(F.desc("v")).first()

    def read(self, name: str) -> DataFrame:
        """documents, chunks, links or snapshot of the last finished run."""
        return self.spark.read.parquet(f"{self.path}/v{self.state().v}/{name}")

    def run(self, notes: DataFrame, max_characters: int = chunking.MAX_CHARACTERS) -> DataFrame:
        """Bring the index up to the notes (path, content, created_at, updated_at); gives the run's counts, one row."""
        last = self.state()
        latest = notes.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct(F.coalesce("content", F.lit("")).alias("content"), "created_at", "updated_at"), F.struct(F.col("updated_at"), F.coalesce("content", F.lit("")))).alias("n"))
        latest = cut_lineage(latest.select("path", "n.*"), "notes")
        now = snapshots.snapshot(latest).select("path", F.col("mtime").cast("timestamp_ntz").alias("mtime"), "size")
        before = self.spark.createDataFrame([], SNAPSHOT) if last is None else self.read("snapshot")
        changes = cut_lineage(snapshots.changes(before, now, last is not None and last.max_characters != max_characters), "changes")
        n = {r.change: r.n for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}  # four kinds
        n_changed, n_deleted = n.get("new", 0) + n.get("changed", 0), n.get("deleted", 0)
        if last is not None and not n_changed and not n_deleted:
            return self._result(last.asDict() | {"n_changed": 0, "n_deleted": 0, "packs_due": False})

        version = 1 if last is None else last.v + 1
        base = f"{self.path}/v{version}"
        todo = latest.join(changes.where("change IN ('new', 'changed')").select("path"), "path", "left_semi")
        same = changes.where("change = 'unchanged'").select("path")
        fresh = cut_lineage(parsing.documents(todo), "fresh-documents")
        docs, parts = fresh, chunking.chunks(fresh, max_characters, embed=True)
        if last is not None:
            kept = self.read("documents").join(same, "path", "left_semi")
            docs = fresh.unionByName(kept)
            parts = parts.unionByName(self.read("chunks").join(kept.select(F.col("id").alias("document_id")), "document_id", "left_semi"))
        docs.write.mode("overwrite").parquet(f"{base}/documents")
        docs = self.spark.read.parquet(f"{base}/documents")
        parts.write.mode("overwrite").parquet(f"{base}/chunks")
        parsing.links(docs).write.mode("overwrite").parquet(f"{base}/links")
        now.write.mode("overwrite").parquet(f"{base}/snapshot")
        counts = {f"n_{t}": self.spark.read.parquet(f"{base}/{t}").count() for t in ("documents", "chunks", "links")}
        pending = (0 if last is None or last.packs_due else last.pending) + n_changed
        due = last is None or last.max_characters != max_characters or n_deleted > 0 or snapshots.needs_rebuild(n_changed, counts["n_documents"], pending)
        row = {"v": version, "max_characters": max_characters, "pending": pending, "packs_due": due, "n_changed": n_changed, "n_deleted": n_deleted} | counts
        result = self._result(row)
        result.coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        return result

    def _result(self, row: dict) -> DataFrame:
        names = [c.split()[0] for c in STATE.split(", ")]
        return self.spark.createDataFrame([tuple(row[c] for c in names)], STATE)

    def rows(self) -> DataFrame:
        """Chunks with their documents, as searches take them; chunks whose document is gone are left out."""
        d = self.read("documents").select(F.col("id").alias("document_id"), "agent_id", "title", "path", "tags")
        c = self.read("chunks").select("document_id", F.col("id").alias("chunk_id"), F.col("ordinal").alias("chunk_ordinal"), "content", "embedding")
        return c.join(d, "document_id")

    def nested(self) -> DataFrame:
        """Each document with its chunks in order and its links by written title."""
        chunk = F.struct("ordinal", F.col("id").alias("chunk_id"), "token_count")
        c = self.read("chunks").groupBy("document_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
        links = F.struct("to_title", "to_document_id", "weight", "priority")
        e = self.read("links").groupBy(F.col("from_document_id").alias("document_id")).agg(F.array_sort(F.collect_list(links)).alias("links"))
        d = self.read("documents").select(F.col("id").alias("document_id"), "agent_id", "title", "path")
        none = lambda c, of: F.coalesce(c, F.array().cast(of.schema[c].dataType)).alias(c)
        return d.join(c, "document_id", "left").join(e, "document_id", "left").select("document_id", "agent_id", "title", "path", none("chunks", c), none("links", e))
