"""Folders of Markdown notes: scanning, writing, the allow-list, addresses of object stores, legacy databases.

The scan lists files with Spark's binary source and reads their bytes in the tasks; only a listing of names passes the
driver, as for any file source. Spark hides names that begin with _ or ., so such notes are not seen.
"""

from __future__ import annotations

import os
import sqlite3
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no notes.
SKIPPED = (".git", "node_modules", "dist")


def _relative(path: str) -> F.Column:
    root = path if "://" in path or path.startswith("file:") else "file:" + os.path.abspath(path)
    base = "/" + root.split(":", 1)[-1].strip("/")
    plain = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    return F.regexp_replace(F.replace(F.url_decode(plain), F.lit(base + "/"), F.lit("")), "^/+", "")


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(path)
    skip = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    return found.withColumn("path", _relative(path)).where(~F.col("path").rlike(rf"(^|/)(?:{skip})/"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, updated_at of every file, without reading any."""
    return _files(spark, path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("updated_at"))


def list_notes(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, updated_at of the Markdown files, without reading any."""
    return list_files(spark, path).where(F.lower("path").endswith(".md"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """path, content, created_at (unknown to file sources: null), updated_at, size_bytes."""
    notes = _files(spark, path).where(F.lower("path").endswith(".md"))
    return notes.select(
        "path",
        F.decode("content", "UTF-8").alias("content"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.col("modificationTime").alias("updated_at"),
        F.col("length").alias("size_bytes"),
    )


def safe_path(path: F.Column) -> F.Column:
    """Does a relative path stay below its vault?"""
    return path.isNotNull() & ~path.rlike(r"^[/\\]|(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:")


def write_notes(df: DataFrame, path: str) -> DataFrame:
    """Write rows (path, content) as files below a folder that all executors share; gives path and bytes of each.

    A path that would leave the folder fails the job.
    """
    root = path[len("file://") :] if path.startswith("file://") else path

    def run(batches):
        for pdf in batches:
            sizes = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                target = os.path.join(root, *PurePosixPath(name).parts)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                data = (content or "").encode()
                with open(target + ".part", "wb") as f:
                    f.write(data)
                os.replace(target + ".part", target)
                sizes.append(len(data))
            yield pdf[["path"]].assign(bytes=sizes)

    checked = df.select(F.when(safe_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.lit("path outside the vault"))).alias("path"), "content")
    return checked.mapInPandas(run, "path string, bytes long")


def parse_bucket(uri: str) -> tuple[str, str]:
    """Bucket and prefix, without outer slashes, of an s3:// address."""
    u = urlparse(uri)
    if u.scheme not in ("s3", "s3a") or not u.netloc:
        raise ValueError(f"not a bucket address: {uri}")
    return u.netloc, u.path.strip("/")


def is_allowed(vault: str, allowed: list[str]) -> bool:
    """Is a vault inside one of the allowed places? An empty list, or one that names no place of its kind, allows all."""
    bucket = vault.startswith(("s3://", "s3a://"))
    same = [a for a in allowed if a.startswith(("s3://", "s3a://")) == bucket]
    if not allowed or (not same and not bucket):
        return True
    if bucket:
        name, prefix = parse_bucket(vault)
        return any(name == b and (p == "" or prefix == p or prefix.startswith(p + "/")) for b, p in map(parse_bucket, same))
    real = os.path.realpath(os.path.expanduser(vault))
    return any(os.path.commonpath([real, r]) == r for r in (os.path.realpath(os.path.expanduser(a)) for a in same))


#: Names under which a legacy table may keep what a note needs, and what finding each is worth.
ALIASES = {
    "content": ("content", "markdown", "body", "text", "note"),
    "title": ("title", "note_title", "name", "headline"),
    "path": ("path", "file_path", "filepath", "source_path", "source"),
    "agent": ("agent", "agent_id", "namespace", "scope"),
    "tags": ("tags", "tag_list", "keywords"),
}
WORTH = {"content": 6, "title": 4, "path": 2, "agent": 1}


def pick_columns(columns: list[str]) -> dict[str, str]:
    """Which column of a table plays which part."""
    lower = {c.lower(): c for c in reversed(columns)}
    return {part: next(lower[n] for n in names if n in lower) for part, names in ALIASES.items() if any(n in lower for n in names)}


def pick_table(tables: dict[str, list[str]]) -> str:
    """The table (name to columns) most like a table of notes; of equals the first by name."""
    worth = {t: sum(WORTH.get(p, 0) for p in pick_columns(c)) for t, c in tables.items() if "content" in pick_columns(c)}
    if not worth:
        raise ValueError("no table with a content column")
    return min(worth, key=lambda t: (-worth[t], t))


def read_legacy(spark: SparkSession, database: str, table: str | None = None, splits: int = 8) -> DataFrame:
    """id, title, content, agent, tags, path of a SQLite file that all executors can read.

    The file is read in ranges of its row ids, one per task; the driver sees only the schema.
    """
    con = sqlite3.connect(f"file:{database}?mode=ro", uri=True)
    try:
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        columns = {n: [r[1] for r in con.execute(f'PRAGMA table_info("{n}")')] for n in names}
        chosen = table or pick_table(columns)
        top = con.execute(f'SELECT coalesce(max(rowid), 0) FROM "{chosen}"').fetchone()[0]
    finally:
        con.close()
    part = pick_columns(columns[chosen])
    select = ", ".join(f'CAST("{part[p]}" AS TEXT)' if p in part else "NULL" for p in ("title", "content", "agent", "tags", "path"))
    step = max(1, -(-top // splits))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            own = sqlite3.connect(f"file:{database}?mode=ro", uri=True)
            for low in pdf["id"]:
                rows = own.execute(f'SELECT rowid, {select} FROM "{chosen}" WHERE rowid > ? AND rowid <= ?', (int(low), int(low) + step))
                while some := rows.fetchmany(5000):
                    yield pd.DataFrame(some, columns=["id", "title", "content", "agent", "tags", "path"])
            own.close()

    return spark.range(0, max(top, 1), step, splits).mapInPandas(run, "id long, title string, content string, agent string, tags string, path string")
