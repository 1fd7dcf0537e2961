"""The vault of a data folder: its notes with their links written out as Markdown.

The tables hold a note's outgoing links and tags as arrays; here they are written into the text (one line per link, in
four forms by position, and a line of tags), so that everything else is parsed from Markdown alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tag_key
from ..operators.documents import latest
from .tables import table

COLUMNS = ["id", "agent_id", "title", "path", "content", "tags", "links", "created_at", "updated_at"]


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of vault_notes and hub_notes."""
    both = [table(spark, folder, t).select(*COLUMNS) for t in ("vault_notes", "hub_notes")]
    return both[0].unionByName(both[1])


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each note of vault_notes and hub_notes."""
    return latest(rows(spark, folder))


def written(df: DataFrame) -> DataFrame:
    """path, content, created_at, updated_at with front matter, links and tags in the content."""
    empty = F.array().cast("array<string>")
    link = lambda t, i: (
        F.when(i % 4 == 0, F.concat(F.lit("## See [["), t, F.lit("]]")))
        .when(i % 4 == 1, F.concat(F.lit("- [ ] Check [["), t, F.lit("]] priority: high")))
        .when(i % 4 == 2, F.concat(F.lit("Related: [["), t, F.lit("]] priority: low")))
        .otherwise(F.concat(F.lit("- [["), t, F.lit("]]")))
    )
    lines = F.array_join(F.transform(F.coalesce("links", empty), link), "\n")
    tags = F.filter(F.transform(F.coalesce("tags", empty), lambda t: tag_key(t)), lambda t: t != "")
    tag_line = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")
    front = F.concat(F.lit('---\ntitle: "'), F.coalesce("title", F.lit("")), F.lit('"\nagent: '), F.coalesce("agent_id", F.lit("shared")), F.lit("\n---\n"))
    content = F.concat(front, F.coalesce("content", F.lit("")), F.lit("\n\n"), lines, F.lit("\n\n"), tag_line)
    return df.select("path", content.alias("content"), "created_at", "updated_at")
