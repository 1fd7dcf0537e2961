"""Linked notes of any number, for runs at scale: each cites the one before and the one seven before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the notes are about, in turn.
TOPICS = (
    "authentication jwt token refresh policy",
    "graph backlinks markdown vault indexing",
    "frontend canvas layout graph interaction",
    "agent memory context retrieval summarization",
    "security local server vault path allowlist",
    "operations release npm github actions smoke test",
    "architecture functional core imperative shell boundaries",
)


def linked_notes(spark: SparkSession, n: int, agent: str = "benchmark-agent") -> DataFrame:
    """path, content of n notes, made in the tasks."""
    i = F.col("id")
    topic = F.element_at(F.array(*(F.lit(t) for t in TOPICS)), (i % len(TOPICS)).cast("int") + 1)
    cite = lambda k, least: F.when(i > least, F.concat(F.lit("[[Benchmark Note "), (i - k).cast("string"), F.lit("]]")))
    number = i.cast("string")
    text = F.concat(
        F.lit("# Benchmark Note "), number, F.lit("\n\nThis note captures "), topic, F.lit(".\nThe implementation detail number "), number, F.lit(" repeats "), topic,
        F.lit(" for semantic retrieval pressure.\nRelated: "), F.concat_ws(" ", cite(1, 0), cite(7, 7)), F.lit("\n\n#benchmark #topic-"), (i % len(TOPICS)).cast("string"),
    )
    return spark.range(n).select(F.concat(F.lit(f"agents/{agent}/benchmark-note-"), number, F.lit(".md")).alias("path"), text.alias("content"))
