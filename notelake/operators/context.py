"""A token-budgeted context package from search results.

Within a document the best chunk comes first and its neighbours alternate around it (left before right), at most three
per document; documents go by the score of their best chunk. The budget is a fold over the few results of a search: a
chunk that does not fit ends its document, and the next document goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import utf16_length

PER_DOCUMENT = 3


def middle_out(results: DataFrame, per_document: int = PER_DOCUMENT) -> DataFrame:
    """results with position (in the whole order from 1), doc_rank and cost (characters / 4, rounded up)."""
    by_ordinal = Window.partitionBy("document_id").orderBy(F.coalesce("chunk_ordinal", F.lit(2**31 - 1)), "chunk_id")
    by_score = Window.partitionBy("document_id").orderBy(F.desc("score"), F.lower("title"), F.coalesce("chunk_ordinal", F.lit(2**31 - 1)), "chunk_id")
    whole = Window.partitionBy("document_id")
    placed = results.withColumn("i", F.row_number().over(by_ordinal)).withColumn("best", F.row_number().over(by_score))
    placed = placed.withColumn("pivot", F.max(F.when(F.col("best") == 1, F.col("i"))).over(whole)).withColumn("doc_score", F.max("score").over(whole))
    outward = Window.partitionBy("document_id").orderBy(F.abs(F.col("i") - F.col("pivot")), "i")
    few = placed.withColumn("doc_rank", F.row_number().over(outward)).where(F.col("doc_rank") <= per_document)
    order = Window.orderBy(F.desc("doc_score"), "document_id", "doc_rank")  # over at most `limit` results
    cost = F.ceil(utf16_length(F.coalesce("content", F.lit(""))) / 4).cast("int")
    return few.withColumn("position", F.row_number().over(order)).withColumn("cost", cost).drop("i", "best", "pivot", "doc_score")


def within_budget(ordered: DataFrame, max_tokens: int) -> DataFrame:
    """The chunks of an ordered result list that fit, with their section number."""
    items = ordered.agg(F.array_sort(F.collect_list(F.struct("position", "document_id", "cost"))).alias("xs"))
    start = F.struct(F.lit(0).alias("used"), F.lit(None).cast("string").alias("closed"), F.array().cast("array<int>").alias("taken"))

    def step(acc, x):
        skip = acc["closed"].eqNullSafe(x["document_id"])
        over = acc["used"] + x["cost"] > max_tokens
        return F.struct(
            F.when(skip | over, acc["used"]).otherwise(acc["used"] + x["cost"]).alias("used"),
            F.when(skip, acc["closed"]).when(over, x["document_id"]).otherwise(acc["closed"]).alias("closed"),
            F.when(skip | over, acc["taken"]).otherwise(F.concat(acc["taken"], F.array(x["position"]))).alias("taken"),
        )

    taken = items.select(F.posexplode(F.aggregate("xs", start, step)["taken"]).alias("n", "position"))
    return ordered.join(taken, "position").withColumn("section", F.col("n") + 1).drop("n")


def context_sections(results: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """section, document_id, chunk_id, title, path, content, score, search_mode, tags, cost."""
    picked = within_budget(middle_out(results), max_tokens)
    return picked.select("section", "document_id", "chunk_id", "title", "path", "content", "score", "search_mode", "tags", "cost")


def render(sections: DataFrame, query: str, heading: str = "# Context") -> DataFrame:
    """One row: query, n_sections, content as Markdown."""
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), t)), " ")
    text = F.array_join(
        F.array_compact(
            F.array(
                F.concat(F.lit("## "), F.col("section").cast("string"), F.lit(". "), F.coalesce("title", F.lit(""))),
                F.concat(F.lit("Source: "), F.coalesce("path", F.lit(""))),
                F.when(tags != "", F.concat(F.lit("Tags: "), tags)),
                F.concat(F.lit("Score: "), F.format_string("%.3f", "score")),
                F.concat(F.lit("Mode: "), F.col("search_mode")),
                F.lit(""),
                F.coalesce("content", F.lit("")),
            )
        ),
        "\n",
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("section").alias("s"), text.alias("t")))), lambda x: x["t"]), "\n\n")
    body = F.coalesce(F.nullif(body, F.lit("")), F.lit("No relevant context found."))
    return sections.agg(F.count("*").alias("n_sections"), F.concat(F.lit(f"{heading}\nQuery: {query}\n\n"), body).alias("content")).withColumn("query", F.lit(query))
