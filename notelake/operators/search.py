"""Lexical, semantic and hybrid retrieval over chunks or documents.

The query's tokens and vector are literals, so a search scores every row in one projection (once: the score is not pushed
into the filter again). What is shuffled are keys and scores of the hits, combined on the map side; the contents of the
few best are fetched afterwards by their keys. Agents are a pushed filter.

Defined results: null title, path, content or tags count as empty; a query without a token longer than one character gives
every row with text score 0; repeated rows of a chunk count once (of rows that differ the best); rows without a chunk key
count as one chunk; a limit of 0 or less gives nothing; ties go by title without case, then path, ordinal and chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embed import cosine, embed
from ..functions.text import count_hits, fold, query_tokens

#: Weights of hits in title, tags and path, and the most hits in the content that count.
TITLE, TAGS, PATH, CONTENT_CAP, PACK_CAP = 5, 4, 2, 6, 5
HYBRID = 8
MODES = ("fts", "semantic", "hybrid")
RESULT = ["document_id", "agent_id", "title", "path", "chunk_id", "chunk_ordinal", "content", "tags"]


def text_score(tokens: list[str], cap: int = CONTENT_CAP) -> Column:
    """Over the columns title, tags, path and content."""
    if not tokens:
        return F.lit(0)
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    title, path, content = (fold(or_empty(F.col(c))) for c in ("title", "path", "content"))
    tags = fold(or_empty(F.array_join("tags", " ")))
    parts = [
        count_hits(title, t) * TITLE + count_hits(tags, t) * TAGS + count_hits(path, t) * PATH + F.least(count_hits(content, t), F.lit(cap))
        for t in tokens
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("int")


def scored(rows: DataFrame, query: str, mode: str = "hybrid", agent: str | None = None, cap: int = CONTENT_CAP) -> DataFrame:
    """All rows that match, with text_score, semantic_score, score and search_mode."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    tokens, vector = query_tokens(query), embed(query)
    if agent is not None:
        rows = rows.where(F.col("agent_id") == agent)
    semantic = cosine(F.col("embedding"), vector) if mode != "fts" and any(vector) and "embedding" in rows.columns else F.lit(0.0)
    found = F.struct(text_score(tokens, cap).alias("text_score"), semantic.alias("semantic_score"))
    # behind a generator the scores are computed once, not again in the filter
    out = rows.select(*RESULT, F.array(found).alias("_found")).select(*RESULT, F.explode_outer("_found").alias("_s")).select(*RESULT, "_s.*")
    score = {"fts": F.col("text_score").cast("double"), "semantic": F.col("semantic_score"), "hybrid": F.col("text_score") + F.col("semantic_score") * HYBRID}[mode]
    out = out.withColumn("score", score).withColumn("search_mode", F.lit(mode))
    return out if not tokens else out.where("score > 0")


def search(rows: DataFrame, query: str, limit: int = 10, mode: str = "hybrid", agent: str | None = None, cap: int = CONTENT_CAP) -> DataFrame:
    """The best ``limit`` chunks."""
    place = F.struct((-F.col("score")).alias("neg"), F.lower("title").alias("lowered"), "title", "path", "chunk_ordinal", "document_id", "agent_id")
    hits = scored(rows, query, mode, agent, cap).groupBy("chunk_id").agg(F.min(place).alias("_place"), F.max(F.struct("score", "text_score", "semantic_score")).alias("_best"))
    top = hits.orderBy("_place", "chunk_id").limit(max(0, limit))
    same = (F.col("_c.chunk_id").eqNullSafe(F.col("_t.chunk_id"))) & F.col("_c.title").eqNullSafe(F.col("_t._place.title")) & F.col("_c.path").eqNullSafe(F.col("_t._place.path"))
    same = same & F.col("_c.document_id").eqNullSafe(F.col("_t._place.document_id")) & F.col("_c.agent_id").eqNullSafe(F.col("_t._place.agent_id"))
    texts = rows if agent is None else rows.where(F.col("agent_id") == agent)
    fetched = texts.select(*RESULT).alias("_c").join(F.broadcast(top).alias("_t"), same)  # at most `limit` keys
    one = fetched.groupBy("_t.chunk_id", "_place", "_best").agg(F.min(F.struct(*(F.col(f"_c.{c}") for c in RESULT))).alias("_r"))
    return one.orderBy("_place", "chunk_id").select("_r.*", "_best.text_score", "_best.semantic_score", "_best.score", F.lit(mode).alias("search_mode"))


def search_documents(docs: DataFrame, query: str, limit: int = 1200, agent: str | None = None) -> DataFrame:
    """id, score of the documents whose title, tags, path or content hold a token of the query."""
    tokens = query_tokens(query)
    if not tokens or limit <= 0:
        return docs.select("id", F.lit(0).alias("score")).limit(0)
    if agent is not None:
        docs = docs.where(F.col("agent_id") == agent)
    return docs.select("id", text_score(tokens).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)
