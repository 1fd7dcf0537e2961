"""Queries of the operators for language-model data, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import cut_lineage
from ..sources.tables import table
from . import encode, knn, near_dup, packing, sentences
from .pairs import PairTable, baskets

llm = Registry()
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048


#: All pairs against all: stated for small tables, where one list makes the search exact.
_P3 = """
WITH v AS (SELECT chunk_id, any_value(embedding) AS x FROM index_rows WHERE len(embedding) = 192 AND chunk_id IS NOT NULL GROUP BY 1),
u AS (SELECT * FROM v WHERE list_max(list_transform(x, lambda e: abs(e))) > 0 AND NOT isnan(list_sum(x)) AND NOT isinf(list_sum(x))),
s AS (SELECT a.chunk_id AS q, b.chunk_id AS n, round(list_cosine_similarity(a.x, b.x), 9) AS sim FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, n) AS rank FROM s)
"""


@llm.query("p3_found", _P3 + "SELECT DISTINCT least(q, n) AS chunk_a, greatest(q, n) AS chunk_b FROM r WHERE rank <= 10")
def p3_found(spark, d):
    near = knn.neighbours(table(spark, d, "index_rows"), "chunk_id", "embedding", 192)
    return knn.pairs(near).toDF("chunk_a", "chunk_b")


@llm.query("p3_neighbours", _P3 + "SELECT q AS chunk_id, rank::INTEGER AS rank, n AS neighbour FROM r WHERE rank <= 10")
def p3_neighbours(spark, d):
    near = knn.neighbours(table(spark, d, "index_rows"), "chunk_id", "embedding", 192)
    one = near.select(F.col("key").alias("chunk_id"), F.posexplode("near").alias("rank", "n"))
    return one.select("chunk_id", (F.col("rank") + 1).alias("rank"), F.col("n.key").alias("neighbour"))


#: All pairs of word sets at 0.7 or more, exact: pairs must share a word among the rarest ones of both.
_P4 = r"""
WITH RECURSIVE w AS (
  SELECT chunk_id, min(words) AS words FROM (SELECT chunk_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || content), '[\p{L}\p{N}_\-]+'))) AS words
    FROM pack_rows WHERE regexp_matches(content, '[^\s\x0b\p{Z}\x{85}\x{FEFF}]') AND chunk_id IS NOT NULL) WHERE len(words) > 0 GROUP BY 1
), e AS (SELECT chunk_id, len(words) AS n, unnest(words) AS word FROM w),
f AS (SELECT word, count(*) AS df FROM e GROUP BY 1),
r AS (SELECT e.*, row_number() OVER (PARTITION BY chunk_id ORDER BY df, e.word) AS place FROM e JOIN f USING (word)),
prefix AS (SELECT chunk_id, n, word FROM r WHERE place <= n - ceil(0.7 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.chunk_id AS a, b.chunk_id AS b FROM prefix a JOIN prefix b USING (word) WHERE a.chunk_id < b.chunk_id AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9),
p AS (SELECT a, b FROM cand JOIN w x ON x.chunk_id = a JOIN w y ON y.chunk_id = b
  WHERE len(list_intersect(x.words, y.words)) / (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) >= 0.7)
"""


@llm.query("p4_found", _P4 + "SELECT a AS chunk_a, b AS chunk_b FROM p")
def p4_found(spark, d):
    return near_dup.similar_pairs(table(spark, d, "pack_rows"), "chunk_id", "title", "content", 0.7).toDF("chunk_a", "chunk_b")


@llm.query(
    "p4_groups",
    _P4 + """, c AS (SELECT words, min(chunk_id) AS class_id FROM w GROUP BY 1), m AS (SELECT chunk_id, class_id FROM w JOIN c USING (words)),
l AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM p JOIN m x ON x.chunk_id = a JOIN m y ON y.chunk_id = b WHERE x.class_id <> y.class_id),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach(id, g) AS (SELECT class_id, class_id FROM c UNION SELECT u.b, reach.g FROM reach JOIN u ON u.a = reach.id WHERE reach.g < u.b),
g AS (SELECT id AS class_id, min(g) AS group_id FROM reach GROUP BY 1), n AS (SELECT a AS class_id, count(DISTINCT b) AS n_links FROM u GROUP BY 1)
SELECT chunk_id, class_id, coalesce(n_links, 0) AS n_links, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM m JOIN g USING (class_id) LEFT JOIN n USING (class_id)""",
)
def p4_groups(spark, d):
    return near_dup.groups(table(spark, d, "pack_rows"), "chunk_id", "title", "content", 0.7)


_P5 = r"""
WITH t AS (
  SELECT DISTINCT document_id, lower(trim(regexp_replace(trim(tag), '^#+', ''))) AS tag
  FROM (SELECT document_id, unnest(tags) AS tag FROM pack_rows) WHERE document_id IS NOT NULL AND tag IS NOT NULL
), u AS (SELECT * FROM t WHERE tag <> ''),
c AS (SELECT tag, count(*) AS n FROM u GROUP BY 1), total AS (SELECT count(DISTINCT document_id) AS n FROM u),
p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM u a JOIN u b USING (document_id) WHERE a.tag < b.tag GROUP BY ALL),
s AS (SELECT tag_a, tag_b, n_ab, x.n AS n_a, y.n AS n_b, total.n AS n FROM p JOIN c x ON x.tag = tag_a JOIN c y ON y.tag = tag_b, total)
"""


def _p5_table(spark, d):
    """All documents, those of agent shared at first with the agent's name among their tags; then these as they are.

    The second batch takes back what the name counted for: pairs and an item that are gone afterwards.
    """
    rows = table(spark, d, "pack_rows")
    every = cut_lineage(baskets(rows, "document_id", "tags"), "baskets")
    own = every.join(rows.where("agent_id = 'shared'").select(F.col("document_id").alias("basket")), "basket", "left_semi")
    named = own.select("basket", F.array_sort(F.array_distinct(F.concat("items", F.array(F.lit("agent:shared"))))).alias("items"))
    pairs = PairTable.new(spark)
    pairs.apply(every.join(own.select("basket"), "basket", "left_anti").unionByName(named))
    pairs.apply(own)
    return pairs


@llm.query("p5_found", _P5 + "SELECT tag_a, tag_b FROM s WHERE n_ab >= 3 AND 1000 * n_ab >= 3 * n AND n_ab * n >= 3 * n_a * n_b")
def p5_found(spark, d):
    scores = _p5_table(spark, d).scores(3, 0.003)
    return scores.where("n_ab * n >= 3 * n_a * n_b").select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


@llm.query("p5_scores", _P5 + "SELECT tag_a, tag_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) AS lift FROM s")
def p5_scores(spark, d):
    scores = _p5_table(spark, d).scores()
    return scores.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


@llm.query("p6_ids")
def p6_ids(spark, d):
    return encode.encode(table(spark, d, "documents"), "doc_id", "text", TOKENIZER)


def _p7(spark, d):
    sizes = encode.token_counts(table(spark, d, "documents"), "doc_id", "text", TOKENIZER)
    return packing.harmonic_packs(sizes, "doc_id", "n_tokens", CAPACITY)


@llm.query("p7_packs")
def p7_packs(spark, d):
    return _p7(spark, d)


@llm.query("p7_fill")
def p7_fill(spark, d):
    return packing.fill_report(_p7(spark, d), CAPACITY)


@llm.query("p8_found")
def p8_found(spark, d):
    return sentences.sentences(table(spark, d, "documents"), "doc_id", "text").distinct()
