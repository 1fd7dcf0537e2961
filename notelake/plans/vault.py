"""Queries over the vault: documents, links, graph, search, context, duplicates, changes."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions.embed import signature
from ..operators import context, dedupe, documents, graph, search, snapshots
from ..session import cut_lineage
from ..sources import vault as source
from ..sources.tables import table
from .registry import Registry
from .sql import embedded

vault = Registry()
QUERY = "orphan report vault"
HUB, HUB_PATH = "Atlas Index", "agents/shared/atlas/atlas-index.md"

#: The same vault stated in SQL, down to resolved links; every query below goes on from here.
_V = r"""
WITH RECURSIVE n0 AS (
  SELECT id, agent_id, title, path, content, tags, links, created_at, updated_at FROM vault_notes
  UNION ALL SELECT id, agent_id, title, path, content, tags, links, created_at, updated_at FROM hub_notes
), n1 AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, path, content NULLS FIRST) AS rn FROM n0 WHERE id IS NOT NULL AND path IS NOT NULL
), note AS (SELECT * FROM n1 WHERE rn = 1),
w AS (
  SELECT path, created_at, updated_at, '---' || chr(10) || 'title: "' || coalesce(title, '') || '"' || chr(10) || 'agent: ' || coalesce(agent_id, 'shared') || chr(10) || '---' || chr(10)
    || coalesce(content, '') || chr(10) || chr(10)
    || coalesce(array_to_string(list_transform(coalesce(links, []), lambda t, i: CASE (i - 1) % 4 WHEN 0 THEN '## See [[' || t || ']]' WHEN 1 THEN '- [ ] Check [[' || t || ']] priority: high' WHEN 2 THEN 'Related: [[' || t || ']] priority: low' ELSE '- [[' || t || ']]' END), chr(10)), '')
    || chr(10) || chr(10)
    || coalesce(array_to_string(list_transform(list_filter(list_transform(coalesce(tags, []), lambda t: lower(trim(regexp_replace(trim(t), '^#+', '')))), lambda t: t <> ''), lambda t: '#' || t), ' '), '') AS content
  FROM note
), d AS (
  SELECT substr(sha256(path), 1, 24) AS id, path, content, created_at, updated_at,
    regexp_extract(content, 'agent: ([^\n]*)\n', 1) AS agent_id, regexp_replace(trim(regexp_extract(content, 'title: "([^\n]*)"\n', 1)), '(?i)\.md$', '') AS title,
    list_distinct(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(content, '^---\n([\s\S]*?)\n---\n?', ''), '```[\s\S]*?```', '', 'g'), '~~~[\s\S]*?~~~', '', 'g'), '(^|\s)#([A-Za-z0-9][A-Za-z0-9_-]*)', 2)) AS tags
  FROM w
), ln AS (
  SELECT id, agent_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM d
), vis AS (
  SELECT * FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) % 2 AS fenced FROM ln) WHERE fenced = 0 AND line LIKE '%[[%'
), pri AS (
  SELECT *, CASE
    WHEN regexp_matches(line, '(?i)\b(priority|prioridade|importance|importancia)\s*[:=]\s*(critical|critica|urgent|urgente|p0)\b') OR regexp_matches(line, '(?i)#(critical|critica|urgent|urgente|p0)\b') THEN 'critical'
    WHEN regexp_matches(line, '(?i)\b(priority|prioridade|importance|importancia)\s*[:=]\s*(high|alta|important|importante|p1)\b') OR regexp_matches(line, '(?i)#(high-priority|important|importante|p1)\b') THEN 'high'
    WHEN regexp_matches(line, '(?i)\b(priority|prioridade|importance|importancia)\s*[:=]\s*(normal|medium|media|p2)\b') OR regexp_matches(line, '(?i)#(normal-priority|medium-priority|p2)\b') THEN 'normal'
    WHEN regexp_matches(line, '(?i)\b(priority|prioridade|importance|importancia)\s*[:=]\s*(low|baixa|p3)\b') OR regexp_matches(line, '(?i)#(low-priority|baixa-prioridade|p3)\b') THEN 'low' END AS priority
  FROM vis
), wt AS (
  SELECT *, 1 + CASE priority WHEN 'normal' THEN 1 WHEN 'high' THEN 3 WHEN 'critical' THEN 6 ELSE 0 END
    + CASE WHEN regexp_matches(line, '^\s{0,3}#{1,6}\s+') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(line, '(?i)^\s*[-*]\s+\[[ x]\]') THEN 1 ELSE 0 END AS weight,
    regexp_extract_all(line, '\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1) AS found
  FROM pri
), ref0 AS (SELECT id, agent_id, pos, weight, priority, unnest(found) AS raw, generate_subscripts(found, 1) - 1 AS nth FROM wt),
ref AS (SELECT id AS from_document_id, agent_id, pos AS line, nth, regexp_replace(trim(raw), '(?i)\.md$', '') AS to_title, weight, priority FROM ref0 WHERE trim(raw) <> ''),
wk AS (
  SELECT from_document_id, lower(to_title) AS title_key, least(12, sum(weight)) AS weight, max(CASE priority WHEN 'low' THEN 0 WHEN 'normal' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END) AS r
  FROM ref GROUP BY ALL
), wp AS (
  SELECT *, CASE WHEN r = 0 AND weight = 1 THEN 0 ELSE greatest(coalesce(r, 0), CASE WHEN weight >= 8 THEN 3 WHEN weight >= 4 THEN 2 ELSE 1 END) END AS level FROM wk
), tm AS (SELECT agent_id, lower(title) AS title_key, arg_min(id, path) AS id FROM d GROUP BY ALL),
l AS (
  SELECT * FROM (
    SELECT t.from_document_id, t.to_title, coalesce(o.id, s.id) AS to_document_id, weight::INTEGER AS weight, ['low', 'normal', 'high', 'critical'][level + 1] AS priority
    FROM (SELECT DISTINCT from_document_id, agent_id, to_title FROM ref) t
    JOIN wp ON wp.from_document_id = t.from_document_id AND wp.title_key = lower(t.to_title)
    LEFT JOIN tm o ON o.agent_id = t.agent_id AND o.title_key = lower(t.to_title)
    LEFT JOIN tm s ON s.agent_id = 'shared' AND s.title_key = lower(t.to_title)
  ) WHERE to_document_id IS NULL OR to_document_id <> from_document_id
), ends AS (SELECT from_document_id AS id FROM l UNION SELECT to_document_id FROM l WHERE to_document_id IS NOT NULL),
orp AS (SELECT * FROM d WHERE id NOT IN (SELECT id FROM ends))
"""


def _docs(spark, d):
    return documents.documents(source.written(source.notes(spark, d)))


def _both(spark, d, what="vault"):
    """Documents and links, written once and read for the several uses a query has for them."""
    docs = cut_lineage(_docs(spark, d), f"{what}-documents")
    return docs, cut_lineage(documents.links(docs), f"{what}-links")


@vault.query("documents", _V + "SELECT id, agent_id, title, path, list_sort(tags) AS tags, length(content) AS n_chars FROM d")
def q_documents(spark, d):
    return _docs(spark, d).select("id", "agent_id", "title", "path", F.sort_array("tags").alias("tags"), F.length("content").cast("bigint").alias("n_chars"))


@vault.query("front_matter", _V + "SELECT id, unnest(['title', 'agent']) AS key, unnest([regexp_extract(content, 'title: \"([^\\n]*)\"\\n', 1), agent_id]) AS value FROM d")
def q_front_matter(spark, d):
    return _docs(spark, d).select("id", F.explode("frontmatter").alias("key", "value"))


@vault.query("wiki_references", _V + "SELECT from_document_id, line::INTEGER AS line, nth::INTEGER AS nth, to_title, weight::INTEGER AS weight, priority FROM ref")
def q_references(spark, d):
    return documents.references(_docs(spark, d)).drop("agent_id")


@vault.query("links", _V + "SELECT * FROM l")
def q_links(spark, d):
    return documents.links(cut_lineage(_docs(spark, d), "documents"))


_JOINED = """, j AS (
  SELECT coalesce(a.agent_id, 'shared') AS agent_id, coalesce(a.title, 'Unknown') AS from_title, coalesce(a.path, '') AS from_path, coalesce(b.title, to_title) AS to_title, b.path AS to_path, weight, priority, to_title AS written_title
  FROM l LEFT JOIN d a ON a.id = from_document_id LEFT JOIN d b ON b.id = to_document_id)
"""


@vault.query("links_joined", _V + _JOINED + "SELECT * EXCLUDE (written_title) FROM j")
def q_links_joined(spark, d):
    return graph.joined_links(*_both(spark, d)).drop("written_title")


@vault.query("links_listed", _V + _JOINED + "SELECT * EXCLUDE (written_title) FROM j ORDER BY lower(from_title), from_title, from_path, lower(to_title), to_title, weight LIMIT 300")
def q_links_listed(spark, d):
    return graph.listed_links(*_both(spark, d), 300)


@vault.query("graph_nodes", _V + "SELECT id, agent_id, title, path, '' AS content, list_sort(tags) AS tags FROM d")
def q_graph_nodes(spark, d):
    return graph.summary_nodes(_docs(spark, d)).withColumn("tags", F.sort_array("tags"))


@vault.query("graph_edges", _V + "SELECT from_document_id AS source, to_document_id AS target, to_title AS target_title, weight, priority FROM l")
def q_graph_edges(spark, d):
    return graph.summary_edges(*_both(spark, d))


@vault.query("graph_node", _V + f"SELECT id, agent_id, title, path, content, list_sort(tags) AS tags FROM d WHERE path = '{HUB_PATH}'")
def q_graph_node(spark, d):
    return graph.node(_docs(spark, d), hashlib.sha256(HUB_PATH.encode()).hexdigest()[:24], "shared").withColumn("tags", F.sort_array("tags"))


@vault.query("tag_counts", _V + "SELECT tag, count(*) AS documents FROM (SELECT unnest(tags) AS tag FROM d) GROUP BY 1")
def q_tag_counts(spark, d):
    return graph.tag_counts(_docs(spark, d))


@vault.query("backlinks", _V + _JOINED + "SELECT * EXCLUDE (written_title) FROM j WHERE lower(written_title) = 'atlas index'")
def q_backlinks(spark, d):
    return graph.backlinks(*_both(spark, d), HUB)


@vault.query("broken_links", _V + "SELECT d.title, d.path, l.to_title AS missing FROM l JOIN d ON d.id = l.from_document_id WHERE to_document_id IS NULL")
def q_broken(spark, d):
    return graph.broken_links(*_both(spark, d))


@vault.query("orphans", _V + "SELECT id, agent_id, title, path FROM orp")
def q_orphans(spark, d):
    return graph.orphans(*_both(spark, d)).select("id", "agent_id", "title", "path")


@vault.query("docs_per_agent", _V + "SELECT agent_id, count(*) AS documents FROM d GROUP BY 1")
def q_agents(spark, d):
    return _docs(spark, d).groupBy("agent_id").agg(F.count("*").alias("documents"))


@vault.query("graph_edges_of_agent", _V + "SELECT l.* FROM l JOIN d ON d.id = from_document_id WHERE agent_id = 'lint-scout'")
def q_edges(spark, d):
    return graph.links_of(*_both(spark, d), "lint-scout")


@vault.query("degrees", _V + """, e AS (SELECT from_document_id AS id, least(greatest(weight, 1), 8) AS w FROM l UNION ALL SELECT to_document_id, least(greatest(weight, 1), 8) FROM l WHERE to_document_id IS NOT NULL)
SELECT d.id, coalesce(sum(w), 0)::BIGINT AS degree FROM d LEFT JOIN e ON e.id = d.id GROUP BY 1""")
def q_degrees(spark, d):
    return graph.degrees(*_both(spark, d))


_STATS = """, s AS (SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM d)) AS tags,
  (SELECT count(*) FROM l) AS links, (SELECT count(to_document_id) FROM l) AS resolved_links, (SELECT count(*) FROM orp) AS orphans)
"""


@vault.query("vault_stats", _V + _STATS + "SELECT *, links - resolved_links AS broken_links, links = resolved_links AS ok FROM s")
def q_stats(spark, d):
    return graph.stats(*_both(spark, d))


@vault.query(
    "extended_stats",
    _V + _STATS + """SELECT *, links - resolved_links AS broken_links, links = resolved_links AS ok,
  (SELECT count(*) FROM l WHERE priority = 'low') AS low_links, (SELECT count(*) FROM l WHERE priority = 'normal') AS normal_links,
  (SELECT count(*) FROM l WHERE priority = 'high') AS high_links, (SELECT count(*) FROM l WHERE priority = 'critical') AS critical_links,
  round(resolved_links / links, 4) AS resolved_ratio, round((links - resolved_links) / links, 4) AS broken_ratio, round(orphans / documents, 4) AS orphan_ratio FROM s""",
)
def q_extended(spark, d):
    return graph.extended_stats(*_both(spark, d))


@vault.query("priority_histogram", _V + "SELECT priority, count(*) AS links FROM l GROUP BY 1")
def q_priorities(spark, d):
    return documents.links(cut_lineage(_docs(spark, d), "documents")).groupBy("priority").agg(F.count("*").alias("links"))


@vault.query(
    "components",
    _V + """, e AS (SELECT from_document_id AS a, to_document_id AS b FROM l WHERE to_document_id IS NOT NULL UNION SELECT to_document_id, from_document_id FROM l WHERE to_document_id IS NOT NULL),
reach(id, c) AS (SELECT id, id FROM d UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id WHERE reach.c < e.b)
SELECT id, min(c) AS component FROM reach GROUP BY 1""",
)
def q_components(spark, d):
    docs, links = _both(spark, d)
    return graph.components(docs, graph.edges_between(docs, links))


#: The query's vector, computed in SQL.
_Q = embedded("qe", f"(SELECT 0 AS id, '{QUERY}' AS text)")


def _score_sql(cap: int, rows: str) -> str:
    hits = lambda text, t: f"(length({text}) - length(replace({text}, '{t}', ''))) // {len(t)}"
    parts = [
        f"{hits('t', t)} * 5 + {hits('g', t)} * 4 + {hits('p', t)} * 2 + least({hits('c', t)}, {cap})" for t in search.query_tokens(QUERY)
    ]
    return (
        "f AS (SELECT *, lower(strip_accents(coalesce(title, ''))) AS t, lower(strip_accents(coalesce(array_to_string(tags, ' '), ''))) AS g, lower(strip_accents(coalesce(path, ''))) AS p, "
        f"lower(strip_accents(coalesce(content, ''))) AS c FROM {rows}), sc AS (SELECT *, ({' + '.join(parts)})::INTEGER AS text_score FROM f)"
    )


_COS = (
    "CASE WHEN len(embedding) > 0 THEN coalesce((SELECT CASE WHEN isnan(v) THEN 0.0 ELSE v END FROM (SELECT list_sum(list_transform(list_zip(embedding[:192], q[:len(embedding)]), lambda x: x[1] * x[2])) "
    "/ nullif(sqrt(list_sum(list_transform(embedding[:192], lambda x: x * x))) * sqrt(list_sum(list_transform(q[:len(embedding)], lambda x: x * x))), 0.0) AS v)), 0.0) ELSE 0.0 END"
)


@vault.query("search_fts", "WITH " + _score_sql(6, "(SELECT DISTINCT * FROM index_rows)") + " SELECT chunk_id, document_id, title, max(text_score)::DOUBLE AS score FROM sc WHERE text_score > 0 GROUP BY ALL ORDER BY score DESC, lower(min(title)), min(title), min(path), min(chunk_ordinal), chunk_id LIMIT 25")
def q_fts(spark, d):
    return search.search(table(spark, d, "index_rows"), QUERY, 25, "fts").select("chunk_id", "document_id", "title", "score")


@vault.query("search_semantic_all", f"WITH {_Q} SELECT chunk_id, round(max(s), 6) AS score FROM (SELECT chunk_id, {_COS} AS s FROM index_rows, (SELECT x AS q FROM qe)) WHERE s > 0 GROUP BY 1")
def q_semantic(spark, d):
    hits = search.scored(table(spark, d, "index_rows"), QUERY, "semantic")
    return hits.groupBy("chunk_id").agg(F.round(F.max("score"), 6).alias("score"))


@vault.query(
    "search_hybrid",
    f"WITH {_Q}, " + _score_sql(6, "(SELECT DISTINCT * FROM index_rows)") + f", h AS (SELECT *, text_score + 8 * {_COS} AS score FROM sc, (SELECT x AS q FROM qe)) "
    "SELECT chunk_id, document_id, title, text_score, round(max(score), 6) AS score FROM h WHERE score > 0 GROUP BY ALL ORDER BY max(score) DESC, chunk_id LIMIT 10",
)
def q_hybrid(spark, d):
    return search.search(table(spark, d, "index_rows"), QUERY, 10, "hybrid").select("chunk_id", "document_id", "title", "text_score", F.round("score", 6).alias("score"))


@vault.query("search_packs", "WITH " + _score_sql(5, "pack_rows") + " SELECT chunk_id, document_id, max(text_score)::DOUBLE AS score FROM sc WHERE text_score > 0 AND agent_id = 'shared' GROUP BY ALL ORDER BY score DESC, lower(min(title)), min(title), min(path), min(chunk_ordinal), chunk_id LIMIT 20")
def q_packs(spark, d):
    return search.search(table(spark, d, "pack_rows"), QUERY, 20, "fts", "shared", search.PACK_CAP).select("chunk_id", "document_id", "score")


@vault.query("search_documents", _V + ", " + _score_sql(6, "d") + " SELECT id, text_score AS score FROM sc WHERE text_score > 0 ORDER BY text_score DESC, id LIMIT 1200")
def q_search_documents(spark, d):
    return search.search_documents(_docs(spark, d), QUERY)


#: Many hits are wanted here, so that documents have several chunks among them.
_HITS = (
    "WITH RECURSIVE " + _score_sql(6, "(SELECT DISTINCT * FROM index_rows)")
    + """, hit AS (SELECT chunk_id, document_id, title, content, chunk_ordinal, max(text_score)::DOUBLE AS score FROM sc WHERE text_score > 0 GROUP BY ALL ORDER BY score DESC, lower(min(title)), min(title), min(path), min(chunk_ordinal), chunk_id LIMIT 60),
a AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(chunk_ordinal, 2147483647), chunk_id) AS i, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, lower(title), coalesce(chunk_ordinal, 2147483647), chunk_id) AS best, max(score) OVER (PARTITION BY document_id) AS ds FROM hit),
b AS (SELECT *, max(CASE WHEN best = 1 THEN i END) OVER (PARTITION BY document_id) AS piv FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY abs(i - piv), i) AS doc_rank FROM b),
o AS (SELECT *, row_number() OVER (ORDER BY ds DESC, document_id, doc_rank) AS position, ceil(length(coalesce(content, '')) / 4)::INTEGER AS cost FROM c WHERE doc_rank <= 3)
"""
)


_RUN = """, run(i, used, closed, took) AS (
  SELECT 0::BIGINT, 0, NULL::VARCHAR, false
  UNION ALL SELECT run.i + 1, CASE WHEN o.document_id IS NOT DISTINCT FROM closed OR used + cost > 2000 THEN used ELSE used + cost END,
    CASE WHEN o.document_id IS NOT DISTINCT FROM closed THEN closed WHEN used + cost > 2000 THEN o.document_id ELSE closed END,
    NOT (o.document_id IS NOT DISTINCT FROM closed OR used + cost > 2000)
  FROM run JOIN o ON o.position = run.i + 1)"""


def _hits(spark, d):
    return search.search(table(spark, d, "index_rows"), QUERY, 60, "fts")


@vault.query("context_order", _HITS + "SELECT position::INTEGER AS position, document_id, chunk_id, doc_rank::INTEGER AS doc_rank, cost FROM o")
def q_context_order(spark, d):
    return context.middle_out(_hits(spark, d)).select("position", "document_id", "chunk_id", "doc_rank", "cost")


@vault.query(
    "context_sections",
    _HITS + _RUN + """
SELECT row_number() OVER (ORDER BY position)::INTEGER AS section, document_id, chunk_id, cost FROM run JOIN o ON o.position = run.i WHERE took""",
)
def q_context(spark, d):
    return context.context_sections(_hits(spark, d)).select("section", "document_id", "chunk_id", "cost")


_PACKAGE = f"""WITH RECURSIVE {_Q}, {_score_sql(6, "(SELECT DISTINCT * FROM index_rows)")}, h AS (SELECT *, text_score + 8 * {_COS} AS score FROM sc, (SELECT x AS q FROM qe)),
hit AS (SELECT * FROM (SELECT chunk_id, document_id, title, path, content, tags, chunk_ordinal, max(score) AS score FROM h WHERE score > 0 GROUP BY ALL) ORDER BY score DESC, lower(title), title, path, chunk_ordinal, chunk_id LIMIT 12),
""" + _HITS[_HITS.index("a AS (SELECT") :] + _RUN + """,
sec AS (SELECT row_number() OVER (ORDER BY position) AS n, o.* FROM run JOIN o ON o.position = run.i WHERE took)
SELECT count(*) AS n_sections, '# Context' || chr(10) || 'Query: """ + QUERY + """' || chr(10) || chr(10) || coalesce(string_agg('## ' || n || '. ' || coalesce(title, '') || chr(10) || 'Source: ' || coalesce(path, '') || chr(10)
  || CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(list_transform(tags, lambda t: '#' || t), ' ') || chr(10) ELSE '' END || 'Score: ' || printf('%.3f', score) || chr(10) || 'Mode: hybrid' || chr(10) || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY n), 'No relevant context found.') AS content,
  '""" + QUERY + """' AS query FROM sec"""


@vault.query("context_package", _PACKAGE)
def q_package(spark, d):
    hits = search.search(table(spark, d, "index_rows"), QUERY, 12)
    return context.render(context.context_sections(hits), QUERY)


@vault.query(
    "duplicates_exact",
    r"""WITH b AS (SELECT DISTINCT replace(path, chr(92), '/') AS path, sha256(trim(regexp_replace(regexp_replace(coalesce(content, ''), '(?m)^---\n[\s\S]*?\n---\n?', ''), '(?m)^#\s+.+\n+', ''), chr(10) || chr(13) || chr(9) || ' ')) AS h FROM vault_notes WHERE path IS NOT NULL),
f AS (SELECT h, min(path) AS left_path FROM b GROUP BY 1 HAVING count(*) > 1)
SELECT left_path, path AS right_path FROM b JOIN f USING (h) WHERE path <> left_path""",
)
def q_dup_exact(spark, d):
    return dedupe.exact_duplicates(table(spark, d, "vault_notes").where("path IS NOT NULL"))


@vault.query(
    "duplicates_semantic",
    """WITH v AS (SELECT chunk_id AS id, min(embedding) AS x FROM index_rows WHERE len(embedding) = 192 GROUP BY 1),
u AS (SELECT * FROM v WHERE list_sum(list_transform(x, lambda e: abs(e))) > 0 AND NOT isnan(list_sum(x)) AND NOT isinf(list_sum(x)))
SELECT a.id AS left_id, b.id AS right_id, round(list_cosine_similarity(a.x, b.x), 4) AS score FROM u a JOIN u b ON a.id < b.id WHERE list_cosine_similarity(a.x, b.x) >= 0.92""",
)
def q_dup_semantic(spark, d):
    return dedupe.semantic_duplicates(table(spark, d, "index_rows"), "chunk_id", "embedding", 192)


#: Notes as they stand in the table, each with its heading, and all their duplicates.
_DUP = r"""WITH n AS (SELECT regexp_replace(replace(path, chr(92), '/'), '^\./', '') AS path, min({'title': coalesce(title, ''), 'content': '# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '')}) AS n FROM vault_notes WHERE path IS NOT NULL GROUP BY 1),
c AS (SELECT path, n.title AS title, n.content AS content, trim(regexp_replace(regexp_replace(n.content, '(?m)^---\n[\s\S]*?\n---\n?', ''), '(?m)^#\s+.+\n+', ''), chr(10) || chr(13) || chr(9) || ' ') AS strict FROM n),
b AS (SELECT *, trim(regexp_replace(strict, '[\s\x0b\x{A0}]+', ' ', 'g')) AS body, sha256(strict) AS h FROM c),
x AS (SELECT min(path) AS left_path, h FROM b GROUP BY h), exact AS (SELECT left_path, path AS right_path, 'exact' AS kind, 1.0::DOUBLE AS score FROM b JOIN x USING (h) WHERE path <> left_path),
t AS (SELECT path AS id, title || chr(10) || body AS text FROM b), """ + embedded("e", "t") + r""",
w AS (SELECT path, list_filter(list_transform(regexp_extract_all(title, '[\p{L}\p{N}_-]+'), lambda s: lower(s)), lambda s: length(s) > 2) AS tw, list_filter(list_transform(regexp_extract_all(body, '[\p{L}\p{N}_-]+'), lambda s: lower(s)), lambda s: length(s) > 2) AS bw FROM b),
s AS (SELECT a.id AS left_path, z.id AS right_path, list_cosine_similarity(a.x, z.x) AS score FROM e a JOIN e z ON a.id < z.id WHERE list_cosine_similarity(a.x, z.x) >= 0.92),
near AS (SELECT left_path, right_path, 'semantic' AS kind, round(score, 4) AS score FROM s JOIN w p ON p.path = left_path JOIN w q ON q.path = right_path
  WHERE (score >= 0.975 OR list_has_any(p.tw, q.tw) OR list_has_any(p.bw, q.bw)) AND NOT EXISTS (SELECT 1 FROM exact z WHERE z.left_path = s.left_path AND z.right_path = s.right_path)),
dup AS (SELECT * FROM exact UNION ALL SELECT * FROM near)
"""


def _plain_notes(spark, d):
    title = F.coalesce("title", F.lit(""))
    return table(spark, d, "vault_notes").select("path", "agent_id", "title", F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("content"))


@vault.query("duplicates", _DUP + "SELECT * FROM dup ORDER BY score DESC, left_path, right_path LIMIT 25")
def q_duplicates(spark, d):
    return dedupe.scan(_plain_notes(spark, d))


@vault.query("duplicates_of_note", _DUP + "SELECT * FROM dup WHERE left_path = (SELECT min(left_path) FROM exact) OR right_path = (SELECT min(left_path) FROM exact)")
def q_duplicates_of_note(spark, d):
    """All duplicates of the first note that has an exact one."""
    return dedupe.scan(_plain_notes(spark, d), focus=dedupe.FIRST, limit=None)


_RESOLVE = _DUP + r""", pr AS (SELECT e.left_path, e.right_path, l.title AS lt, l.content AS lc, r.title AS rt, r.content AS rc, r.body AS rb FROM exact e JOIN b l ON l.path = left_path JOIN b r ON r.path = right_path),
rel AS (SELECT *, CASE WHEN contains(regexp_replace(lower(lc), '\[\[\s*', '[[', 'g'), '[[' || lower(rt)) THEN lc ELSE rtrim(lc, chr(10) || chr(13) || chr(9) || ' ') || chr(10) || chr(10) || 'Related: [[' || rt || ']] priority: low #related-to' || chr(10) END AS l1,
  CASE WHEN contains(regexp_replace(lower(rc), '\[\[\s*', '[[', 'g'), '[[' || lower(lt)) THEN rc ELSE rtrim(rc, chr(10) || chr(13) || chr(9) || ' ') || chr(10) || chr(10) || 'Related: [[' || lt || ']] priority: low #related-to' || chr(10) END AS r1 FROM pr),
"""


def _resolved(spark, d, action):
    notes = _plain_notes(spark, d).where("path IS NOT NULL")
    one = notes.groupBy("path").agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), "content")).alias("n")).select("path", "n.*")
    one = cut_lineage(one, "notes")
    return dedupe.resolve(one, dedupe.exact_duplicates(one), action)


_FIRST = "SELECT path, arg_min(content, (left_path, right_path)) AS content FROM ch GROUP BY 1"


@vault.query("duplicates_link", _RESOLVE + "ch AS (SELECT left_path, right_path, left_path AS path, l1 AS content FROM rel UNION ALL SELECT left_path, right_path, right_path, r1 FROM rel) " + _FIRST)
def q_duplicates_link(spark, d):
    return _resolved(spark, d, "link")


@vault.query("duplicates_ignore", _RESOLVE + "ch AS (SELECT left_path, right_path, left_path AS path, l1 AS content FROM rel) " + _FIRST)
def q_duplicates_ignore(spark, d):
    return _resolved(spark, d, "ignore")


@vault.query(
    "duplicates_merge",
    _RESOLVE + """ch AS (SELECT left_path, right_path, left_path AS path, CASE WHEN contains(l1, '## Merged Memory From [[' || rt || ']]') THEN l1 ELSE rtrim(l1, chr(10) || chr(13) || chr(9) || ' ') || chr(10) || chr(10) || '## Merged Memory From [[' || rt || ']]' || chr(10) || chr(10) || rb || chr(10) END AS content FROM rel
UNION ALL SELECT left_path, right_path, right_path, CASE WHEN contains(r1, 'Merged into [[' || lt || ']]') THEN r1 ELSE rtrim(r1, chr(10) || chr(13) || chr(9) || ' ') || chr(10) || chr(10) || 'Merged into [[' || lt || ']] priority: low #related-to' || chr(10) END FROM rel) """ + _FIRST,
)
def q_duplicates_merge(spark, d):
    return _resolved(spark, d, "merge")


@vault.query(
    "vector_signature",
    """WITH u AS (SELECT DISTINCT chunk_id, embedding AS x FROM index_rows WHERE chunk_id IS NOT NULL AND len(embedding) > 0 AND NOT isnan(list_sum(embedding)) AND NOT isinf(list_sum(embedding))),
s AS (SELECT chunk_id, list_sort(list_filter(list_transform(x, lambda v, i: {'a': -abs(v), 'i': i - 1, 'p': v >= 0}), lambda e: e.a < 0))[1:24] AS s FROM u)
SELECT chunk_id, pos::INTEGER AS place, CASE WHEN e.p THEN 'p:' ELSE 'n:' END || e.i AS bucket FROM (SELECT chunk_id, unnest(s) AS e, generate_subscripts(s, 1) AS pos FROM s)""",
)
def q_vector_signature(spark, d):
    """The 24 dimensions of largest size of each chunk's vector, with their signs."""
    rows = table(spark, d, "index_rows").where("chunk_id IS NOT NULL AND size(embedding) > 0").where(F.forall("embedding", lambda x: F.abs(x) < float("inf")))
    one = rows.select("chunk_id", "embedding").distinct().select("chunk_id", F.posexplode(signature(F.col("embedding"), 24)).alias("place", "bucket"))
    return one.withColumn("place", F.col("place") + 1)


@vault.query(
    "vector_classes",
    """WITH v AS (SELECT chunk_id AS id, min(embedding) AS x FROM index_rows WHERE len(embedding) = 192 AND chunk_id IS NOT NULL GROUP BY 1),
u AS (SELECT * FROM v WHERE list_sum(list_transform(x, lambda e: abs(e))) > 0 AND NOT isnan(list_sum(x)) AND NOT isinf(list_sum(x))),
c AS (SELECT x, min(id) AS class_id FROM u GROUP BY 1), k AS (SELECT a.class_id, count(*) AS n FROM c a JOIN c b ON a.class_id <> b.class_id WHERE list_cosine_similarity(a.x, b.x) >= 0.92 GROUP BY 1)
SELECT id, class_id, coalesce(n, 0) AS n_links FROM u JOIN c USING (x) LEFT JOIN k USING (class_id)""",
)
def q_vector_classes(spark, d):
    return dedupe.vector_classes(table(spark, d, "index_rows"), "chunk_id", "embedding", 192)


@vault.query(
    "snapshot_changes",
    """WITH p AS (SELECT path, max(updated_at) AS m, arg_max(strlen(coalesce(content, '')), updated_at) AS s FROM vault_notes WHERE path IS NOT NULL AND created_at < '2026-03-01' AND updated_at < '2026-04-01' GROUP BY 1),
c AS (SELECT path, max(updated_at) AS m, arg_max(strlen(coalesce(content, '')), updated_at) AS s FROM vault_notes WHERE path IS NOT NULL AND id NOT IN (SELECT document_id FROM removed_notes WHERE document_id IS NOT NULL AND restored_at IS NULL) GROUP BY 1)
SELECT path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN p.path IS NULL THEN 'new' WHEN p.m IS DISTINCT FROM c.m OR p.s IS DISTINCT FROM c.s THEN 'changed' ELSE 'unchanged' END AS change FROM p FULL JOIN c USING (path)""",
)
def q_changes(spark, d):
    """The vault as it was in spring against the vault without the notes removed for good."""
    notes = table(spark, d, "vault_notes")
    gone = table(spark, d, "removed_notes").where("restored_at IS NULL").select(F.col("document_id").alias("id"))
    before = snapshots.snapshot(notes.where("created_at < '2026-03-01' AND updated_at < '2026-04-01'"))
    return snapshots.changes(before, snapshots.snapshot(notes.join(gone, "id", "left_anti")))


@vault.query(
    "migration_plan",
    """WITH s AS (SELECT path, arg_max(coalesce(content, ''), updated_at) AS body FROM vault_notes WHERE path IS NOT NULL GROUP BY 1),
t AS (SELECT path, arg_max(coalesce(content, ''), updated_at) AS body FROM (SELECT path, CASE WHEN agent_id = 'lint-scout' THEN content || '!' ELSE content END AS content, updated_at FROM vault_notes WHERE path IS NOT NULL AND agent_id <> 'shared') GROUP BY 1)
SELECT path, strlen(s.body)::BIGINT AS bytes, CASE WHEN t.path IS NULL THEN 'copy' WHEN t.body = s.body THEN 'unchanged' ELSE 'conflict' END AS kind FROM s LEFT JOIN t USING (path)""",
)
def q_migration(spark, d):
    """Into a vault that holds the other agents' notes already, those of one agent in another version."""
    notes = table(spark, d, "vault_notes")
    there = notes.where("agent_id <> 'shared'").withColumn("content", F.when(F.col("agent_id") == "lint-scout", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return snapshots.migration_plan(notes, there)


@vault.query("migration_counts", "SELECT kind, count(*) AS notes, sum(bytes)::BIGINT AS bytes FROM (" + vault.sql["migration_plan"] + ") GROUP BY 1")
def q_migration_counts(spark, d):
    return q_migration(spark, d).groupBy("kind").agg(F.count("*").alias("notes"), F.sum("bytes").alias("bytes"))


@vault.query(
    "vault_checks",
    _V + _STATS + """SELECT 'vault' AS "check", true AS ok, 1::BIGINT AS n UNION ALL SELECT 'markdown-files', count(*) > 0, count(*) FROM note
UNION ALL SELECT 'index', documents > 0, documents FROM s UNION ALL SELECT 'broken-links', links = resolved_links, links - resolved_links FROM s""",
)
def q_checks(spark, d):
    return graph.checks(*_both(spark, d), source.notes(spark, d))


@vault.query(
    "graph_signature",
    _V + """, ns AS (SELECT count(*) AS nodes, coalesce(sum(('0x' || substr(sha256(concat(coalesce(id, ''), '|', coalesce(agent_id, ''), '|', coalesce(title, ''), '|', coalesce(path, ''))), 1, 15))::BIGINT), 0)::VARCHAR AS s FROM d),
es AS (SELECT count(*) AS edges, coalesce(sum(('0x' || substr(sha256(concat(coalesce(from_document_id, ''), '|', coalesce(to_document_id, ''), '|', coalesce(to_title, ''), '|', weight, '|', priority)), 1, 15))::BIGINT), 0)::VARCHAR AS s FROM l)
SELECT nodes, edges, sha256(concat(nodes, '|', ns.s, '|', edges, '|', es.s)) AS signature FROM ns, es""",
)
def q_signature(spark, d):
    return graph.signature(*_both(spark, d))


@vault.query(
    "filter_nodes",
    _V + """, t AS (SELECT id, lower(strip_accents(concat_ws(' ', title, path, array_to_string(tags, ' ')))) AS x FROM d)
SELECT id, CASE WHEN starts_with(x, 'backlink') THEN 4 ELSE 1 END AS score FROM t WHERE contains(x, 'backlink')""",
)
def q_filter_nodes(spark, d):
    return graph.filter_nodes(_docs(spark, d), "Backlink", 100_000)


@vault.query(
    "storage_stats",
    "SELECT count(*) AS files, sum(strlen(coalesce(content, '')))::BIGINT AS bytes, round(avg(strlen(coalesce(content, ''))))::BIGINT AS mean_bytes, strftime(min(updated_at), '%Y-%m-%d %H:%M:%S.%f') AS first_change, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S.%f') AS last_change FROM vault_notes",
)
def q_storage(spark, d):
    return graph.storage(table(spark, d, "vault_notes"))


@vault.query("group_labels", _V + """, p AS (SELECT id, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM d)
SELECT id, coalesce(CASE WHEN s[1] = 'agents' THEN s[3] ELSE s[1] END, 'root') AS label FROM p""")
def q_labels(spark, d):
    from ..operators.layout import group_label

    return _docs(spark, d).select("id", group_label(F.col("path")).alias("label"))
