"""Queries on writing and importing notes, chunking, packs, and on the placed graph and its views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks, documents, graph, index, layout, notes, search
from ..session import cut_lineage, shared_dir
from ..sources import packs
from ..sources import vault as source
from ..sources.tables import table
from .registry import Registry
from .sql import embedded
from .vault import _V, QUERY, _both, _score_sql

writing = Registry()


_WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def chunked(name: str, source: str, most: int) -> str:
    """CTEs that end in ``name`` (document_id, ordinal, content): source(id, text) cut into chunks, stated in SQL."""
    trim = lambda x: f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"
    units = lambda x: f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
    item = lambda x: f"{{'done': []::VARCHAR[], 'cur': {x}, 'n': {units(x)}}}"

    def pack(xs: str, glue: str, width: int) -> str:
        join = f"CASE WHEN a.n + {width} + x.n <= {most} THEN {{'done': a.done, 'cur': a.cur || {glue} || x.cur, 'n': a.n + {width} + x.n}} ELSE {{'done': list_append(a.done, a.cur), 'cur': x.cur, 'n': x.n}} END"
        return f"list_reduce(list_transform({xs}, lambda one: {item('one')}), lambda a, x: {join})"

    return rf"""{name}_t AS (SELECT id, {trim("regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '^---\n([\\s\\S]*?)\n---\n?', ''), chr(10)), lambda s: " + trim("s") + r"), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM {source}),
{name}_p AS (SELECT id, list_filter(regexp_split_to_array(t, '\n{{2,}}'), lambda p: p <> '') AS ps FROM {name}_t),
{name}_q AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM {name}_p WHERE len(ps) > 0),
{name}_s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(p, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {trim("x")}), lambda x: x <> '') AS ss FROM {name}_q),
{name}_r AS (SELECT id, i, CASE WHEN {units("p")} <= {most} THEN {{'done': []::VARCHAR[], 'cur': p, 'n': {units("p")}}} WHEN len(ss) > 1 THEN {pack("ss", "' '", 1)} END AS r, p FROM {name}_s),
{name}_u AS (SELECT id, i, CASE WHEN r IS NOT NULL THEN list_append(r.done, r.cur) ELSE list_filter(list_transform(range(0, (length(p) + {most} - 1) // {most}), lambda k: {trim(f"substr(p, k * {most} + 1, {most})")}), lambda x: x <> '') END AS parts FROM {name}_r),
{name}_a AS (SELECT id, flatten(list(parts ORDER BY i)) AS parts FROM {name}_u GROUP BY 1),
{name}_k AS (SELECT id, {pack("parts", "chr(10) || chr(10)", 2)} AS r FROM {name}_a WHERE len(parts) > 0),
{name} AS (SELECT id AS document_id, unnest(list_append(r.done, r.cur)) AS content, (generate_subscripts(list_append(r.done, r.cur), 1) - 1)::INTEGER AS ordinal FROM {name}_k)"""


_TEXTS = _V + ", tx AS (SELECT id, content AS text FROM d), "
_CHUNK_ID = "substr(sha256(k.document_id || ':' || k.ordinal || ':' || k.content), 1, 24)"


@writing.query("chunks", _TEXTS + chunked("k", "tx", 600) + rf" SELECT {_CHUNK_ID} AS id, document_id, ordinal, content, ceil(length(trim(regexp_replace(content, '[\s\x0b\x{{A0}}]+', ' ', 'g'))) / 4)::INTEGER AS token_count FROM k")
def q_chunks(spark, d):
    docs = documents.documents(source.written(source.notes(spark, d)))
    return chunks.chunks(docs, 600)


@writing.query(
    "chunk_embeddings",
    _TEXTS + chunked("k", "tx", 1200) + f", kx AS (SELECT {_CHUNK_ID} AS id, content AS text FROM k), " + embedded("e", "kx")
    + f" SELECT e.id, document_id, ordinal, (i - 1)::INTEGER AS dimension, round(x[i], 6) AS value FROM e JOIN k ON {_CHUNK_ID} = e.id, range(1, 193) r(i) WHERE x[i] <> 0",
)
def q_chunk_embeddings(spark, d):
    """The entries other than zero of each chunk's vector."""
    docs = documents.documents(source.written(source.notes(spark, d)))
    made = chunks.chunks(docs, embed=True).select("id", "document_id", "ordinal", F.posexplode("embedding").alias("dimension", "value"))
    return made.where("value <> 0").withColumn("value", F.round("value", 6))


#: Every 31st document gets a made-up assignment, as the texts hold few of their own.
_SECRET = "CASE WHEN doc_id % 31 = 0 THEN coalesce(text, '') || ' auth_token = ' || substr(md5(doc_id::VARCHAR), 1, 20) ELSE coalesce(text, '') END"


@writing.query(
    "secret_scan",
    rf"""WITH t AS (SELECT doc_id, {_SECRET} AS x FROM documents),
s AS (SELECT doc_id, unnest(['private key', 'OpenAI API key', 'GitHub token', 'AWS access key', 'Slack token', 'JWT', 'secret assignment']) AS label,
  unnest([regexp_matches(x, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_matches(x, '\bsk-[A-Za-z0-9_-]{{20,}}\b'), regexp_matches(x, '\b(?:ghp|gho|ghs|ghr|github_pat)_[A-Za-z0-9_]{{20,}}\b'), regexp_matches(x, '\bAKIA[0-9A-Z]{{16}}\b'),
    regexp_matches(x, '\bxox[abprs]-[A-Za-z0-9-]{{20,}}\b'), regexp_matches(x, '\beyJ[A-Za-z0-9_-]{{10,}}\.eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\b'),
    regexp_matches(x, '(?i)\b(?:api[_-]?key|secret|password|private[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*["'']?[A-Za-z0-9_./+=-]{{12,}}')]) AS hit FROM t)
SELECT doc_id, label FROM s WHERE hit""",
)
def q_secrets(spark, d):
    text = F.coalesce("text", F.lit(""))
    made_up = F.concat(text, F.lit(" auth_token = "), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 20))
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 31 == 0, made_up).otherwise(text).alias("x"))
    return rows.select("doc_id", F.explode(notes.secrets(F.col("x"))).alias("label"))


@writing.query(
    "note_problems",
    r"""WITH t AS (SELECT id, coalesce(title, '') AS t, coalesce(content, '') AS c FROM legacy_notes)
SELECT id, unnest(list_filter([CASE WHEN trim(t) = '' THEN 'empty title' END, CASE WHEN trim(c) = '' THEN 'empty content' END, CASE WHEN length(t) > 160 THEN 'long title' END], lambda x: x IS NOT NULL)) AS problem FROM t""",
)
def q_problems(spark, d):
    return table(spark, d, "legacy_notes").select("id", F.explode(notes.problems(F.col("title"), F.col("content"))).alias("problem"))


@writing.query(
    "legacy_tags",
    r"""WITH t AS (SELECT id, list_distinct(list_filter(list_transform(regexp_split_to_array(tags, '[\s\x0b\p{Z}\x{FEFF},;|]+'), lambda x: lower(regexp_replace(trim(x), '^#', ''))), lambda x: regexp_matches(x, '^[a-z0-9][a-z0-9_-]*$'))) AS xs FROM legacy_notes WHERE tags IS NOT NULL)
SELECT id, unnest(xs) AS tag FROM t""",
)
def q_legacy_tags(spark, d):
    return table(spark, d, "legacy_notes").select("id", F.explode(notes.legacy_tags(F.col("tags"))).alias("tag"))


#: Paths reserved row by row in the order of ids: the first free one of slug, slug-2, slug-3 and so on.
_LEGACY = r"""WITH RECURSIVE b0 AS (SELECT id, content, coalesce(nullif(trim(title), ''), nullif(trim(regexp_replace(regexp_replace(regexp_extract(trim(coalesce(path, '')), '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1'), '[-_]+', ' ', 'g')), ''), 'Imported Memory ' || id) AS title,
  coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(coalesce(agent, ''))), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'shared') AS agent_id FROM legacy_notes WHERE trim(content) <> ''),
s0 AS (SELECT *, 'agents/' || agent_id || '/' || coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS base FROM b0),
s AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM s0),
walk(k, used, path) AS (SELECT 0::BIGINT, list(DISTINCT path), '' FROM vault_notes
  UNION ALL SELECT k, list_append(used, path), path FROM (SELECT s.k, used, s.base || coalesce('-' || nullif((SELECT min(i) FROM range(1, 1000) r(i) WHERE NOT list_contains(used, s.base || CASE WHEN i > 1 THEN '-' || i ELSE '' END || '.md')), 1), '') || '.md' AS path FROM walk JOIN s ON s.k = walk.k + 1)),
p AS (SELECT id AS row_id, agent_id, title, walk.path, content FROM s JOIN walk USING (k))
"""


@writing.query(
    "legacy_import",
    _LEGACY
    + r""", tg AS (SELECT *, list_filter(t0, lambda x, i: list_position(t0, x) = i) AS ts FROM (SELECT p.*, trim(p.content, ' ' || chr(9) || chr(10) || chr(13)) AS body, list_filter(list_transform(regexp_split_to_array(coalesce(o.tags, ''), '[\s\x0b\p{Z}\x{FEFF},;|]+'), lambda x: lower(regexp_replace(trim(x), '^#', ''))), lambda x: regexp_matches(x, '^[a-z0-9][a-z0-9_-]*$')) AS t0 FROM p JOIN legacy_notes o ON o.id = row_id)),
ms AS (SELECT *, list_filter(ts, lambda t: NOT list_contains(list_transform(regexp_extract_all(body, '(^|\s)#([A-Za-z0-9][A-Za-z0-9_-]*)', 2), lambda x: lower(x)), t)) AS missing FROM tg),
bt AS (SELECT *, body || CASE WHEN len(missing) > 0 THEN chr(10) || chr(10) || 'Tags: ' || array_to_string(list_transform(missing, lambda t: '#' || t), ' ') ELSE '' END AS t FROM ms),
ct AS (SELECT *, len(list_filter(regexp_extract_all(t, '\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1), lambda x: trim(x) <> '' AND lower(regexp_replace(trim(x), '(?i)\.md$', '')) <> lower(regexp_replace(trim(title), '(?i)\.md$', '')))) > 0 AS cites FROM bt)
SELECT row_id, agent_id, title, path, '---' || chr(10) || 'title: "' || replace(title, '"', chr(92) || '"') || '"' || chr(10) || 'agent: "' || agent_id || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10)
  || t || CASE WHEN cites THEN '' WHEN lower(regexp_replace(trim(title), '(?i)\.md$', '')) = 'memory hub' THEN chr(10) || chr(10) || 'Related: [[Knowledge Root]]' ELSE chr(10) || chr(10) || 'Related: [[Memory Hub]]' END || chr(10) AS content FROM ct""",
)
def q_legacy_import(spark, d):
    return notes.import_legacy(table(spark, d, "legacy_notes"), table(spark, d, "vault_notes").select("path").distinct())


@writing.query("legacy_paths", _LEGACY + "SELECT row_id, agent_id, title, path FROM p")
def q_legacy_paths(spark, d):
    return notes.import_legacy(table(spark, d, "legacy_notes"), table(spark, d, "vault_notes").select("path").distinct()).drop("content")


@writing.query(
    "pack_report",
    """WITH p AS (SELECT *, (row_number() OVER (ORDER BY agent_id NULLS FIRST, document_id NULLS FIRST, chunk_ordinal NULLS FIRST, chunk_id NULLS FIRST) - 1) // 500 AS pack FROM (SELECT DISTINCT document_id, agent_id, title, path, chunk_id, chunk_ordinal, content, tags FROM pack_rows))
SELECT pack::INTEGER AS pack, count(*) AS n, count(DISTINCT document_id) AS documents, list_sort(list_distinct(list(agent_id))) AS agents, sum(strlen(coalesce(content, '')))::BIGINT AS bytes FROM p GROUP BY 1""",
)
def q_pack_report(spark, d):
    return packs.report(packs.numbered(table(spark, d, "pack_rows"), 500))


@writing.query(
    "pack_files",
    "SELECT agent_id, chunk_id, document_id, chunk_ordinal, md5(coalesce(content, '')) AS content_hash FROM (SELECT DISTINCT document_id, agent_id, title, path, chunk_id, chunk_ordinal, content, tags FROM pack_rows WHERE agent_id IS NOT NULL)",
)
def q_pack_files(spark, d):
    """The pack rows as they come back from packs that were written."""
    path = shared_dir(spark, "packs")
    packs.write(table(spark, d, "pack_rows").where("agent_id IS NOT NULL").select(*packs.COLUMNS).distinct(), path)
    return packs.read(spark, path).select("agent_id", "chunk_id", "document_id", "chunk_ordinal", F.md5(F.coalesce("content", F.lit(""))).alias("content_hash"))


@writing.query(
    "pack_totals",
    "SELECT agent_id, count(*) AS n, count(DISTINCT document_id) AS documents, sum(strlen(coalesce(content, '')))::BIGINT AS bytes FROM (SELECT DISTINCT * FROM pack_rows) GROUP BY 1",
)
def q_pack_totals(spark, d):
    rows = table(spark, d, "pack_rows").distinct()
    return rows.groupBy("agent_id").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"), F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("bytes"))


_NODES = _V + """, e AS (SELECT from_document_id AS id, least(greatest(weight, 1), 8) AS w FROM l UNION ALL SELECT to_document_id, least(greatest(weight, 1), 8) FROM l WHERE to_document_id IS NOT NULL),
g AS (SELECT d.id, any_value(title) AS title, any_value(path) AS path, coalesce(sum(w), 0)::BIGINT AS degree FROM d LEFT JOIN e ON e.id = d.id GROUP BY 1)
"""


def _nodes(spark, d):
    docs, links = _both(spark, d, "layout")
    nodes = cut_lineage(docs.select("id", "title", "path").join(graph.degrees(docs, links), "id"), "nodes")
    return docs, links, nodes


@writing.query(
    "hubs",
    _NODES + r"""SELECT id, title, degree, CASE WHEN lower(trim(title)) = 'memory hub' THEN 5 WHEN lower(trim(title)) = 'knowledge root' THEN 4 WHEN regexp_matches(title, '(?i)\bmoc\b') THEN 3 ELSE 2 END AS hub_score FROM g
WHERE regexp_matches(title, '(?i)\b(memory\s*hub|knowledge\s*root|moc|map)\b')""",
)
def q_hubs(spark, d):
    nodes = _nodes(spark, d)[2]
    return nodes.withColumn("hub_score", layout.hub_score(F.col("title"))).where("hub_score > 0").select("id", "title", "degree", "hub_score")


@writing.query(
    "segments",
    _NODES
    + """, ue AS (SELECT DISTINCT from_document_id AS a, to_document_id AS b FROM l WHERE to_document_id IS NOT NULL UNION SELECT to_document_id, from_document_id FROM l WHERE to_document_id IS NOT NULL),
rc(id, c) AS (SELECT id, id FROM d UNION SELECT ue.b, rc.c FROM rc JOIN ue ON ue.a = rc.id WHERE rc.c < ue.b), cm AS (SELECT id, min(c) AS component FROM rc GROUP BY 1),
nt AS (SELECT g.*, component, coalesce(CASE WHEN ps[1] = 'agents' THEN ps[3] ELSE ps[1] END, 'root') AS label FROM (SELECT *, list_filter(string_split(path, '/'), lambda p: p <> '') AS ps FROM g) g JOIN cm USING (id)),
nn AS (SELECT *, label IN ('maps', '00-maps') OR coalesce(regexp_matches(title, '(?i)\\b(moc|map)\\b'), false) AS nat FROM nt),
pc AS (SELECT component, min(title) AS first_title, bool_or(nat) AS has, arg_min(id, (-degree, title, id)) AS top FROM nn GROUP BY 1),
sd AS (SELECT id, (first_title, -degree, title, id) AS rank, coalesce(nullif(trim(regexp_replace(regexp_replace(title, '(?i)^MOC\\s+', ''), '(?i)\\s+Memory Map$', '')), ''), title) AS segment FROM nn JOIN pc USING (component) WHERE CASE WHEN has THEN nat ELSE id = top END),
wlk(id, seed, lv) AS (SELECT id, id, 0 FROM sd UNION SELECT ue.b, seed, lv + 1 FROM wlk JOIN ue ON ue.a = wlk.id WHERE lv < 12),
nr AS (SELECT wlk.id, arg_min(segment, (lv, rank)) AS segment FROM wlk JOIN sd ON sd.id = seed GROUP BY 1)
SELECT nn.id, coalesce(segment, CASE label WHEN '00-maps' THEN 'maps' ELSE label END) AS segment FROM nn LEFT JOIN nr USING (id)""",
)
def q_segments(spark, d):
    docs, links, nodes = _nodes(spark, d)
    edges = cut_lineage(graph.edges_between(docs, links), "edges")
    return layout.segments(nodes, edges, cut_lineage(graph.components(docs, edges), "labels"))


@writing.query("layout")
def q_layout(spark, d):
    docs, links, nodes = _nodes(spark, d)
    edges = cut_lineage(graph.edges_between(docs, links), "edges")
    seg = layout.segments(nodes, edges, cut_lineage(graph.components(docs, edges), "labels"))
    placed = layout.centred(cut_lineage(layout.relax(layout.place(nodes.join(seg, "id"))), "apart"))
    return placed.select("id", "group", "segment", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@writing.query(
    "edge_budget",
    _V + """, r AS (SELECT from_document_id, to_document_id, to_title, weight, priority FROM l WHERE to_document_id IS NOT NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY weight DESC, from_document_id, to_document_id, priority, to_title) AS n FROM (SELECT from_document_id AS e, * FROM r UNION ALL SELECT to_document_id, * FROM r)),
b AS (SELECT DISTINCT from_document_id, to_document_id, priority, to_title FROM x WHERE n = 1)
SELECT r.* FROM r LEFT JOIN b USING (from_document_id, to_document_id, priority, to_title) ORDER BY CASE WHEN (from_document_id, to_document_id, priority, to_title) IN (SELECT (from_document_id, to_document_id, priority, to_title) FROM b) THEN 0 ELSE 1 END, weight DESC, from_document_id, to_document_id, priority, to_title LIMIT 900""",
)
def q_edge_budget(spark, d):
    return layout.edge_budget(_both(spark, d)[1], 900)


@writing.query("compact_edges", _V + "SELECT from_document_id, to_document_id, to_title, weight, priority FROM l WHERE to_document_id IS NOT NULL")
def q_compact_edges(spark, d):
    """All resolved links as long as the graph is small; the SQL holds up to the first limit."""
    docs, links = _both(spark, d)
    return layout.edge_budget(links, layout.edge_limit(docs.count()))


def _points(spark, d):
    """The given vectors' first two entries as places, their label as degree."""
    e = table(spark, d, "embeddings")
    xy = lambda i: (F.get("embedding", F.lit(i)).cast("double") * 1000)
    return e.select(F.col("vec_id").alias("id"), xy(0).alias("x"), xy(1).alias("y"), F.col("label").cast("bigint").alias("degree"))


_POINTS = "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, label AS degree FROM embeddings)"


@writing.query("viewport", _POINTS + " SELECT id FROM p WHERE x BETWEEN -50 AND 120 AND y BETWEEN -80 AND 60")
def q_viewport(spark, d):
    return layout.in_viewport(_points(spark, d), -50, -80, 120, 60).select("id")


@writing.query(
    "grid_clusters",
    _POINTS + """, c AS (SELECT *, floor(x / 40)::BIGINT AS cell_x, floor(y / 40)::BIGINT AS cell_y FROM p)
SELECT cell_x, cell_y, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n, arg_min(id, (-degree, id)) AS representative FROM c GROUP BY 1, 2 ORDER BY n DESC, cell_x, cell_y LIMIT 900""",
)
def q_grid_clusters(spark, d):
    return layout.grid_clusters(_points(spark, d), 40.0).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@writing.query(
    "near_pairs",
    _POINTS + " SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM p a JOIN p b ON a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 12",
)
def q_near_pairs(spark, d):
    return layout.near_pairs(_points(spark, d), 12.0).where("a < b").select("a", "b", F.round("distance", 6).alias("distance"))


@writing.query(
    "mesh_edges",
    _POINTS + """, q AS (SELECT a.id AS a, least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS dist FROM p a JOIN p b ON a.id <> b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 30 AND abs(a.id - b.id) <> 1),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, lo, hi) AS n FROM q) SELECT DISTINCT lo AS a, hi AS b FROM r WHERE n <= 3""",
)
def q_mesh(spark, d):
    points = _points(spark, d)
    return layout.mesh_edges(points, points.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), 30.0)


@writing.query(
    "ecosystem_buckets",
    _NODES + """, f AS (SELECT *, coalesce(nullif(array_to_string(list_filter(string_split(path, '/'), lambda p: trim(p) <> '')[1:2], '/'), ''), 'root') AS folder FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY folder, degree DESC, title, id) - 1 AS n FROM f) SELECT id, folder, n // 1000 AS bucket_1000, n // 250 AS bucket_250, n // 60 AS bucket_60 FROM r""",
)
def q_buckets(spark, d):
    return layout.buckets(_nodes(spark, d)[2])


@writing.query(
    "cluster_edges",
    _NODES + """, f AS (SELECT *, coalesce(nullif(array_to_string(list_filter(string_split(path, '/'), lambda p: trim(p) <> '')[1:2], '/'), ''), 'root') AS folder FROM g),
r AS (SELECT id, (row_number() OVER (ORDER BY folder, degree DESC, title, id) - 1) // 60 AS c FROM f)
SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, sum(weight)::BIGINT AS weight FROM l JOIN r x ON x.id = from_document_id JOIN r y ON y.id = to_document_id WHERE x.c <> y.c GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 520""",
)
def q_cluster_edges(spark, d):
    _, links, nodes = _nodes(spark, d)
    clusters = cut_lineage(layout.buckets(nodes).select("id", F.col("bucket_60").alias("cluster")), "clusters")
    edges = links.where("to_document_id IS NOT NULL").select(F.col("from_document_id").alias("a"), F.col("to_document_id").alias("b"), "weight")
    return layout.cluster_edges(clusters, edges)


#: The second run finds the vault as it is, the first found the rows updated before April.
_RUNS = _V + """, a1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, path, content NULLS FIRST) AS rn FROM n0 WHERE id IS NOT NULL AND path IS NOT NULL AND updated_at < '2026-04-01'),
was AS (SELECT path, updated_at, strlen(coalesce(content, '')) + strlen(coalesce(title, '')) AS size FROM a1 WHERE rn = 1), cur AS (SELECT path, updated_at FROM note),
ch AS (SELECT cur.path FROM cur LEFT JOIN was USING (path) WHERE was.path IS NULL OR was.updated_at IS DISTINCT FROM cur.updated_at)
"""


def _index(spark, d):
    """Two runs over a growing vault; the counts of the second and the index."""
    rows = source.rows(spark, d)
    built = index.VaultIndex.new(spark)
    built.run(source.written(source.latest(rows.where("updated_at < '2026-04-01'"))))
    return built.run(source.written(source.latest(rows))), built


@writing.query(
    "index_run",
    _RUNS + "SELECT (SELECT count(*) FROM d) AS n_documents, (SELECT count(*) FROM l) AS n_links, (SELECT count(*) FROM ch) AS n_changed, (SELECT count(*) FROM was WHERE path NOT IN (SELECT path FROM cur)) AS n_deleted",
)
def q_index_run(spark, d):
    return _index(spark, d)[0].select("n_documents", "n_links", "n_changed", "n_deleted")


@writing.query("index_links", _V + "SELECT * FROM l")
def q_index_links(spark, d):
    """Links of changed and unchanged documents alike, as the second run resolved them."""
    return _index(spark, d)[1].read("links")


@writing.query("index_rows_built", _TEXTS + chunked("k", "tx", 1200) + f" SELECT {_CHUNK_ID} AS chunk_id, document_id, agent_id, title, path, ordinal AS chunk_ordinal, k.content FROM k JOIN d ON d.id = document_id")
def q_index_rows(spark, d):
    return _index(spark, d)[1].rows().select("chunk_id", "document_id", "agent_id", "title", "path", "chunk_ordinal", "content")


@writing.query(
    "index_nested",
    _TEXTS + chunked("k", "tx", 1200)
    + """, kc AS (SELECT document_id, count(*) AS n, max(ordinal) AS top FROM k GROUP BY 1), lc AS (SELECT from_document_id AS id, count(*) AS n, min(to_title) AS first FROM l GROUP BY 1)
SELECT d.id AS document_id, d.path, coalesce(kc.n, 0) AS n_chunks, kc.top AS last_ordinal, coalesce(lc.n, 0) AS n_links, lc.first AS first_link FROM d LEFT JOIN kc ON kc.document_id = d.id LEFT JOIN lc ON lc.id = d.id""",
)
def q_index_nested(spark, d):
    """What the nested rows hold: numbers of chunks and links, the last ordinal, the first title."""
    n = _index(spark, d)[1].nested()
    last, first = F.get("chunks", F.size("chunks") - 1)["ordinal"], F.get("links", F.lit(0))["to_title"]
    return n.select("document_id", "path", F.size("chunks").cast("bigint").alias("n_chunks"), last.alias("last_ordinal"), F.size("links").cast("bigint").alias("n_links"), first.alias("first_link"))


@writing.query("index_search", _TEXTS + chunked("k", "tx", 1200) + f""", kd AS (SELECT {_CHUNK_ID} AS chunk_id, document_id, ordinal AS chunk_ordinal, k.content, title, path, tags FROM k JOIN d ON d.id = document_id), """
    + _score_sql(6, "kd") + " SELECT chunk_id, document_id, text_score::DOUBLE AS score FROM sc WHERE text_score > 0 ORDER BY score DESC, lower(title), title, path, chunk_ordinal, chunk_id LIMIT 15")
def q_index_search(spark, d):
    """A search of the chunks that the index was built with."""
    return search.search(_index(spark, d)[1].rows(), QUERY, 15, "fts").select("chunk_id", "document_id", "score")
