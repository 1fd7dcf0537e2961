"""Queries on the placed graph of the vault: every note at its place within its folder's segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, layout, notes, views
from ..session import cut_lineage, forget
from ..sources.tables import table
from .registry import Registry
from .writing import _NODES, _nodes

shown = Registry()

_LABEL = "list_filter(string_split(path, '/'), lambda p: p <> '')"
#: A note's place by the formula: its segment's angle and radius, its rank there, and a shake from the hash of its texts.
_PLACED = _NODES + rf""", hs AS (SELECT id, list_reduce(list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT) AS h, k
  FROM (SELECT id, 'title' AS k, coalesce(title, '') AS s FROM g UNION ALL SELECT id, 'id', id FROM g UNION ALL SELECT id, 'path', path FROM g)),
jt AS (SELECT id, max(CASE WHEN k = 'title' THEN abs(h % 1000) / 1000.0 - 0.5 END) AS jt, max(CASE WHEN k = 'id' THEN abs(h % 1000) / 1000.0 - 0.5 END) AS ji, max(CASE WHEN k = 'path' THEN abs(h % 1000) / 1000.0 - 0.5 END) AS jp FROM hs GROUP BY 1),
sg AS (SELECT *, coalesce(CASE WHEN ({_LABEL})[1] = 'agents' THEN ({_LABEL})[3] ELSE ({_LABEL})[1] END, 'root') AS segment FROM g),
sz AS (SELECT segment, count(*) AS size, row_number() OVER (ORDER BY segment) - 1 AS s, count(*) OVER () AS k FROM sg GROUP BY 1),
ce AS (SELECT segment, k, 6.283185307179586 * s / k - 1.5707963267948966 AS angle, CASE WHEN k = 1 THEN 0.0 ELSE 340.0 + least(size, 22) * 10 END AS radius, 180 + log2(size + 1) * 6 AS spread FROM sz),
rk AS (SELECT sg.*, row_number() OVER (PARTITION BY segment ORDER BY degree DESC, title, sg.id) AS rank, jt, ji, jp FROM sg JOIN jt USING (id)),
pl AS (SELECT id, title, path, degree, segment, cos(angle) * radius + cos((rank - 1) * 2.399963 + jt * 0.42) * sqrt(rank) * spread - cos(angle) * CASE WHEN k = 1 THEN 0 ELSE least(degree, 12) * 12 END + ji * 24 AS x,
  sin(angle) * radius * 0.78 + sin((rank - 1) * 2.399963 + jt * 0.42) * sqrt(rank) * spread * 0.78 - sin(angle) * CASE WHEN k = 1 THEN 0 ELSE least(degree, 12) * 12 END + jp * 24 AS y FROM rk JOIN ce USING (segment)),
hb AS (SELECT id, x, y FROM (SELECT *, CASE WHEN lower(trim(title)) = 'memory hub' THEN 5 WHEN lower(trim(title)) = 'knowledge root' THEN 4 WHEN regexp_matches(title, '(?i)\bmoc\b') THEN 3 WHEN regexp_matches(title, '(?i)\b(memory\s*hub|knowledge\s*root|moc|map)\b') THEN 2 ELSE 0 END AS hs FROM pl) WHERE hs > 0 ORDER BY hs DESC, degree DESC, title, id LIMIT 1),
ed AS (SELECT from_document_id AS a, to_document_id AS b, weight FROM l WHERE to_document_id IS NOT NULL)
"""


def _graph(spark, d):
    """The nodes at their places, and the resolved links as edges."""
    docs, links, nodes = _nodes(spark, d)
    forget(docs)  # the texts, which nothing below reads
    placed = layout.place(nodes.withColumn("segment", layout.group_label(F.col("path"))))
    edges = links.where("to_document_id IS NOT NULL").select(F.col("from_document_id").alias("a"), F.col("to_document_id").alias("b"), "weight")
    return cut_lineage(placed.select("id", "title", "path", "degree", "segment", "x", "y"), "placed"), edges


@shown.query("placed_nodes", _PLACED + "SELECT id, segment, round(x, 6) AS x, round(y, 6) AS y FROM pl")
def q_placed(spark, d):
    return _graph(spark, d)[0].select("id", "segment", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@shown.query(
    "cluster_levels",
    _PLACED + """, f AS (SELECT *, coalesce(nullif(array_to_string(list_filter(string_split(path, '/'), lambda p: trim(p) <> '')[1:2], '/'), ''), 'root') AS folder,
  CASE WHEN lower(trim(title)) = 'memory hub' THEN 5 WHEN lower(trim(title)) = 'knowledge root' THEN 4 WHEN regexp_matches(title, '(?i)\\bmoc\\b') THEN 3 WHEN regexp_matches(title, '(?i)\\b(memory\\s*hub|knowledge\\s*root|moc|map)\\b') THEN 2 ELSE 0 END AS hs FROM pl),
r AS (SELECT *, row_number() OVER (ORDER BY folder, degree DESC, title, id) - 1 AS n FROM f), lv(size, up) AS (VALUES (1000, NULL), (250, 1000), (60, 250)),
c AS (SELECT size, up, n // size AS bucket, r.* FROM r, lv)
SELECT size, bucket, (bucket * size) // any_value(up) AS parent, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n, arg_min(id, (-(degree + hs * 1000), id)) AS representative, min(folder) AS folder FROM c GROUP BY 1, 2""",
)
def q_cluster_levels(spark, d):
    return views.cluster_levels(_graph(spark, d)[0]).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@shown.query("view_extent", _PLACED + "SELECT round(min(pl.x), 6) AS x0, round(min(pl.y), 6) AS y0, round(max(pl.x), 6) AS x1, round(max(pl.y), 6) AS y1, max(hb.id) AS hub, round(min(CASE WHEN pl.id <> hb.id THEN sqrt((pl.x - hb.x) ** 2 + (pl.y - hb.y) ** 2) END), 6) AS nearest FROM pl LEFT JOIN hb ON true")
def q_extent(spark, d):
    return views.extent(_graph(spark, d)[0]).select(*(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")), "hub", F.round("nearest", 6).alias("nearest"))


@shown.query("view_box", _PLACED + "SELECT id FROM pl WHERE x BETWEEN -300 AND 500 AND y BETWEEN -400 AND 200")
def q_box(spark, d):
    return layout.in_viewport(_graph(spark, d)[0], -300, -400, 500, 200).select("id")


@shown.query("view_clusters", _PLACED + """SELECT floor(x / 160)::BIGINT AS cell_x, floor(y / 160)::BIGINT AS cell_y, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n, arg_min(id, (-degree, id)) AS representative
FROM pl GROUP BY 1, 2 ORDER BY n DESC, cell_x, cell_y LIMIT 900""")
def q_clusters(spark, d):
    return layout.grid_clusters(_graph(spark, d)[0], 160.0).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@shown.query(
    "view_mesh",
    _PLACED + """, q AS (SELECT a.id AS a, least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS dist FROM pl a JOIN pl b ON a.id <> b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 90),
r AS (SELECT q.*, row_number() OVER (PARTITION BY q.a ORDER BY dist, lo, hi) AS n FROM q WHERE NOT EXISTS (SELECT 1 FROM ed WHERE least(ed.a, ed.b) = lo AND greatest(ed.a, ed.b) = hi)) SELECT DISTINCT lo AS a, hi AS b FROM r WHERE n <= 3""",
)
def q_mesh(spark, d):
    nodes, edges = _graph(spark, d)
    return layout.mesh_edges(nodes, edges.select("a", "b"), 90.0)


@shown.query("view_every_third", _PLACED + "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY title, id) - 1 AS n FROM pl) WHERE n % 3 = 0")
def q_every_third(spark, d):
    """The stride sample as it is at a scale of 0.5 of a large graph."""
    return views.every_nth(_graph(spark, d)[0], views.stride_for(views.LARGE + 1, 0.5)).select("id")


@shown.query("view_even_sample", _PLACED + "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY title, id) - 1 AS n, ceil(count(*) OVER () / 90)::BIGINT AS step FROM pl) WHERE n % step = 0")
def q_even_sample(spark, d):
    return views.even_sample(_graph(spark, d)[0], 90).select("id")


@shown.query("view_nearest", _PLACED + "SELECT id FROM pl ORDER BY sqrt((x - 100) ** 2 + (y + 50) ** 2), degree DESC, id LIMIT 120")
def q_nearest(spark, d):
    return views.nearest_sample(_graph(spark, d)[0], 100, -50, 120).select("id")


@shown.query("view_stable", _PLACED + "SELECT id FROM pl ORDER BY CASE WHEN segment = 'atlas' THEN 0 ELSE 1 END, sqrt(x ** 2 + y ** 2), degree DESC, id LIMIT 80")
def q_stable(spark, d):
    """The sample around the origin that keeps the notes of one folder, which were shown before."""
    nodes = _graph(spark, d)[0]
    return views.nearest_sample(nodes, 0, 0, 80, nodes.where("segment = 'atlas'"), by_distance=False).select("id")


@shown.query(
    "view_layers",
    _PLACED + """, aw AS (SELECT pl.id, degree, sqrt((pl.x - hb.x) ** 2 + (pl.y - hb.y) ** 2) AS d FROM pl, hb), nm AS (SELECT max(d) AS most, greatest(260, least(count(*), 300)) AS desired FROM aw),
sh AS (SELECT id, degree, round(d / most, 12) AS s, desired, greatest(36, least(desired - 8, floor(desired * 0.4)::BIGINT)) AS core FROM aw, nm),
i AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) AS n, core FROM sh WHERE s <= 0.35),
o AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN round(abs(s - 0.6), 12) > 0.15 THEN 1 ELSE 0 END, round(abs(s - 0.6), 12), degree DESC, id) AS n, desired, core FROM sh)
SELECT id FROM i WHERE n <= core UNION SELECT id FROM o WHERE n <= greatest(12, desired - core)""",
)
def q_layers(spark, d):
    return views.layered_sample(_graph(spark, d)[0], 150, 0.4, 0.35, 0.6, 0.3)


@shown.query(
    "view_neighbours",
    _PLACED + """, sa AS (SELECT id FROM pl WHERE segment = 'atlas'), bo AS (SELECT a AS id, b AS other, weight FROM ed WHERE a <> b UNION ALL SELECT b, a, weight FROM ed WHERE a <> b),
rn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, other) AS n FROM bo WHERE id IN (SELECT id FROM sa)),
fr AS (SELECT other AS id, max(weight) AS w FROM rn WHERE n <= 3 AND other NOT IN (SELECT id FROM sa) GROUP BY 1 ORDER BY w DESC, id LIMIT 200)
SELECT id, false AS added FROM sa UNION ALL SELECT id, true FROM fr""",
)
def q_neighbours(spark, d):
    nodes, edges = _graph(spark, d)
    return views.with_neighbours(nodes.where("segment = 'atlas'"), edges)


@shown.query("view_heaviest_edges", _PLACED + "SELECT a, b, weight FROM ed ORDER BY weight DESC, a, b LIMIT 500")
def q_heaviest(spark, d):
    """The edges of a large graph, with a lower limit than usual."""
    return views.heaviest_edges(_graph(spark, d)[1], views.LARGE + 1, 500)


@shown.query(
    "view_relevant_edges",
    _PLACED + """, o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(weight) AS weight FROM ed GROUP BY ALL), ix AS (SELECT id FROM pl WHERE path = 'agents/shared/atlas/atlas-index.md')
SELECT a, b, weight, false AS inferred, (weight * 10 + 8 + CASE WHEN a IN (SELECT id FROM ix) OR b IN (SELECT id FROM ix) THEN 120 ELSE 0 END + CASE WHEN a IN (SELECT id FROM hb) OR b IN (SELECT id FROM hb) THEN 42 ELSE 0 END)::BIGINT AS score FROM o ORDER BY score DESC, a, b LIMIT 400""",
)
def q_relevant(spark, d):
    nodes, edges = _graph(spark, d)
    hub = layout.primary_hub(nodes).first()
    index = nodes.where("path = 'agents/shared/atlas/atlas-index.md'").first()
    return views.relevant_edges(edges.withColumn("inferred", F.lit(False)), 400, selected=index and index.id, hub=hub and hub.id)


@shown.query(
    "added_notes",
    r"""WITH b AS (SELECT id, trim(coalesce(title, '')) AS t, title, coalesce(content, '') AS content, coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(coalesce(agent, ''))), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'shared') AS agent_id FROM legacy_notes),
v AS (SELECT * FROM b WHERE t <> '' AND trim(content) <> '' AND length(title) <= 160 AND length(content) <= 200000 AND NOT regexp_matches(title || chr(10) || content, '(?i)\b(?:api[_-]?key|secret|password|private[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*["'']?[A-Za-z0-9_./+=-]{12,}')),
c AS (SELECT *, list_filter(regexp_extract_all(content, '\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1), lambda x: trim(x) <> '' AND lower(regexp_replace(trim(x), '(?i)\.md$', '')) <> lower(regexp_replace(t, '(?i)\.md$', ''))) AS cited FROM v),
p AS (SELECT id, 'agents/' || agent_id || '/' || coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') || '.md' AS path, agent_id, len(cited) = 0 AS linked, CASE WHEN len(cited) > 0 THEN NULL WHEN lower(regexp_replace(t, '(?i)\.md$', '')) = 'memory hub' THEN 'Knowledge Root' ELSE 'Memory Hub' END AS target FROM c)
SELECT path, agent_id, auto_linked, link_target FROM (SELECT path, agent_id, linked AS auto_linked, target AS link_target, row_number() OVER (PARTITION BY path ORDER BY id DESC) AS n FROM p) WHERE n = 1
UNION ALL SELECT path, agent_id, false, NULL FROM (SELECT DISTINCT 'agents/' || agent_id || '/' || CASE target WHEN 'Memory Hub' THEN 'memory-hub' ELSE 'knowledge-root' END || '.md' AS path, agent_id FROM p WHERE target IS NOT NULL) WHERE path NOT IN (SELECT path FROM p) AND path NOT IN (SELECT path FROM vault_notes WHERE path IS NOT NULL)""",
)
def q_added(spark, d):
    """The legacy rows as notes that agents add, with the hub notes this calls for."""
    rows = table(spark, d, "legacy_notes").select("id", "title", "content", F.col("agent").alias("agent"))
    added = notes.added(rows, table(spark, d, "vault_notes").select("path"))
    return added.select("path", "agent_id", "auto_linked", "link_target")
