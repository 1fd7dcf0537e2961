"""Queries of the two general data problems: dangling references and packed values."""

from __future__ import annotations

from ..operators import packed, references
from ..sources.tables import table
from .registry import Registry

general = Registry()

#: Notes, removals and references as the problem states them; shared by the queries on dangling references.
_P1 = r"""
WITH notes AS (
  SELECT id, agent_id, title, path, created_at FROM vault_notes
  UNION ALL SELECT id, agent_id, title, path, created_at FROM hub_notes
), n AS (
  SELECT DISTINCT id, agent_id, lower(trim(regexp_replace(title, '[#|].*$', '', 's'))) AS t,
         regexp_replace(replace(trim(path), chr(92), '/'), '^(\./)+', '') AS p, created_at FROM notes WHERE id IS NOT NULL
), r AS (
  SELECT link_id, 'from_document_id' AS ref_field, from_document_id AS k, agent_id, indexed_at AS t FROM knowledge_links WHERE trim(from_document_id) <> ''
  UNION ALL
  SELECT link_id, 'to_title', lower(trim(regexp_replace(to_title, '[#|].*$', '', 's'))), coalesce(agent_id, 'shared'), indexed_at FROM knowledge_links WHERE trim(to_title) <> ''
  UNION ALL
  SELECT link_id, 'to_path', regexp_replace(replace(trim(to_path), chr(92), '/'), '^(\./)+', ''), agent_id, indexed_at FROM knowledge_links WHERE trim(to_path) <> ''
), cand AS (
  SELECT r.link_id, r.ref_field, r.t, n.id, n.created_at FROM r JOIN n ON r.ref_field = 'from_document_id' AND n.id = r.k
  UNION ALL
  SELECT r.link_id, r.ref_field, r.t, n.id, n.created_at FROM r JOIN n ON r.ref_field = 'to_title' AND n.t = r.k AND coalesce(n.agent_id, 'shared') IN (r.agent_id, 'shared')
  UNION ALL
  SELECT r.link_id, r.ref_field, r.t, n.id, n.created_at FROM r JOIN n ON r.ref_field = 'to_path' AND n.p = r.k
), there AS (
  SELECT DISTINCT c.link_id, c.ref_field, c.t FROM cand c
  WHERE (c.created_at IS NULL OR c.created_at <= c.t)
    AND NOT EXISTS (SELECT 1 FROM removed_notes x WHERE x.document_id = c.id AND x.removed_at <= c.t AND (x.restored_at IS NULL OR x.restored_at > c.t))
), found AS (
  SELECT DISTINCT link_id, ref_field, t FROM r
  WHERE NOT EXISTS (SELECT 1 FROM there h WHERE h.link_id = r.link_id AND h.ref_field = r.ref_field AND h.t IS NOT DISTINCT FROM r.t)
)
"""


def _p1(spark, d):
    notes = table(spark, d, "vault_notes").select("id", "agent_id", "title", "path", "created_at")
    hubs = table(spark, d, "hub_notes").select("id", "agent_id", "title", "path", "created_at")
    return table(spark, d, "knowledge_links"), notes.unionByName(hubs), table(spark, d, "removed_notes")


@general.query("p1_found", _P1 + "SELECT DISTINCT link_id, ref_field FROM found")
def p1_found(spark, d):
    return references.orphan_references(*_p1(spark, d)).select("link_id", "ref_field").distinct()


@general.query(
    "p1_orphans_by_month",
    _P1
    + """, refs AS (SELECT ref_field, strftime(t, '%Y-%m') AS month, count(DISTINCT (link_id, t)) AS refs FROM r GROUP BY ALL),
  lost AS (SELECT ref_field, strftime(t, '%Y-%m') AS month, count(*) AS orphans FROM found GROUP BY ALL)
SELECT ref_field, month, refs::BIGINT AS refs, coalesce(orphans, 0)::BIGINT AS orphans FROM refs LEFT JOIN lost USING (ref_field, month)""",
)
def p1_orphans_by_month(spark, d):
    return references.orphan_counts(*_p1(spark, d))


def _p2(spark, d):
    signs = packed.signs_of(*(table(spark, d, t).select("tags") for t in ("vault_notes", "hub_notes")))
    return packed.unpack(table(spark, d, "legacy_notes"), "id", "tags", signs)


#: The grammar in a pattern without look-around, enough where quotation marks are closed; signs come from the tables.
_P2 = r"""
WITH t AS (SELECT unnest(tags) AS t FROM vault_notes UNION SELECT unnest(tags) FROM hub_notes),
c AS (SELECT DISTINCT unnest(string_split(regexp_replace(regexp_replace(trim(t), '^#+', ''), '[\p{L}\p{M}\p{N}\s]', '', 'g'), '')) AS c FROM t),
s AS (SELECT string_agg(chr(92) || c, '' ORDER BY c) AS signs FROM c WHERE c <> ''),
m AS (SELECT DISTINCT id, regexp_extract_all(tags,
  '"(?:\\.|""|[^"\\])*"|''(?:\\.|''''|[^''\\])*''|`[^`]*`|“[^”]*”|‘[^’]*’|[\p{L}\p{M}\p{N}' || signs || ']*[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}' || signs || ']*') AS xs FROM legacy_notes, s WHERE tags IS NOT NULL),
u AS (SELECT id, list_filter(list_transform(xs, lambda x: trim(CASE
  WHEN x LIKE '"%"' THEN replace(replace(x[2:-2], chr(92) || '"', '"'), '""', '"')
  WHEN x LIKE '''%''' THEN replace(replace(x[2:-2], chr(92) || '''', ''''), '''''', '''')
  WHEN regexp_matches(x, '^[`“‘]') THEN x[2:-2] ELSE x END)), lambda x: x <> '') AS xs FROM m)
SELECT DISTINCT id, unnest(generate_series(1, len(xs)))::INTEGER AS pos, unnest(xs) AS tag FROM u"""


@general.query("p2_found", _P2)
def p2_found(spark, d):
    return _p2(spark, d).select("id", "pos", "tag").distinct()


#: Values with their flags: brackets are tokens too, a mark that no value takes is malformed.
_P2_VALUES = _P2[: _P2.index("m AS (SELECT DISTINCT id,")] + r"""r AS (SELECT '"(?:\\.|""|[^"\\])*"|''(?:\\.|''''|[^''\\])*''|`[^`]*`|“[^”]*”|‘[^’]*’|[\p{L}\p{M}\p{N}' || signs || ']*[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}' || signs || ']*|[\[\](){}]' AS r FROM s),
m AS (SELECT DISTINCT id, tags, regexp_extract_all(tags, r) AS xs, regexp_matches(regexp_replace(tags, r, '', 'g'), '["''`“‘«„「]') AS malformed FROM legacy_notes, r WHERE tags IS NOT NULL),
d AS (SELECT *, list_transform(xs, lambda x, i: len(list_filter(xs[1:i], lambda y: y IN ('(', '[', '{'))) - len(list_filter(xs[1:i], lambda y: y IN (')', ']', '}')))) AS ds FROM m),
v AS (SELECT id, malformed, coalesce(list_min(ds) < 0 OR ds[-1] <> 0, false) AS unbalanced, list_filter(list_transform(xs, lambda x, i: {'quoted': regexp_matches(x, '^["''`“‘]'), 'bracketed': ds[i] > 0, 'tag': trim(CASE
  WHEN x LIKE '"%"' THEN replace(replace(x[2:-2], chr(92) || '"', '"'), '""', '"') WHEN x LIKE '''%''' THEN replace(replace(x[2:-2], chr(92) || '''', ''''), '''''', '''')
  WHEN regexp_matches(x, '^[`“‘]') THEN x[2:-2] WHEN regexp_matches(x, '^[\[\](){}]$') THEN '' ELSE x END)}), lambda t: t.tag <> '') AS vs FROM d)
SELECT DISTINCT id, pos::INTEGER AS pos, t.tag AS tag, t.quoted AS quoted, t.bracketed AS bracketed, malformed, unbalanced FROM (SELECT id, malformed, unbalanced, unnest(vs) AS t, generate_subscripts(vs, 1) AS pos FROM v)"""


@general.query("p2_values", _P2_VALUES)
def p2_values(spark, d):
    """Every value with its place and flags: quoted, bracketed, in a field with a malformed quotation or uneven brackets."""
    return _p2(spark, d).distinct()
