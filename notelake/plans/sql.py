"""Pieces of SQL that several queries are checked with."""

from __future__ import annotations

from ..functions.embed import ALIASES, STOP_WORDS


def embedded(name: str, source: str) -> str:
    """CTEs that end in ``name`` (id, x DOUBLE[192]): the local embedding of source(id, text), stated in SQL alone."""
    stop = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    also = ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in ALIASES.items())
    return rf"""{name}_w AS (SELECT id, flatten(list_transform(list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+'), lambda t: lower(strip_accents(t))),
    lambda t: length(t) > 1 AND t NOT IN ({stop})), lambda t: list_concat([t], coalesce(MAP {{{also}}}[t], [])))) AS w FROM {source}),
  {name}_f AS (SELECT id, unnest(list_concat(list_transform(w, lambda t: {{'f': 't:' || t, 'u': 1.0}}), list_transform(range(1, len(w)), lambda i: {{'f': 'b:' || w[i] || ':' || w[i + 1], 'u': 0.65}}))) AS f FROM {name}_w),
  {name}_h AS (SELECT id, f.u AS u, list_reduce(list_transform(string_split(f.f, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::BIGINT) AS h FROM {name}_f),
  {name}_d AS (SELECT id, h % 192 AS d, sum(CASE WHEN h % 2 = 1 THEN u ELSE -u END)::DOUBLE AS v FROM {name}_h GROUP BY ALL),
  {name}_n AS (SELECT id, map_from_entries(list({{'k': d, 'v': v}})) AS m, sqrt(sum(v * v)) AS size FROM {name}_d GROUP BY 1),
  {name} AS (SELECT s.id, list_transform(range(192), lambda d: coalesce(m[d] / nullif(size, 0.0), 0.0)) AS x FROM {source} s LEFT JOIN {name}_n n ON n.id = s.id)"""
