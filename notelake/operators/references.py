"""References to records that do not exist (problem 1).

A reference is a (field, key, agent) that a link row cites at the time it was indexed. The distinct references are
anti-joined against the keys of the notes, and the orphans that remain are joined back to the rows that cite them.

A key exists at T if one of its notes was there. Notes that were never removed are reduced, before the join and on the map
side, to one row per (field, key, agent): the earliest time from which one exists. References that this decides go no
further. For the others the removed notes count: the removals of a note are added up in the order of time to the moments
at which it went and came back, these and its creation are the events of its keys, and a running sum over the events and
references of a key in the order of time says how many of its notes were there. Sums run over range partitions
(``running_sum``), so neither a note with very many removals, nor a key with very many notes or references, is gathered in
one row or one task.

Defined results: null and blank references are none; a null ``indexed_at`` is a time at which only notes without a
creation time exist; a null ``created_at`` counts as always; a null agent cites ``shared``; notes without id, title or
path have no such key; removals without ``removed_at`` are ignored; repeated rows count once; an empty table of notes
makes every reference an orphan; an empty table of links gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, path_key, title_key
from ..session import cut_lineage
from .ranges import running_sum

#: The scope of titles that all agents may cite, and that of keys without an agent.
SHARED, EVERYONE = "shared", "*"
FIELDS = ("from_document_id", "to_title", "to_path")


def _always() -> F.Column:
    """Before every time in the data."""
    return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")


def _time(c) -> F.Column:
    return c.cast("timestamp_ntz")


def references(links: DataFrame) -> DataFrame:
    """One row per citing (link_id, ref_field) with the key it cites and when: link_id, ref_field, key, agent, at."""
    agent = F.coalesce(F.col("agent_id"), F.lit(SHARED))
    anyone = F.lit(None).cast("string")

    def entry(field: str, key, scope) -> F.Column:
        blank = is_blank(F.col(field))
        return F.when(~blank, F.struct(F.lit(field).alias("ref_field"), key.alias("key"), scope.alias("agent")))

    cited = F.array_compact(
        F.array(
            entry("from_document_id", F.col("from_document_id"), anyone),
            entry("to_title", title_key(F.col("to_title")), agent),
            entry("to_path", path_key(F.col("to_path")), anyone),
        )
    )
    return links.select("link_id", _time(F.col("indexed_at")).alias("at"), F.explode(cited).alias("r")).select(
        "link_id", "at", "r.ref_field", "r.key", "r.agent"
    )


def absences(removed: DataFrame) -> DataFrame:
    """id, t, step: -1 at each moment at which a note goes away, 1 when it is back; overlapping removals are one absence."""
    back = _time(F.col("restored_at"))
    spans = removed.where(F.col("document_id").isNotNull()).select(F.col("document_id").alias("id"), _time(F.col("removed_at")).alias("gone"), back.alias("back"))
    real = spans.where(F.col("gone").isNotNull() & (F.col("back").isNull() | (F.col("back") > F.col("gone"))))
    ends = F.array(F.struct(F.col("gone").alias("t"), F.lit(1).alias("n")), F.struct(F.col("back").alias("t"), F.lit(-1).alias("n")))
    events = real.select("id", F.explode(ends).alias("e")).select("id", "e.t", "e.n").where("t IS NOT NULL")
    events = events.groupBy("id", "t").agg(F.sum("n").alias("n")).where("n <> 0")
    open_ = running_sum(events, ["id"], [F.asc("t")], F.col("n"), "now")
    step = F.when((F.col("now") > 0) & (F.col("now") == F.col("n")), -1).when(F.col("now") == 0, 1)
    return open_.select("id", "t", step.alias("step")).where("step IS NOT NULL")


def keyed(notes: DataFrame) -> DataFrame:
    """ref_field, key, scope, id, made: what each note can be cited by; ids and paths have the scope of everyone."""
    dated = notes.where(F.col("id").isNotNull()).select("id", "agent_id", "title", "path", F.coalesce(_time(F.col("created_at")), _always()).alias("made"))
    entry = lambda field, key, scope: F.struct(F.lit(field).alias("ref_field"), key.alias("key"), scope.alias("scope"))
    keys = F.array_compact(
        F.array(
            entry("from_document_id", F.col("id"), F.lit(EVERYONE)),
            F.when(F.col("title").isNotNull(), entry("to_title", title_key(F.col("title")), F.coalesce(F.col("agent_id"), F.lit(SHARED)))),
            F.when(F.col("path").isNotNull(), entry("to_path", path_key(F.col("path")), F.lit(EVERYONE))),
        )
    )
    return dated.select("id", "made", F.explode(keys).alias("k")).select("k.*", "id", "made")


def orphan_references(links: DataFrame, notes: DataFrame, removed: DataFrame) -> DataFrame:
    """Every reference to a note that does not exist when the link is indexed: link_id, ref_field, at."""
    cited = references(links)
    scopes = F.when(F.col("agent").isNull(), F.array(F.lit(EVERYONE))).otherwise(F.array_distinct(F.array("agent", F.lit(SHARED))))
    when = F.coalesce("at", _always())
    keys = cited.select("ref_field", "key", "agent", "at").distinct()
    by = ["ref_field", "key", "scope"]

    gone = removed.where("document_id IS NOT NULL AND removed_at IS NOT NULL").select(F.col("document_id").alias("id")).distinct().withColumn("frail", F.lit(True))
    every = keyed(notes).join(gone, "id", "left")
    firm = every.where("frail IS NULL").groupBy(*by).agg(F.min("made").alias("since"))
    p = firm.select(F.col("ref_field").alias("p_field"), F.col("key").alias("p_key"), F.col("scope").alias("p_scope"), "since")
    there = (F.col("ref_field") == F.col("p_field")) & (F.col("key") == F.col("p_key")) & F.array_contains(scopes, F.col("p_scope")) & (F.col("since") <= when)
    open_ = cut_lineage(keys.join(p, there, "left_anti"), "undecided")

    frail = every.where("frail").groupBy(*by, "id").agg(F.min("made").alias("made")).join(firm, by, "left").where("since IS NULL OR made < since")
    frail = cut_lineage(frail.select(*by, "id", "made"), "removed-once")
    asks = open_.select("ref_field", "key", "agent", "at", F.explode(scopes).alias("scope")).join(frail.select(*by).distinct(), by, "left_semi")
    made = frail.select(*by, F.col("made").alias("t"), F.lit(1).alias("n"))
    moves = frail.join(absences(removed), "id").select(*by, F.greatest("t", "made").alias("t"), F.col("step").alias("n"))
    events = made.unionByName(moves).groupBy(*by, "t").agg(F.sum("n").alias("n")).where("n <> 0")
    line = events.select(*by, "t", "n", F.lit(None).cast("string").alias("agent"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(0).alias("ask"))
    line = line.unionByName(asks.select(*by, when.alias("t"), F.lit(0).cast("bigint").alias("n"), "agent", "at", F.lit(1).alias("ask")))
    alive = running_sum(line, by, [F.asc("t"), F.asc("ask")], F.col("n"), "alive").where("ask = 1 AND alive > 0")
    found = alive.select(F.col("ref_field").alias("f_field"), F.col("key").alias("f_key"), F.col("agent").alias("f_agent"), F.col("at").alias("f_at"))

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    orphans = open_.join(found, same("ref_field", "f_field") & same("key", "f_key") & same("agent", "f_agent") & same("at", "f_at"), "left_anti")
    o = orphans.select(*(F.col(c).alias(f"o_{c}") for c in orphans.columns))
    back = (F.col("ref_field") == F.col("o_ref_field")) & (F.col("key") == F.col("o_key")) & same("agent", "o_agent") & same("at", "o_at")
    return cited.join(o, back, "left_semi").select("link_id", "ref_field", "at").distinct()


def orphan_counts(links: DataFrame, notes: DataFrame, removed: DataFrame) -> DataFrame:
    """Orphans and all references per field and month: ref_field, month (yyyy-MM), orphans, refs, links."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    all_refs = references(links).select("link_id", "ref_field", "at").distinct()
    marked = all_refs.select("link_id", "ref_field", month, F.lit(0).alias("o")).unionByName(
        orphan_references(links, notes, removed).select("link_id", "ref_field", month, F.lit(1).alias("o"))
    )
    return marked.groupBy("ref_field", "month").agg(
        F.sum(1 - F.col("o")).alias("refs"), F.sum("o").alias("orphans")
    )
