r"""From note texts to documents, references and links: all expressions on the JVM side, no shuffle before the grouping.

Defined results: null content counts as empty; a note without path has no id and is left out; of several rows of one note
the latest is taken; a heading in a code fence still titles a note; an unclosed fence hides links but not tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import slug, strip

FRONT = r"^---\n([\s\S]*?)\n---\n?"
#: A fence toggles at any line that opens with three backticks or tildes; the closing line is visible again.
FENCED = r"(?m)^[^\S\n]*(?:```|~~~)(?:[\s\S]*?(\n[^\S\n]*(?:```|~~~)[^\n]*)|[\s\S]*\z)"
WIKI = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
#: What gives a line its priority, in order of precedence.
KEY = "(?:priority|prioridade|importance|importancia|importância)"
PRIORITY_WORDS = (
    ("critical", "critical|critica|crítica|urgent|urgente|p0", "critical|critica|crítica|urgent|urgente|p0"),
    ("high", "high|alta|important|importante|p1", "high-priority|important|importante|p1"),
    ("normal", "normal|medium|media|média|p2", "normal-priority|medium-priority|p2"),
    ("low", "low|baixa|p3", "low-priority|baixa-prioridade|p3"),
)
#: What a priority adds to the weight of a reference, and its rank.
BOOST = {"low": 0, "normal": 1, "high": 3, "critical": 6}
RANK = {"low": 0, "normal": 1, "high": 2, "critical": 3}
MAX_WEIGHT = 12


def latest(notes: DataFrame) -> DataFrame:
    """One row per note id: the one updated last."""
    order = [F.col("updated_at").desc_nulls_last(), "path", "content"]
    w = Window.partitionBy("id").orderBy(*order)
    return notes.where("id IS NOT NULL AND path IS NOT NULL").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stable_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 24)


def tidy_title(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?i)\.md$", "")


def front_matter(content: Column) -> Column:
    """The flat map of the leading block; of repeated keys the last wins, one pair of quotes is taken off."""
    block = F.regexp_extract(content, FRONT, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^:#]+:\s*.+$"))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            strip(F.regexp_extract(x, r"^([^:#]+):", 1)).alias("key"),
            F.regexp_replace(strip(F.regexp_extract(x, r"^[^:#]+:\s*(.+)$", 1)), "^[\"']|[\"']$", "").alias("value"),
        ),
    )
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def agent_of(path: Column, named: Column) -> Column:
    from_path = F.regexp_extract(F.translate(path, "\\", "/"), r"^agents/([^/]+)/", 1)
    return F.when(F.coalesce(named, F.lit("")) != "", slug(named, "shared")).when(from_path != "", slug(from_path, "shared")).otherwise(F.lit("shared"))


def tags_of(content: Column) -> Column:
    body = F.regexp_replace(content, FRONT, "")
    open_text = F.regexp_replace(F.regexp_replace(body, r"```[\s\S]*?```", ""), r"~~~[\s\S]*?~~~", "")
    return F.array_distinct(F.regexp_extract_all(open_text, F.lit(r"(^|[\s\x{A0}])#([A-Za-z0-9][A-Za-z0-9_-]*)"), F.lit(2)))


def documents(notes: DataFrame) -> DataFrame:
    """id, agent_id, title, path, content, tags, frontmatter, created_at, updated_at from path, content and times."""
    content = F.coalesce(F.col("content"), F.lit(""))
    base = notes.where(F.col("path").isNotNull()).select("path", content.alias("content"), "created_at", "updated_at")
    base = base.withColumn("frontmatter", front_matter(F.col("content")))
    named = F.col("frontmatter")["title"]
    heading = F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1)
    file = F.regexp_extract("path", r"([^/\\]*)$", 1)
    title = F.when(F.coalesce(named, F.lit("")) != "", tidy_title(named)).when(heading != "", tidy_title(heading)).otherwise(tidy_title(file))
    return base.select(
        stable_id(F.col("path")).alias("id"),
        agent_of(F.col("path"), F.col("frontmatter")["agent"]).alias("agent_id"),
        title.alias("title"),
        "path",
        "content",
        tags_of(F.col("content")).alias("tags"),
        "frontmatter",
        "created_at",
        "updated_at",
    )


def line_priority(line: Column) -> Column:
    """critical, high, normal, low or null; word edges are those of ASCII."""
    out = None
    for name, words, tags in PRIORITY_WORDS:
        text = rf"(?i)(?<![A-Za-z0-9_]){KEY}\s*[:=]\s*(?:{words})(?![A-Za-z0-9_])"
        tag = rf"(?i)#(?:{tags})(?![A-Za-z0-9_])"
        hit = line.rlike(text) | line.rlike(tag)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def references(docs: DataFrame) -> DataFrame:
    """One row per cited title on a visible line: from_document_id, agent_id, line, nth, to_title, weight, priority."""
    visible = F.regexp_replace("content", FENCED, "$1")
    lines = docs.where(F.col("content").contains("[[")).select(
        F.col("id").alias("from_document_id"), "agent_id", F.posexplode(F.split(visible, "\n")).alias("line", "text")
    ).where(F.col("text").contains("[["))
    priority = line_priority(F.col("text"))
    boost = F.coalesce(*(F.when(F.col("priority") == k, F.lit(v)) for k, v in BOOST.items()), F.lit(0))
    heading = F.when(F.col("text").rlike(r"^\s{0,3}#{1,6}\s+"), 2).otherwise(0)
    task = F.when(F.col("text").rlike(r"(?i)^\s*[-*]\s+\[[ x]\]"), 1).otherwise(0)
    marked = lines.withColumn("priority", priority)
    weighed = marked.withColumn("weight", (F.lit(1) + boost + heading + task).cast("int"))
    found = F.posexplode(F.regexp_extract_all("text", F.lit(WIKI), F.lit(1)))
    return (
        weighed.select("from_document_id", "agent_id", "line", "priority", "weight", found.alias("nth", "raw"))
        .select("from_document_id", "agent_id", "line", "nth", tidy_title(F.col("raw")).alias("to_title"), "weight", "priority")
        .where("to_title <> ''")
    )


def link_weights(refs: DataFrame) -> DataFrame:
    """One row per (document, written title): the references of titles that differ in case share one weight.

    The running sum clamped to 1..12 has a closed form because each reference weighs at least 1.
    """
    rank = F.coalesce(*(F.when(F.col("priority") == k, F.lit(v)) for k, v in RANK.items()))
    per_title = refs.groupBy("from_document_id", F.lower("to_title").alias("title_key"), "to_title", "agent_id").agg(
        F.sum("weight").alias("w"), F.count("*").alias("n"), F.max(rank).alias("r")
    )
    keys = per_title.groupBy("from_document_id", "title_key").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.max("r").alias("r"))
    weight = F.least(F.lit(MAX_WEIGHT), F.col("w")).cast("int")
    derived = F.when(F.col("weight") >= 8, 3).when(F.col("weight") >= 4, 2).otherwise(1)
    level = F.when((F.col("r") == 0) & (F.col("weight") == 1), 0).otherwise(F.greatest(F.coalesce("r", derived), derived))
    name = F.element_at(F.array(*(F.lit(k) for k in RANK)), level.cast("int") + 1)
    scored = keys.withColumn("weight", weight).withColumn("priority", name)
    return per_title.select("from_document_id", "agent_id", "title_key", "to_title").join(
        scored.select("from_document_id", "title_key", "weight", "priority"), ["from_document_id", "title_key"]
    )


def titles(docs: DataFrame) -> DataFrame:
    """agent_id, title_key, id: of notes that share a title in an agent, the first by path."""
    return docs.groupBy("agent_id", F.lower("title").alias("title_key")).agg(F.min_by("id", F.struct("path", "id")).alias("id"))


def links(docs: DataFrame) -> DataFrame:
    """from_document_id, to_title, to_document_id, weight, priority: the agent's own title first, then a shared one."""
    names = titles(docs)
    own = names.select("agent_id", "title_key", F.col("id").alias("own_id"))
    shared = names.where("agent_id = 'shared'").select("title_key", F.col("id").alias("shared_id"))
    written = link_weights(references(docs))
    found = written.join(own, ["agent_id", "title_key"], "left").join(shared, "title_key", "left")
    to = F.coalesce("own_id", "shared_id")
    return found.select("from_document_id", "to_title", to.alias("to_document_id"), "weight", "priority").where(
        F.col("to_document_id").isNull() | (F.col("to_document_id") != F.col("from_document_id"))
    )
