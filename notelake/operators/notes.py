r"""Notes that are written or imported: safety, building, connecting, merging, legacy rows.

Defined results: null title or content counts as empty; rows without content are not imported; equal slugs of one agent
get the suffixes -2, -3, ... in the order of their row ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO, slug, strip, strip_end, utf16_length
from ..session import cut_lineage
from .documents import FENCED, WIKI, tags_of
from .ranges import rank_within

_A, _Z = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Labels of secrets and the patterns that find them.
SECRETS = (
    ("private key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("OpenAI API key", f"{_A}sk-[A-Za-z0-9_-]{{20,}}{_Z}"),
    ("GitHub token", f"{_A}(?:ghp|gho|ghs|ghr|github_pat)_[A-Za-z0-9_]{{20,}}{_Z}"),
    ("AWS access key", f"{_A}AKIA[0-9A-Z]{{16}}{_Z}"),
    ("Slack token", f"{_A}xox[abprs]-[A-Za-z0-9-]{{20,}}{_Z}"),
    ("JWT", rf"{_A}eyJ[A-Za-z0-9_-]{{10,}}\.eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}{_Z}"),
    ("secret assignment", rf"(?i){_A}(?:api[_-]?key|secret|password|private[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*[\"']?[A-Za-z0-9_./+=-]{{12,}}"),
)
MAX_TITLE, MAX_CONTENT = 160, 200_000
HUB, ROOT = "Memory Hub", "Knowledge Root"
#: What the hub notes say.
HUB_TEXT = "Central memory index for this agent namespace. #memory #hub"
ROOT_TEXT = "Entry point for agent memory. [[Memory Hub]] #memory #root"


def secrets(text: Column) -> Column:
    """The labels of the kinds of secrets in a text."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in SECRETS)))


def problems(title: Column, content: Column, allow_secrets: bool = False) -> Column:
    """Why a note would be refused: an empty array if it would not."""
    t, c = F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))
    found = secrets(F.concat(t, F.lit("\n"), c))
    return F.array_compact(
        F.array(
            F.when(strip(t) == "", F.lit("empty title")),
            F.when(strip(c) == "", F.lit("empty content")),
            F.when(utf16_length(t) > MAX_TITLE, F.lit("long title")),
            F.when(utf16_length(c) > MAX_CONTENT, F.lit("long content")),
            *([] if allow_secrets else [F.when(F.size(found) > 0, F.concat(F.lit("secrets: "), F.array_join(found, ", ")))]),
        )
    )


def file_slug(title: Column) -> Column:
    """The file name of a title: lower-case letters, digits and hyphens, or untitled."""
    bare = F.lower(F.regexp_replace(F.translate(F.coalesce(title, F.lit("")), FOLD_FROM, FOLD_TO), r"\p{Mn}", ""))
    dashed = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("untitled"))


def build_text(title: Column, content: Column, agent: Column) -> Column:
    quoted = F.replace(title, F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('---\ntitle: "'), quoted, F.lit('"\nagent: "'), agent, F.lit('"\n---\n\n# '), title, F.lit("\n\n"), strip(content), F.lit("\n"))


def _same_title(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"(?i)\.md$", ""))


def connected(title: Column, content: Column) -> Column:
    """The content, with a line to the hub (the hub itself: to the root) if it cites no other note."""
    cited = F.regexp_extract_all(F.regexp_replace(content, FENCED, "$1"), F.lit(WIKI), F.lit(1))
    other = F.exists(cited, lambda t: (strip(t) != "") & (_same_title(t) != _same_title(title)))
    target = F.when(_same_title(title) == HUB.lower(), F.lit(ROOT)).otherwise(F.lit(HUB))
    return F.when(other, strip(content)).otherwise(F.concat(strip(content), F.lit("\n\nRelated: [["), target, F.lit("]]")))


def added(rows: DataFrame, there: DataFrame) -> DataFrame:
    """path, agent_id, title, content, auto_linked, link_target of rows(id, title, content, agent) that agents add as notes.

    Rows with problems are left out; of rows with one path the last id counts, as it would be written over the others.
    A note that cites no other gets a line to its agent's hub; hubs that are then missing among the new notes and those
    that are ``there`` (column path) come out as notes too.
    """
    good = rows.where(F.size(problems(F.col("title"), F.col("content"))) == 0)
    base = good.select("id", "title", "content", slug(F.coalesce("agent", F.lit("")), "shared").alias("agent_id"))
    text = connected(F.col("title"), F.col("content"))
    note = base.withColumn("text", text).withColumn("auto_linked", F.col("text") != strip(F.col("content")))
    target = F.when(F.col("auto_linked"), F.when(_same_title(F.col("title")) == HUB.lower(), F.lit(ROOT)).otherwise(F.lit(HUB)))
    path = F.concat(F.lit("agents/"), "agent_id", F.lit("/"), file_slug(F.col("title")), F.lit(".md"))
    note = cut_lineage(note.select("id", path.alias("path"), "agent_id", "title", "text", "auto_linked", target.alias("link_target")), "added")
    last = note.groupBy("path").agg(F.max_by(F.struct("agent_id", "title", "text", "auto_linked", "link_target"), "id").alias("n")).select("path", "n.*")
    hub = F.col("title") == HUB
    hubs = note.where("link_target IS NOT NULL").select("agent_id", F.col("link_target").alias("title")).distinct()
    hubs = hubs.select(F.concat(F.lit("agents/"), "agent_id", F.lit("/"), file_slug(F.col("title")), F.lit(".md")).alias("path"), "agent_id", "title", F.when(hub, F.lit(HUB_TEXT)).otherwise(F.lit(ROOT_TEXT)).alias("text"))
    hubs = hubs.join(note.select("path").unionByName(there.select("path")), "path", "left_anti").withColumns({"auto_linked": F.lit(False), "link_target": F.lit(None).cast("string")})
    every = last.unionByName(hubs)
    return every.select("path", "agent_id", "title", build_text(F.col("title"), F.col("text"), F.col("agent_id")).alias("content"), "auto_linked", "link_target")


def add_related(content: Column, title: Column) -> Column:
    """A low-priority link to the title at the end, unless the content cites it already."""
    cited = F.contains(F.regexp_replace(F.lower(content), r"\[\[\s*", "[["), F.concat(F.lit("[["), F.lower(title)))
    return F.when(cited, content).otherwise(F.concat(strip_end(content), F.lit("\n\nRelated: [["), title, F.lit("]] priority: low #related-to\n")))


def merged(content: Column, other_title: Column, other_body: Column) -> Column:
    """The content with the other note's body under a heading of its own, once."""
    mark = F.concat(F.lit("## Merged Memory From [["), other_title, F.lit("]]"))
    body = strip(F.regexp_replace(other_body, r"\s+", " "))
    return F.when(F.contains(content, mark), content).otherwise(F.concat(strip_end(content), F.lit("\n\n"), mark, F.lit("\n\n"), body, F.lit("\n")))


def merged_into(content: Column, title: Column) -> Column:
    """The content with a line that says which note it was merged into, once."""
    mark = F.concat(F.lit("Merged into [["), title, F.lit("]]"))
    return F.when(F.contains(content, mark), content).otherwise(F.concat(strip_end(content), F.lit("\n\n"), mark, F.lit(" priority: low #related-to\n")))


def legacy_tags(tags: Column) -> Column:
    """The plain tags of a legacy field: split at white space and separators, lower case, well-formed ones, each once."""
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), r"[\s\p{Z}\x{FEFF},;|]+"), lambda t: F.lower(F.regexp_replace(F.trim(t), "^#", "")))
    return F.array_distinct(F.filter(parts, lambda t: t.rlike("^[a-z0-9][a-z0-9_-]*$")))


def unique_paths(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """row, path of rows(row, id, base): base.md, base-2.md and so on, each path once and none that is taken.

    The rows of a base get its free numbers by id. A path that two bases come to (foo-2 of foo, and foo-2 itself) goes to
    the smallest id; the others try again, in rounds.
    """
    number = F.when(F.col("rank") > 1, F.concat(F.lit("-"), F.col("rank").cast("string"))).otherwise(F.lit(""))
    used, todo, done = None if taken is None else taken.select("path").distinct(), rows, None
    while True:
        ranked = rank_within(todo.select("row", "id", "base"), ["base"], [F.asc("id"), F.asc("row")], "v").withColumn("kind", F.lit(0))
        if used is not None:  # the r-th free number is r and the taken ones before it: the place among both
            whole = used.select(F.regexp_extract("path", r"(?s)^(.*)\.md$", 1).alias("base"), F.lit(1).cast("bigint").alias("t"))
            cut = used.select(F.regexp_extract("path", r"(?s)^(.*)-[1-9][0-9]{0,17}\.md$", 1).alias("base"), F.regexp_extract("path", r"-([1-9][0-9]{0,17})\.md$", 1).alias("t"))
            known = whole.unionByName(cut.where("base <> '' AND t <> '1'").withColumn("t", F.col("t").cast("bigint"))).join(todo.select("base").distinct(), "base", "left_semi")
            before = rank_within(known, ["base"], [F.asc("t")], "j")
            ranked = ranked.unionByName(before.select("base", (F.col("t") - F.col("j")).alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("row")), allowMissingColumns=True)
            ranked = rank_within(ranked.withColumnRenamed("v", "w"), ["base"], [F.asc("w"), F.asc("kind")])
        else:
            ranked = ranked.withColumnRenamed("v", "rank")
        named = cut_lineage(ranked.where("kind = 0").select("row", "id", "base", F.concat("base", number, F.lit(".md")).alias("path")), "named")
        won = named.groupBy("path").agg(F.min(F.struct("id", "row")).alias("m")).select("path", "m.row")
        won = cut_lineage(won, "settled")
        done = won if done is None else done.unionByName(won)
        todo = cut_lineage(named.join(won.select("row"), "row", "left_anti"), "clashing")
        if todo.isEmpty():
            return done
        used = won.select("path") if used is None else used.unionByName(won.select("path"))


def import_legacy(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """row_id, agent_id, title, path, content of the notes that legacy rows (id, title, content, agent, tags, path) become.

    taken: paths that exist already (column path). See unique_paths.
    """
    content, path = strip(F.coalesce("content", F.lit(""))), strip(F.coalesce("path", F.lit("")))
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    from_path = strip(F.regexp_replace(name, "[-_]+", " "))
    title = F.coalesce(F.nullif(strip(F.col("title")), F.lit("")), F.nullif(from_path, F.lit("")), F.concat(F.lit("Imported Memory "), F.col("id").cast("string")))
    base = rows.select("id", title.alias("title"), content.alias("body"), slug(F.coalesce("agent", F.lit("")), "shared").alias("agent_id"), legacy_tags(F.col("tags")).alias("tags"))
    base = base.where("body <> ''").withColumn("slug", file_slug(F.col("title"))).withColumn("folder", F.concat(F.lit("agents/"), "agent_id", F.lit("/")))
    missing = F.filter("tags", lambda t: ~F.array_contains(F.transform(tags_of(F.col("body")), lambda x: F.lower(x)), t))
    tag_line = F.when(F.size(missing) > 0, F.concat(F.lit("\n\nTags: "), F.array_join(F.transform(missing, lambda t: F.concat(F.lit("#"), t)), " "))).otherwise(F.lit(""))
    text = base.withColumn("text", connected(F.col("title"), F.concat("body", tag_line)))
    text = cut_lineage(text.withColumn("base", F.concat("folder", "slug")).withColumn("row", F.monotonically_increasing_id()), "imported")
    paths = unique_paths(text.select("row", "id", "base"), taken)
    ranked = text.join(paths, "row")
    return ranked.select(F.col("id").alias("row_id"), "agent_id", "title", "path", build_text(F.col("title"), F.col("text"), F.col("agent_id")).alias("content"))
