"""Documents, links, graph, search, context, duplicates on small vaults."""

import random
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.functions.embed import embed, features
from notelake.functions.text import query_tokens
from notelake.operators import chunks, context, dedupe, documents, graph, index, layout, notes, search, snapshots
from notelake.operators.documents import BOOST, MAX_WEIGHT, RANK

NOTE = "path string, content string, created_at timestamp, updated_at timestamp"


def docs_of(spark, pairs):
    return documents.documents(spark.createDataFrame([(p, c, None, None) for p, c in pairs], NOTE))


def test_documents_and_links(spark):
    docs = docs_of(
        spark,
        [
            ("agents/coding-agent/arch.md", "# Architecture\n\nSee [[Auth#JWT|JWT notes]] and [[Auth]] #auth #jwt #auth"),
            ("agents/coding-agent/auth.md", '---\ntitle: "Auth"\nagent: "Coding Agent"\ntitle: "Auth"\n---\n## Uses [[Architecture]]\n- [ ] Check [[architecture]] priority: high\n```\n[[Hidden]] #no\n```\n[[Auth]]'),
            ("notes/plain.MD", "```\n[[Open]] #tag\nno end"),
            ("x.md", None),
        ],
    )
    rows = {r.path: r for r in docs.collect()}
    assert rows["agents/coding-agent/auth.md"].agent_id == "coding-agent"
    assert rows["agents/coding-agent/auth.md"].title == "Auth"
    assert rows["agents/coding-agent/arch.md"].tags == ["auth", "jwt"]
    assert rows["notes/plain.MD"].title == "plain" and rows["notes/plain.MD"].tags == ["tag"]
    assert rows["x.md"].agent_id == "shared"
    links = {(r.to_title, r.weight, r.priority, r.to_document_id is None) for r in documents.links(docs).collect()}
    assert links == {("Auth", 2, "normal", False), ("Architecture", 8, "critical", False), ("architecture", 8, "critical", False)}


def test_weights_equal_the_running_fold(spark):
    rnd = random.Random(5)
    rows = [(f"d{rnd.randint(0, 60)}", "a", i, 0, rnd.choice("XxY"), rnd.randint(1, 6), rnd.choice([None, *RANK])) for i in range(400)]
    df = spark.createDataFrame(rows, "from_document_id string, agent_id string, line int, nth int, to_title string, weight int, priority string")
    got = {(r.from_document_id, r.title_key): (r.weight, r.priority) for r in documents.link_weights(df).collect()}
    names = list(RANK)
    for key in got:
        weight, explicit, out = 0, None, None
        for r in rows:
            if (r[0], r[4].lower()) == key:
                weight = max(1, min(MAX_WEIGHT, weight + r[5]))
                if r[6]:
                    explicit = max(r[6], out or r[6], key=RANK.get)
                else:
                    explicit = out
                derived = "critical" if weight >= 8 else "high" if weight >= 4 else "normal"
                out = "low" if explicit == "low" and weight == 1 else max(explicit or derived, derived, key=RANK.get)
        assert got[key] == (weight, out), (key, names, BOOST)


def test_graph_reports(spark):
    docs = spark.createDataFrame([("a", "s", "A", "a.md", ["x"]), ("b", "s", "B", "b.md", ["y"]), ("c", "s", "C", "c.md", ["x"]), ("d", "s", "D", "d.md", None)], "id string, agent_id string, title string, path string, tags array<string>")
    links = spark.createDataFrame([("a", "B", "b", 1, "normal"), ("a", "Missing", None, 9, "low"), ("d", "Gone", None, 1, "low")], "from_document_id string, to_title string, to_document_id string, weight int, priority string")
    assert [r.id for r in graph.orphans(docs, links).collect()] == ["c"]
    assert {(r.title, r.missing) for r in graph.broken_links(docs, links).collect()} == {("A", "Missing"), ("D", "Gone")}
    s = graph.extended_stats(docs, links).first()
    assert (s.documents, s.links, s.resolved_links, s.broken_links, s.orphans, s.tags, s.ok, s.low_links, s.broken_ratio) == (4, 3, 1, 2, 1, 2, False, 2, 0.6667)
    assert {r.id: r.degree for r in graph.degrees(docs, links).collect()} == {"a": 9, "b": 1, "c": 0, "d": 1}
    none = graph.stats(docs.limit(0), links.limit(0)).first()
    assert (none.documents, none.links, none.ok) == (0, 0, True)


def test_components_of_chain_star_and_loner(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("s0", f"s{i}") for i in range(1, 30)]
    nodes = {x for e in edges for x in e} | {"z"}
    df = graph.components(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "a string, b string"))
    got = {r.id: r.component for r in df.collect()}
    assert got == {x: "n000" if x[0] == "n" else "s0" if x[0] == "s" else "z" for x in nodes}


CHUNK = "document_id string, agent_id string, title string, path string, chunk_id string, chunk_ordinal int, content string, tags array<string>, embedding array<double>"


def test_search_modes(spark):
    rows = [
        ("d1", "a", "Auth Décision", "a/x.md", "c1", 0, "jwt jwt jwt jwt jwt jwt jwt jwt", ["jwt"], embed("jwt token auth")),
        ("d2", "b", None, None, "c2", 0, None, None, None),
        ("d3", "a", "Graph", "g.md", "c3", 1, "graph layout", [], [0.0] * 192),
        ("d1", "a", "Auth Décision", "a/x.md", "c1", 0, "jwt jwt jwt jwt jwt jwt jwt jwt", ["jwt"], embed("jwt token auth")),
    ]
    df = spark.createDataFrame(rows, CHUNK)
    top = search.search(df, "JWT decisao decision", 5, "fts").collect()
    assert [(r.chunk_id, r.text_score) for r in top] == [("c1", 5 + 4 + 6)]
    assert search.search(df, "jwt", 5, "fts", cap=search.PACK_CAP).first().text_score == 4 + 5
    assert [r.chunk_id for r in search.search(df, "authentication", 5, "semantic").collect()] == ["c1"]
    assert search.search(df, "jwt", 5, "hybrid", agent="b").count() == 0
    assert [r.chunk_id for r in search.search(df, "a b", 5, "fts").collect()] == ["c2", "c1", "c3"]
    assert search.search(df, "jwt", 0).count() == 0
    assert query_tokens("a Ção-x ção-x") == ["cao-x", "cao-x"]


def test_embedding(spark):
    assert len(embed("x y")) == 192 and embed("") == [0.0] * 192
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert dot(embed("auth token login"), embed("authentication with jwt")) > dot(embed("auth token login"), embed("graph layout"))
    assert ("b:jwt:token", 0.65) in features("jwt")


def test_context(spark):
    result = "document_id string, title string, path string, chunk_id string, chunk_ordinal int, content string, score double, search_mode string, tags array<string>"
    rows = [("a", "A", "a", f"a{o}", o, "x" * 40, s, "fts", ["t"]) for o, s in ((1, 10.0), (2, 12.0), (3, 9.0), (4, 1.0))] + [("b", "B", "b", "b1", 0, "y", 11.0, "fts", None)]
    got = context.context_sections(spark.createDataFrame(rows, result), 5000).orderBy("section").collect()
    assert [r.chunk_id for r in got] == ["a2", "a1", "a3", "b1"]
    tight = [("x", "X", "x", "x1", 0, "x" * 200, 3.0, "fts", []), ("y", "Y", "y", "y1", 0, "x" * 200, 2.0, "fts", []), ("z", "Z", "z", "z1", 0, "x" * 200, 1.0, "fts", [])]
    df = spark.createDataFrame(tight, result)
    assert [r.chunk_id for r in context.context_sections(df, 100).orderBy("section").collect()] == ["x1", "y1"]
    text = context.render(context.context_sections(df, 100), "q").first().content
    assert "## 1. X" in text and "Score: 3.000" in text
    assert "No relevant context" in context.render(context.context_sections(df.limit(0), 100), "q").first().content


def test_duplicates(spark):
    same = spark.createDataFrame([(f"p{i}", c) for i, c in enumerate(["---\na: b\n---\n# T\n\nbody", "# Other\nbody\r\n", "body", "else", None, ""])], "path string, content string")
    assert {(r.left_path, r.right_path) for r in dedupe.exact_duplicates(same).collect()} == {("p0", "p1"), ("p0", "p2"), ("p4", "p5")}
    rnd = random.Random(1)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    vec = {f"v{i:02}": [x + rnd.gauss(0, 0.05) for x in base[i % 30]] for i in range(60)} | {"w1": base[0], "w2": base[0], "zero": [0.0] * 16, "nan": [float("nan")] * 16, "short": [1.0], "null": None}
    df = spark.createDataFrame(list(vec.items()), "k string, v array<double>")
    norm = lambda a: sum(x * x for x in a) ** 0.5
    good = {k: v for k, v in vec.items() if v and len(v) == 16 and all(x == x for x in v) and norm(v)}
    want = {(a, b) for a in good for b in good if a < b and sum(x * y for x, y in zip(good[a], good[b], strict=True)) / norm(good[a]) / norm(good[b]) >= 0.92}
    got = {(r.left_id, r.right_id) for r in dedupe.semantic_duplicates(df, "k", "v", 16).collect()}
    assert got == want and len(want) > 30


def test_vector_classes_keep_links_of_large_classes(spark):
    rows = [(f"a{i:02}", [1.0, 2.0, 3.0]) for i in range(20)] + [("b", [1.0, 2.0, 3.1]), ("c", [3.0, -1.0, 0.0]), ("z", [0.0] * 3), ("n", None)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    pairs = {(r.left_id, r.right_id) for r in dedupe.semantic_duplicates(df, "id", "v", 3, all_pairs_up_to=5).collect()}
    assert pairs == {("a00", f"a{i:02}") for i in range(1, 20)} | {("a00", "b")}
    got = {r.id: (r.class_id, r.n_links) for r in dedupe.vector_classes(df, "id", "v", 3).collect()}
    assert got == {f"a{i:02}": ("a00", 1) for i in range(20)} | {"b": ("b", 1), "c": ("c", 0)}


def test_scan_of_notes(spark):
    body = "the token is checked before the session starts and again after the cache was dropped"
    rows = [("b.md", "a", "Auth", body), ("a\\c.md", "a", "Auth", body), ("d.md", "a", "Auth checks", body + " twice"), ("e.md", "b", None, None), ("f.md", "b", "", ""), ("x.md", "b", "Zq", "wholly different matter"), (None, "b", "n", "n")]
    docs = spark.createDataFrame(rows, "path string, agent_id string, title string, content string")
    got = [(r.left_path, r.right_path, r.kind) for r in dedupe.scan(docs).collect()]
    assert got == [("a/c.md", "b.md", "exact"), ("e.md", "f.md", "exact"), ("a/c.md", "d.md", "semantic"), ("b.md", "d.md", "semantic")]
    assert [r.right_path for r in dedupe.scan(docs, focus="e.md").collect()] == ["f.md"] and dedupe.scan(docs, limit=0).count() == 1
    assert dedupe.scan(docs, agent="b", semantic=False).count() == 1 and dedupe.scan(docs.limit(0)).count() == 0
    words = spark.createDataFrame([("One two", "TWO three", True), ("a of", "a of", False), (None, "x", False)], "a string, b string, w boolean")
    assert all(r.w == r.g for r in words.select("w", F.coalesce(dedupe.shared_words(F.col("a"), F.col("b")), F.lit(False)).alias("g")).collect())


def test_scan_in_stages_gives_the_first_pairs_of_all(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "_classes", None)  # the scan of all pairs at the least cosine
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(4))
    base = [[word() for _ in range(60)] for _ in range(6)]
    rows = [(f"k{i:02}.md", "a", "Copy", " ".join(base[0])) for i in range(55)]  # a large class
    rows += [(f"j{i}.md", "a", "Copy", " ".join([*base[0][:-1], word()])) for i in range(3)]  # near it, some before it by path
    rows += [(f"m{i}.md", "a", "Copy", " ".join(base[0]) + "." * (i + 1)) for i in range(3)]  # equal vectors, other bodies
    rows += [(f"v{i}{j}.md", "a", f"T{i}", " ".join([*base[i][: 60 - j], *(word() for _ in range(j))])) for i in range(1, 6) for j in range(5)]
    docs = spark.createDataFrame(rows, "path string, agent_id string, title string, content string")
    vec = {p: np.asarray(embed(f"{t}\n{c}")) for p, _, t, c in rows}
    body, score = {p: c for p, _, _, c in rows}, {}
    for a, b in combinations(sorted(vec), 2):
        exact = body[a] == body[b] and a == min(p for p in body if body[p] == body[a])
        if exact or vec[a] @ vec[b] >= 0.92:
            score[a, b] = (1.0, "exact") if exact else (round(float(vec[a] @ vec[b]), 4), "semantic")
    want = [(a, b, kind, s) for (a, b), (s, kind) in sorted(score.items(), key=lambda x: (-x[1][0], x[0]))]
    assert len(want) > 1700 and len({x[3] for x in want}) > 3
    for limit in (25, 60, 1720, 5000):
        got = [(r.left_path, r.right_path, r.kind, r.score) for r in dedupe.scan(docs, limit=limit, at_once=0).collect()]
        assert got == want[:limit], limit


def test_duplicates_of_one_note(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "_classes", None)  # the scan of all pairs
    text = "the token is checked before the session starts and again after the cache was dropped"
    rows = [(f"k{i:02}.md", "a", "Copy", text) for i in range(60)] + [("l.md", "a", "Copy", text + " twice"), ("z.md", "a", "Zq", "wholly different"), ("y.md", "a", "", "")]
    rows += [("./a.md", "a", "B", "another"), ("a.md", "a", "A", "alone"), ("b.md", "a", "C", "another")]  # of a.md's rows the one that counts has no duplicate
    docs = spark.createDataFrame(rows, "path string, agent_id string, title string, content string")
    got = {(r.left_path, r.right_path, r.kind) for r in dedupe.scan(docs, focus=dedupe.FIRST, limit=None).collect()}
    assert got == {("k00.md", f"k{i:02}.md", "exact") for i in range(1, 60)} | {("k00.md", "l.md", "semantic")}
    got = {(r.left_path, r.right_path, r.kind) for r in dedupe.scan(docs, focus="k59.md", limit=None).collect()}
    assert got == {("k00.md", "k59.md", "exact"), ("k59.md", "l.md", "semantic")} | {(f"k{i:02}.md", "k59.md", "semantic") for i in range(1, 59)}
    for focus in ("y.md", "gone.md"):
        assert dedupe.scan(docs, focus=focus).count() == 0
    assert dedupe.scan(docs.where("path > 'l'"), focus=dedupe.FIRST).count() == 0


def test_resolving_duplicates(spark):
    docs = spark.createDataFrame([("l.md", "Left", "# Left\n\nleft body\n\n"), ("r.md", "Right", "---\na: b\n---\n# Right\n\nright\n  body"), ("o.md", "Other", "o")], "path string, title string, content string")
    pair = spark.createDataFrame([("l.md", "r.md")], "left_path string, right_path string")
    run = lambda action: {r.path: r.content for r in dedupe.resolve(docs, pair, action).collect()}
    left = "# Left\n\nleft body\n\nRelated: [[Right]] priority: low #related-to\n"
    right = "---\na: b\n---\n# Right\n\nright\n  body\n\nRelated: [[Left]] priority: low #related-to\n"
    assert run("link") == {"l.md": left, "r.md": right} and run("ignore") == {"l.md": left}
    assert run("merge") == {
        "l.md": left.rstrip() + "\n\n## Merged Memory From [[Right]]\n\nright body\n",
        "r.md": right.rstrip() + "\n\nMerged into [[Left]] priority: low #related-to\n",
    }
    for bad in (("l.md", "l.md"), ("l.md", "no.md")):
        with pytest.raises(Exception, match="two different notes"):
            dedupe.resolve(docs, spark.createDataFrame([bad], "left_path string, right_path string"), "link").collect()
    with pytest.raises(ValueError):
        dedupe.resolve(docs, pair, "delete")


def test_index_runs(spark):
    note = lambda path, text, day: (path, text, None, datetime(2025, 1, day))
    df = lambda *rows: spark.createDataFrame(list(rows), "path string, content string, created_at timestamp_ntz, updated_at timestamp_ntz")
    ix = index.VaultIndex.new(spark)
    a, b, c = note("a.md", "# A\n\nsee [[C]] #t", 1), note("b.md", "# B\n\n[[A]]", 1), note("c.md", "# C\n\nlast", 2)
    first = ix.run(df(a, a, b, (None, "x", None, None))).first()
    assert (first.n_documents, first.n_chunks, first.n_links, first.n_changed, first.packs_due) == (2, 2, 2, 2, True)
    target = lambda: {(r.to_title, r.to_document_id is not None) for r in ix.read("links").collect()}
    assert target() == {("C", False), ("A", True)}
    old = {r.path: r.id for r in ix.read("documents").collect()}
    second = ix.run(df(a, b, c)).first()
    assert (second.n_documents, second.n_changed, second.n_deleted) == (3, 1, 0) and target() == {("C", True), ("A", True)}  # a.md did not change, its link did
    still = ix.run(df(a, b, c)).first()
    assert (still.v, still.n_changed, still.n_chunks) == (2, 0, 3)
    third = ix.run(df(note("a.md", "# A\n\nnew", 3), c)).first()
    assert (third.n_documents, third.n_chunks, third.n_links, third.n_changed, third.n_deleted) == (2, 2, 0, 1, 1)
    assert {r.content for r in ix.read("chunks").collect()} == {"# A\n\nnew", "# C\n\nlast"} and old["a.md"] in {r.document_id for r in ix.rows().collect()}
    again = ix.run(df(note("a.md", "# A\n\nnew", 3), c), max_characters=4).first()
    assert again.n_changed == 2 and again.n_chunks > 2
    nested = {r.path: r for r in ix.nested().collect()}
    assert [x.ordinal for x in nested["a.md"].chunks] == list(range(len(nested["a.md"].chunks))) and nested["a.md"].links == []
    assert ix.run(df()).first().n_documents == 0


def test_chunks(spark):
    text = "# H\n\n" + " ".join(f"Sentence number {i} stands here." for i in range(180))
    assert all(len(c) <= 160 for c in chunks.split_text(text, 160)) and len(chunks.split_text(text, 160)) > 1
    assert chunks.split_text("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert chunks.split_text("  x  \n\n\n\n y ", 10) == ["x\n\ny"]
    docs = spark.createDataFrame([("d", "---\nt: 1\n---\nhello"), ("e", None), ("f", "  ")], "id string, content string")
    rows = chunks.chunks(docs, embed=True).collect()
    assert [(r.document_id, r.ordinal, r.content, r.token_count, len(r.embedding)) for r in rows] == [("d", 0, "hello", 2, 192)]


def test_notes(spark):
    rows = [
        (1, "Same Title", "one [[Other]]", "Query Smith", "a, #B;c c", "x.md"),
        (2, "same title", "two", "query-smith", None, None),
        (3, None, "three", None, "", "old/some-note_x.md"),
        (4, "  ", " ", None, None, None),
        (5, None, "five", "", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, title string, content string, agent string, tags string, path string")
    got = {r.row_id: r for r in notes.import_legacy(df).collect()}
    assert {k: v.path for k, v in got.items()} == {1: "agents/query-smith/same-title.md", 2: "agents/query-smith/same-title-2.md", 3: "agents/shared/some-note-x.md", 5: "agents/shared/imported-memory-5.md"}
    assert "Tags: #a #b #c" in got[1].content and "Memory Hub" not in got[1].content and "Related: [[Memory Hub]]" in got[2].content
    taken = spark.createDataFrame([("agents/query-smith/same-title.md",)], "path string")
    assert {r.path for r in notes.import_legacy(df, taken).collect() if r.row_id < 3} == {"agents/query-smith/same-title-2.md", "agents/query-smith/same-title-3.md"}
    safe = spark.createDataFrame([("t", "api_key = sk-" + "a" * 24), ("", "ok"), ("x" * 161, "password=" + "b" * 12)], "t string, c string")
    assert [r.p for r in safe.select(notes.problems(F.col("t"), F.col("c")).alias("p")).collect()] == [["secrets: OpenAI API key, secret assignment"], ["empty title"], ["long title", "secrets: secret assignment"]]
    both = spark.createDataFrame([("A [[Old]]", "Old", "b  b"), ("A", "Old", "b  b")], "c string, t string, o string")
    rel = [r[0] for r in both.select(notes.add_related(F.col("c"), F.col("t"))).collect()]
    assert rel == ["A [[Old]]", "A\n\nRelated: [[Old]] priority: low #related-to\n"]
    once = both.select(notes.merged(F.col("c"), F.col("t"), F.col("o")).alias("c"), "t", "o")
    assert once.select("c").collect() == once.select(notes.merged(F.col("c"), F.col("t"), F.col("o")).alias("c")).collect()


def test_snapshots(spark):
    ddl = "path string, mtime int, size int"
    before, now = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], ddl), spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], ddl)
    assert {r.path: r.change for r in snapshots.changes(before, now).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    v = "path string, content string, updated_at int"
    plan = snapshots.migration_plan(spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "x", 1), (None, "x", 1)], v), spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], v))
    assert {r.path: r.kind for r in plan.collect()} == {"a": "unchanged", "b": "conflict", "c": "copy"}
    assert snapshots.needs_rebuild(400, 10**6, 0) and snapshots.needs_rebuild(4, 100, 0) and not snapshots.needs_rebuild(3, 100, 1199)


def test_layout(spark):
    n = [(f"n{i:02}", ("MOC Architecture" if i == 0 else "Retrieval Map" if i == 1 else f"Note {i}"), f"agents/a/g{i % 3}/n{i}.md") for i in range(40)]
    links = [(f"n{i:02}", "t", f"n{i % 2:02}", 2, "normal") for i in range(2, 40)] + [("n02", "t", "n03", 1, "normal")]
    docs = spark.createDataFrame(n, "id string, title string, path string")
    e = spark.createDataFrame(links, "from_document_id string, to_title string, to_document_id string, weight int, priority string")
    edges = graph.edges_between(docs, e)
    nodes = docs.join(graph.degrees(docs, e), "id")
    seg = layout.segments(nodes, edges, graph.components(docs, edges))
    got = {r.id: r.segment for r in seg.collect()}
    assert got["n04"] == "Architecture" and got["n05"] == "Retrieval Map" and len(got) == 40
    placed = layout.place(nodes.join(seg.select("id", "segment"), "id"))
    before = layout.near_pairs(placed, 60.0).count()
    after = layout.relax(placed, 6)
    assert after.where("isnan(x) OR isnan(y)").count() == 0 and after.count() == 40
    assert layout.near_pairs(after, 60.0).count() <= before
    assert layout.primary_hub(nodes).first().id == "n00"
    assert layout.edge_budget(e, 10).count() == 10
    assert [layout.edge_limit(n) for n in (0, 25_000, 25_001, 50_001, 100_001)] == [60_000, 60_000, 30_000, 22_000, 15_000]
    rank = layout.rank_within(spark.range(1000).selectExpr("id", "id % 2 AS g"), ["g"], [F.desc("id")])
    assert {(r.g, r["rank"]) for r in rank.collect()} == {(g, i) for g in (0, 1) for i in range(1, 501)}
    assert spark.range(1).select(layout.text_hash(F.lit("hello world"))).first()[0] == 1794106052


def test_layout_rounds_and_centre(spark, monkeypatch):
    assert [layout.rounds_for(n) for n in (2, 500, 501, 1000, 1001)] == [26, 26, 20, 20, 12]
    rows = [(f"n{i:02}", "Memory Hub" if i == 7 else f"Note {i}", f"n{i}.md", i % 5, 60.0 * (i % 6) + i, 60.0 * (i // 6)) for i in range(30)]
    points = spark.createDataFrame(rows, "id string, title string, path string, degree int, x double, y double")
    apart = layout.relax(points).select("id", "title", "degree", "x", "y").cache()
    got, raw = ({r.id: (r.x, r.y) for r in df.collect()} for df in (layout.centred(apart), apart))
    assert got["n07"] == (0.0, 0.0) and all(abs(raw[i][0] - raw["n07"][0] - got[i][0]) < 1e-9 for i in got)
    assert layout.near_pairs(apart, 120.0).count() < layout.near_pairs(layout.relax(points, 3), 120.0).count()
    plain = apart.where("id <> 'n07'")
    assert sorted(layout.centred(plain).collect()) == sorted(plain.collect())
    from notelake.plans import writing

    asked = []
    monkeypatch.setattr(layout, "relax", lambda p, rounds=None: asked.append(rounds) or p)
    monkeypatch.setattr(layout, "primary_hub", lambda n: n.orderBy("id").limit(1))
    first = writing.q_layout(spark, "/root/testdata/sf0.001").orderBy("id").first()
    assert asked == [None] and (first.x, first.y) == (0.0, 0.0)


def test_legacy_paths_are_unique(spark):
    titles = ["Release 2024", "foo", "foo", "Bar", "bar", "Bar 2", "baz", "baz"]
    rows = spark.createDataFrame([(i, t, "text", "a", None, None) for i, t in enumerate(titles)], "id int, title string, content string, agent string, tags string, path string")
    taken = spark.createDataFrame([(f"agents/a/{x}.md",) for x in ("release-2024", "foo-3", "baz", "baz-2", "baz-4")], "path string")
    got = {r.row_id: r.path.removeprefix("agents/a/").removesuffix(".md") for r in notes.import_legacy(rows, taken).collect()}
    assert got == {0: "release-2024-2", 1: "foo", 2: "foo-2", 3: "bar", 4: "bar-2", 5: "bar-2-2", 6: "baz-3", 7: "baz-5"}


def test_checks_signature_filter_storage(spark):
    docs = spark.createDataFrame([("a", "s", "Backlink map", "a.md", ["x"]), ("b", "s", "B", "backlink/b.md", None), ("c", "s", None, "c.md", [])], "id string, agent_id string, title string, path string, tags array<string>")
    links = spark.createDataFrame([("a", "B", "b", 1, "normal"), ("b", "No", None, 1, "low")], "from_document_id string, to_title string, to_document_id string, weight int, priority string")
    assert {(r["check"], r.ok, r.n) for r in graph.checks(docs, links).collect()} == {("vault", True, 1), ("markdown-files", True, 3), ("index", True, 3), ("broken-links", False, 1)}
    assert [r.ok for r in graph.checks(docs.limit(0), links.limit(0)).orderBy("check").collect()] == [True, False, False, True]
    assert [r.from_title for r in graph.listed_links(docs, links, 5).collect()] == ["B", "Backlink map"] and graph.listed_links(docs, links, 0).count() == 0
    texts = docs.withColumn("content", F.lit("text"))
    assert graph.node(texts, "a", "s").first().title == "Backlink map" and graph.node(texts, "a", "t").count() == 0
    assert {(r.source, r.target) for r in graph.summary_edges(docs, links, "s").collect()} == {("a", "b"), ("b", None)} and graph.summary_nodes(docs, "t").count() == 0
    assert [(r.tag, r.documents) for r in graph.tag_counts(docs).collect()] == [("x", 1)]
    one = graph.signature(docs, links).first().signature
    assert one == graph.signature(docs.orderBy(F.desc("id")), links).first().signature
    assert one != graph.signature(docs, links.limit(1)).first().signature
    assert [(r.id, r.score) for r in graph.filter_nodes(docs, " BÁCKLINK ").collect()] == [("a", 4), ("b", 1)]
    assert graph.filter_nodes(docs, "  ").count() == 0
    notes_ = spark.createDataFrame([("ab", "2025-01-01"), (None, "2025-01-03")], "content string, updated_at string")
    s = graph.storage(notes_).first()
    assert (s.files, s.bytes, s.mean_bytes, s.first_change, s.last_change) == (2, 2, 1, "2025-01-01", "2025-01-03")
    assert graph.storage(notes_.limit(0)).first().bytes == 0
