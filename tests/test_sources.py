import gzip
import json
import sqlite3
import time

import pytest

from notelake.operators import documents
from notelake.sources import markdown, packs
from notelake.streaming import watch


@pytest.fixture()
def vault(tmp_path):
    for name, text in {"a.md": "# A\n[[B]]", "sub dir/B.MD": "# B é", "node_modules/no.md": "x", "pic.png": "x", ".git/h.md": "x"}.items():
        p = tmp_path / "vault" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "vault"


def test_scan_and_parse(spark, vault):
    notes = markdown.read_notes(spark, str(vault))
    assert {(r.path, r.content) for r in notes.collect()} == {("a.md", "# A\n[[B]]"), ("sub dir/B.MD", "# B é")}
    docs = documents.documents(notes)
    assert {r.title for r in docs.collect()} == {"A", "B é"}
    assert {r.path for r in markdown.list_files(spark, str(vault)).collect()} == {"a.md", "sub dir/B.MD", "pic.png"}


def test_write_and_refuse(spark, tmp_path):
    df = spark.createDataFrame([("agents/x/n.md", "hi"), ("m.md", None)], "path string, content string")
    assert {(r.path, r.bytes) for r in markdown.write_notes(df, str(tmp_path / "v")).collect()} == {("agents/x/n.md", 2), ("m.md", 0)}
    assert (tmp_path / "v/agents/x/n.md").read_text() == "hi"
    with pytest.raises(Exception, match="outside"):
        markdown.write_notes(spark.createDataFrame([("../n.md", "x")], "path string, content string"), str(tmp_path / "v")).collect()


def test_addresses(tmp_path):
    assert markdown.parse_bucket("s3://memory-vault/team/notes/") == ("memory-vault", "team/notes")
    assert markdown.is_allowed("s3://b/team/x", ["s3://b/team"]) and not markdown.is_allowed("s3://b/teams", ["s3://b/team"])
    assert markdown.is_allowed(str(tmp_path / "x"), [str(tmp_path)]) and not markdown.is_allowed("/other", [str(tmp_path)])
    assert markdown.is_allowed("/other", []) and markdown.is_allowed("/other", ["s3://b"])


def test_legacy_database(spark, tmp_path):
    path = str(tmp_path / "old.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE memo (title TEXT, body TEXT, namespace TEXT)")
    con.execute("CREATE TABLE noise (name TEXT)")
    con.executemany("INSERT INTO memo VALUES (?, ?, ?)", [(f"t{i}", f"b{i}", None) for i in range(100)])
    con.commit()
    con.close()
    got = markdown.read_legacy(spark, path).collect()
    assert {(r.title, r.content, r.agent) for r in got} == {(f"t{i}", f"b{i}", None) for i in range(100)} and len(got) == 100


def test_packs(spark, tmp_path):
    rows = [(f"d{i}", "a" if i % 3 else "b", f"T{i}", f"p{i}", f"c{i}", 0, "alpha word" if i < 90 else "Beta wörd", ["x"]) for i in range(100)]
    df = spark.createDataFrame(rows + rows[:5], "document_id string, agent_id string, title string, path string, chunk_id string, chunk_ordinal int, content string, tags array<string>")
    numbered = packs.numbered(df, 30)
    report = packs.report(numbered).orderBy("pack").collect()
    assert [r.n for r in report] == [30, 30, 30, 10] and sum(r.bytes for r in report) == 90 * 10 + 10 * 10
    packs.write(df.distinct(), str(tmp_path / "packs"))
    assert packs.read(spark, str(tmp_path / "packs")).where("agent_id = 'b'").count() == 34
    with gzip.open(tmp_path / "old.jsonl.gz", "wt") as f:
        f.write(json.dumps({"document_id": "d", "agent_id": "a", "chunk_id": "c", "content": "x"}) + "\n{\"odd\": 1}\nnot json\n")
    assert packs.read_lines(spark, str(tmp_path / "old.jsonl.gz")).count() == 1
    packs.upgrade(spark, str(tmp_path / "old.jsonl.gz"), str(tmp_path / "new"))
    assert [(r.chunk_id, r.agent_id) for r in packs.read(spark, str(tmp_path / "new")).collect()] == [("c", "a")]
    c = packs.compression(spark, str(tmp_path / "packs")).first()
    assert c.in_bytes > 1000 and c.out_bytes > 0 and c.ratio == round(c.out_bytes / c.in_bytes, 4)


def test_watch(spark, vault):
    seen = []
    query = watch.follow(spark, str(vault), lambda df, n: seen.append({(r.path, r.change) for r in df.collect()}), every="1 second")
    try:
        for _ in range(60):
            if seen:
                break
            time.sleep(1)
        (vault / "a.md").write_text("# A changed")
        (vault / "new.md").write_text("x")
        (vault / "sub dir/B.MD").unlink()
        for _ in range(60):
            if ("sub dir/B.MD", "deleted") in set().union(*seen[1:]):
                break
            time.sleep(1)
    finally:
        query.stop()
    assert seen[0] == {("a.md", "new"), ("sub dir/B.MD", "new")}
    assert {("a.md", "changed"), ("new.md", "new"), ("sub dir/B.MD", "deleted")} <= set().union(*seen[1:])


def test_late_counts(spark):
    df = spark.createDataFrame([(1, "2025-01-05 00:00:00"), (1, "2025-01-05 00:00:00"), (2, "2025-03-01 00:00:00")], "link_id long, t string").selectExpr("link_id", "timestamp(t) AS indexed_at")
    assert sorted(r.links for r in watch.late_reference_counts(df).collect()) == [1, 1]
