"""Views of a placed graph, notes that are added, and generated notes."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notelake.operators import documents, layout, notes, views
from notelake.session import cut_lineage, forget
from notelake.sources import generated

NODE = "id string, title string, path string, degree int, x double, y double, rank int, bucket int"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(f"n{i:03}", "Memory Hub" if i == 50 else f"T{i % 40:02}", f"a/f{i % 3}/n{i}.md", i % 7, float(i % 20), float(i // 20), 1, 1) for i in range(200)]
    return spark.createDataFrame([*rows, ("nox", "No place", "a/f0/x.md", 9, None, 1.0, 1, 1)], NODE).cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_cluster_levels(nodes):
    placed = nodes.where("x IS NOT NULL")
    got = {(r["size"], r.bucket): r for r in views.cluster_levels(placed, (100, 30)).collect()}
    assert {k: v.n for k, v in got.items()} == {(100, 0): 100, (100, 1): 100} | {(30, i): 30 for i in range(6)} | {(30, 6): 20}
    assert all(got[100, i].parent is None for i in (0, 1)) and [got[30, i].parent for i in range(7)] == [0, 0, 0, 0, 1, 1, 1]
    assert "n050" in {v.representative for v in got.values()}
    assert views.cluster_levels(placed.limit(0)).count() == 0


def test_samples(nodes):
    order = [r.id for r in nodes.orderBy("title", "id").collect()]
    assert sorted(ids(views.every_nth(nodes, 3))) == sorted(order[::3]) and sorted(ids(views.even_sample(nodes, 50))) == sorted(order[::5])
    assert views.even_sample(nodes, 0).count() == 0 and views.even_sample(nodes.limit(0), 5).count() == 0
    assert [views.stride_for(n, s) for n, s in ((4000, 0.1), (4001, 1.0), (4001, 0.7), (4001, 0.5), (4001, 0.3), (4001, 0.1))] == [1, 1, 2, 3, 5, 8]
    near = ids(views.nearest_sample(nodes, 0, 0, 4))
    assert near == ["n000", "n020", "n001", "n021"]  # of equal distance the higher degree first
    old = nodes.where("id IN ('n199', 'nox')")
    assert ids(views.nearest_sample(nodes, 0, 0, 2, old, by_distance=False)) == ["n199", "n000"]
    assert ids(views.nearest_sample(nodes, 0, 0, 2, old)) == ["n000", "n020"]
    layers = ids(views.layered_sample(nodes, 10, 0.2, 0.3, 0.6, 0.2))
    assert len(set(layers)) == len(layers) == 200 and "nox" not in layers
    assert views.layered_sample(nodes.limit(0), 10, 0.2, 0.3, 0.6, 0.2).count() == 0


def test_extent(nodes):
    r = views.extent(nodes).first()
    assert (r.x0, r.y0, r.x1, r.y1, r.hub, r.nearest) == (0.0, 0.0, 19.0, 9.0, "n050", 1.0)
    none = views.extent(nodes.where("id <> 'n050'")).first()
    assert none.hub is None and none.nearest is None and none.x1 == 19.0
    assert views.extent(nodes.limit(0)).first().x0 is None


def test_edges_and_neighbours(spark):
    e = spark.createDataFrame([("a", "b", 1, False), ("b", "a", 5, False), ("a", "c", 4, False), ("a", "d", 3, True), ("d", "e", 9, False), ("a", "f", 2, False), ("a", "a", 9, False)], "a string, b string, weight int, inferred boolean")
    got = [(r.a, r.b, r.score) for r in views.relevant_edges(e.where("a <> b"), 3, selected="c", hub="b").collect()]
    assert got == [("a", "c", 168), ("a", "b", 100), ("d", "e", 98)]
    assert views.relevant_edges(e, 0).count() == 0
    more = {r.id: r.added for r in views.with_neighbours(spark.createDataFrame([("a",), ("a",)], "id string"), e).collect()}
    assert more == {"a": False, "b": True, "c": True, "d": True} or more == {"a": False, "b": True, "c": True}
    assert [r.weight for r in views.heaviest_edges(e, 5000, 2).collect()] == [9, 9] and views.heaviest_edges(e, 10, 2).count() == 7


def test_added_notes(spark):
    rows = [(1, "One", "see [[Two]]", "A b"), (2, "one", "alone", "a-b"), (3, "Memory Hub", "hub", "c"), (4, "", "no title", "c"), (5, "Z", "z", None), (6, "S", "password = abcdefghijkl1", "c"), (7, "N", None, "c")]
    df = spark.createDataFrame(rows, "id int, title string, content string, agent string")
    there = spark.createDataFrame([("agents/shared/memory-hub.md",)], "path string")
    got = {r.path: r for r in notes.added(df, there).collect()}
    assert {p: (r.auto_linked, r.link_target) for p, r in got.items()} == {
        "agents/a-b/one.md": (True, "Memory Hub"),
        "agents/c/memory-hub.md": (True, "Knowledge Root"),
        "agents/shared/z.md": (True, "Memory Hub"),
        "agents/a-b/memory-hub.md": (False, None),
        "agents/c/knowledge-root.md": (False, None),
    }
    assert "Related: [[Memory Hub]]" in got["agents/a-b/one.md"].content and "Central memory index" in got["agents/a-b/memory-hub.md"].content
    assert notes.added(df.limit(0), there).count() == 0


def test_generated_notes(spark):
    made = generated.linked_notes(spark, 30)
    docs = documents.documents(made.withColumns({"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")}))
    links = documents.links(docs)
    assert docs.count() == 30 and links.count() == 29 + 22 and links.where("to_document_id IS NULL").count() == 0
    assert math.isclose(docs.where("array_contains(tags, 'benchmark')").count(), 30) and generated.linked_notes(spark, 0).count() == 0


def test_mesh_follows_the_points_not_the_pairs(spark, monkeypatch):
    def all_pairs(*_):
        raise AssertionError("the mesh lists every pair within the distance")

    monkeypatch.setattr(layout, "near_pairs", all_pairs)
    rnd = random.Random(5)
    at = {f"d{i:03}": (rnd.uniform(0, 3), rnd.uniform(0, 3)) for i in range(400)}  # crowded
    at |= {f"s{i:03}": (rnd.uniform(-900, 900), rnd.uniform(-900, 900)) for i in range(150)} | {"far": (9000.0, 0.0)}
    at |= {f"e{i:03}": (50.0, -50.0) for i in range(80)} | {"e1": (50.0, -50.5)}  # at one place
    ids_ = sorted(at)
    links = {tuple(sorted(rnd.sample(ids_, 2))) for _ in range(1500)} | {("e000", f"e{i:03}") for i in range(1, 60)} | {(f"e{i:03}", "e1") for i in range(40)}
    want = set()
    for a in ids_:
        near = ((round(math.hypot(at[b][0] - at[a][0], at[b][1] - at[a][1]), 9), min(a, b), max(a, b)) for b in ids_ if b != a and (min(a, b), max(a, b)) not in links)
        want |= {x[1:] for x in sorted(x for x in near if x[0] < 90)[:3]}
    points = spark.createDataFrame([*((k, *v) for k, v in at.items()), ("nox", None, 1.0)], "id string, x double, y double")
    edges = spark.createDataFrame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(sorted(links))] + [("d000", "gone")], "a string, b string")
    got = [(r.a, r.b) for r in layout.mesh_edges(points, edges, 90.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert layout.mesh_edges(points.limit(0), edges, 90.0).count() == 0


def test_what_was_written_can_be_forgotten(spark):
    kept, gone = (cut_lineage(spark.range(5), "t") for _ in range(2))
    folder = Path(gone.inputFiles()[0].removeprefix("file:")).parent
    forget(gone)
    assert not folder.exists() and kept.count() == 5
    forget(spark.range(1))
