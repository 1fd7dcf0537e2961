"""Near duplicates and pairs of items against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from notelake.llm import near_dup
from notelake.llm.pairs import PairTable, baskets

ROW = "chunk_id string, title string, content string, class_id string, band int"


def brute(rows, at_least):
    w = {}
    for k, t, c, *_ in rows:
        if k is not None and c is not None and c.strip():
            words = frozenset(re.findall(r"[\w\-]+", ((t or "") + " " + c).lower()))
            if words:
                w[k] = words
    return {(a, b) for a, b in combinations(sorted(w), 2) if len(w[a] & w[b]) >= at_least * len(w[a] | w[b])}


def test_similar_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for d in range(40):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(80)]
        for e in range(4):
            text = [x if rnd.random() > 0.04 * e else f"v{rnd.randint(0, 9999)}" for x in base]
            rnd.shuffle(text)
            rows.append((f"c{d:02}{e}", rnd.choice([None, "Title"]), " ".join(text), "x", 1))
    rows += [("copy1", None, "same words here", "x", 1), ("copy2", None, "Same, words HERE!", "x", 1), *rows[:5]]
    rows += [("n1", "only title", None, "", 0), ("n2", None, "  ", "", 0), ("n3", None, "!!!", "", 0), (None, None, "same words here", "", 0)]
    got = {tuple(r) for r in near_dup.similar_pairs(spark.createDataFrame(rows, ROW), "chunk_id", "title", "content").collect()}
    want = brute(rows, 0.7)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100
    assert near_dup.similar_pairs(spark.createDataFrame([], ROW), "chunk_id", "title", "content").count() == 0


def test_weighted_bands(spark):
    ddl = "n string, e array<bigint>, w array<double>, bucket int"
    heavy, light = [50.0] + [1.0] * 20, [1.0] * 21
    rows = [("a", list(range(21)), heavy, 0), ("b", [0, *range(100, 120)], heavy, 0), ("c", list(range(200, 221)), light, 0), ("d", [200, *range(300, 320)], light, 0)]
    rows += [("x", [1], [None], 0), ("y", [1], [-1.0], 0), ("z", [], [], 0), ("u", [1, 2], [1.0], 0), ("v", None, None, 0)]
    got = near_dup.banded(spark.createDataFrame(rows, ddl), "n", "e", "w").collect()
    by = {n: {r.bucket for r in got if r.n == n} for n in "abcdxyzuv"}
    # weighted similarity of a and b: 50 / 90, of c and d: 1 / 41
    assert len(by["a"] & by["b"]) > 0 and not by["c"] & by["d"] and all(len(by[n]) == 96 for n in "abcd") and not any(by[n] for n in "xyzuv")


def test_large_classes_keep_their_links(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(f"a{i:02}", None, words, "", 0) for i in range(20)] + [("b", None, words + " more", "", 0)]
    df = spark.createDataFrame(rows, ROW)
    got = {tuple(r) for r in near_dup.similar_pairs(df, "chunk_id", "title", "content", all_pairs_up_to=5).collect()}
    assert got == {("a00", f"a{i:02}") for i in range(1, 20)} | {("a00", "b")}
    groups = {r.chunk_id: (r.group_id, r.group_size) for r in near_dup.groups(df, "chunk_id", "title", "content").collect()}
    assert set(groups.values()) == {("a00", 21)} and len(groups) == 21


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    k = 4096
    ids = rng.integers(0, 2**63, 60, dtype=np.uint64)
    w = rng.choice([0.5, 1.0, 3.0], 60)
    a, b = slice(0, 45), slice(15, 60)
    wb = w.copy()
    wb[20] = 2.5
    sig = near_dup.signatures(np.concatenate([ids[a], ids[b]]), np.concatenate([w[a], wb[b]]), np.array([0, 45, 90]), k)
    low, high = np.zeros(60), np.zeros(60)
    wa_, wb_ = np.zeros(60), np.zeros(60)
    wa_[a], wb_[b] = w[a], wb[b]
    low, high = np.minimum(wa_, wb_), np.maximum(wa_, wb_)
    assert abs((sig[0] == sig[1]).mean() - low.sum() / high.sum()) < 0.04
    tiny = near_dup.signatures(ids[:1], np.ones(1), np.array([0, 1]), 64)
    assert (tiny != np.iinfo(np.uint64).max).all()


def counts(rows):
    sets = {}
    for d, tags, *_ in rows:
        if d is not None:
            sets.setdefault(d, set()).update(x for x in ((t or "").strip().lstrip("#").strip().lower() for t in tags or []) if x)
    return Counter(p for s in sets.values() for p in combinations(sorted(s), 2)), Counter(t for s in sets.values() for t in s), sum(1 for s in sets.values() if s)


def table(t):
    return Counter({(r.item_a, r.item_b): r.n for r in t.pair_counts().collect()}), Counter({r["item"]: r.n for r in t.item_counts().collect()}), t.n_baskets()


TAGGED = "doc string, tags array<string>, basket string, n int"


def test_pair_table_follows_changes(spark):
    rnd = random.Random(4)
    pick = lambda: [rnd.choice(["#A", " b", "c ", "D", None, "", "#", "e", "é"]) for _ in range(rnd.randint(0, 5))]
    first = [(f"d{i % 40}", rnd.choice([pick(), None]), "x", 1) for i in range(90)] + [(None, ["a", "b"], "x", 1)]
    t = PairTable.new(spark, n_buckets=4)
    t.apply(baskets(spark.createDataFrame(first, TAGGED), "doc", "tags"))
    assert table(t) == counts(first)
    second = [(f"d{i}", pick(), "x", 1) for i in range(30, 50)]
    t.apply(baskets(spark.createDataFrame(second, TAGGED), "doc", "tags"))
    changed = {r[0] for r in second}
    now = [r for r in first if r[0] not in changed] + second
    assert table(t) == counts(now)
    t.apply(baskets(spark.createDataFrame(second, TAGGED), "doc", "tags"))
    assert table(t) == counts(now)
    again = PairTable.open(spark, t.path)
    assert table(again) == counts(now) and again.state == t.state
    pairs, items, n = counts(now)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in again.scores().collect()}
    assert got == {(a, b): (c, items[a], items[b], n) for (a, b), c in pairs.items()}
    row = t.scores().orderBy("item_a", "item_b").first()
    assert abs(row.lift - row.n_ab * row.n / (row.n_a * row.n_b)) < 1e-12


def test_deleted_baskets_stay_deleted(spark):
    t = PairTable.new(spark, n_buckets=1)
    one = lambda *tags: baskets(spark.createDataFrame([("d1", list(tags), "x", 1)], TAGGED), "doc", "tags")
    t.apply(one("x", "y"))
    before = t.pair_counts()
    for _ in range(2):
        t.apply(one())
        assert t.stored_baskets().count() == 0 and table(t) == (Counter(), Counter(), 0)
    assert before.count() == 1  # an older version stays readable
    t.apply(one("x", "y"))
    assert table(t) == (Counter({("x", "y"): 1}), Counter({"x": 1, "y": 1}), 1)


def test_untouched_buckets_and_scores_stay(spark):
    rows = [(f"d{i:02}", [f"t{i:02}", f"u{i:02}"], "x", 1) for i in range(30)]
    t = PairTable.new(spark, n_buckets=16)
    t.apply(baskets(spark.createDataFrame(rows, TAGGED), "doc", "tags"))
    t.apply(baskets(spark.createDataFrame([("d03", ["t03"], "x", 1)], TAGGED), "doc", "tags"))
    assert [sum(v == 2 for v in t.state.buckets[name].values()) <= 1 for name in ("baskets", "items", "pairs")] == [True] * 3
    assert table(t) == counts([r for r in rows if r[0] != "d03"] + [("d03", ["t03"], "x", 1)])


def test_buckets_follow_the_baskets(spark):
    rows = [(f"d{i}", [f"t{i % 7}", f"u{i % 5}"], "x", 1) for i in range(60)]
    t = PairTable.new(spark, per_bucket=10, n_buckets=1)
    t.apply(baskets(spark.createDataFrame(rows[:10], TAGGED), "doc", "tags"))
    assert t.state.n_buckets == 1
    t.apply(baskets(spark.createDataFrame(rows[10:], TAGGED), "doc", "tags"))
    assert t.state.n_buckets == 6 and table(t) == counts(rows)
    fresh = PairTable.new(spark, per_bucket=10, n_buckets=1)
    fresh.apply(baskets(spark.createDataFrame(rows, TAGGED), "doc", "tags"))
    assert fresh.state.n_buckets == 6 and table(fresh) == counts(rows)


def test_pair_table_of_nothing(spark):
    t = PairTable.new(spark)
    t.apply(baskets(spark.createDataFrame([], TAGGED), "doc", "tags"))
    assert t.scores().count() == 0 and t.n_baskets() == 0 and PairTable.open(spark, t.path).scores().count() == 0
