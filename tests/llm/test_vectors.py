"""Nearest vectors against brute force."""

import numpy as np
import pytest

from notelake.llm import knn

DDL = "key string, v array<double>, near string, neg double"


def truth(rows, k):
    x = {}
    for key, v, *_ in rows:
        if key is not None and v is not None and len(v) == 24 and np.isfinite(v).all() and np.any(v):
            x.setdefault(key, np.asarray(v) / np.linalg.norm(v))
    keys = sorted(x)
    m = np.array([x[q] for q in keys])
    out = {}
    for i, q in enumerate(keys):
        s = np.round(m @ m[i], 9)
        order = [j for j in np.lexsort((np.arange(len(keys)), -s)) if j != i][:k]
        out[q] = [keys[j] for j in order]
    return out


def rows_of(n, seed=0, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, 24))
    x = c[rng.integers(centres, size=n)] + 0.4 * rng.standard_normal((n, 24))
    return [(f"k{i:05}", [float(y) for y in x[i] * (1 + i % 3)], "a", 1.0) for i in range(n)]


def near(df, **kw):
    return {r.key: [n.key for n in r.near] for r in knn.neighbours(df, "key", "v", 24, **kw).collect()}


def test_one_list_is_exact_with_gaps_ties_and_repeats(spark):
    rows = rows_of(120)
    rows += [("k00003b", rows[3][1], "a", 1.0), ("k00003a", [2 * y for y in rows[3][1]], "a", 1.0), *rows[:10]]
    rows += [(None, rows[0][1], "", 0.0), ("nul", None, "", 0.0), ("short", [1.0], "", 0.0), ("zero", [0.0] * 24, "", 0.0), ("nan", [float("nan")] * 24, "", 0.0), ("inf", [float("inf")] + [1.0] * 23, "", 0.0)]
    assert near(spark.createDataFrame(rows, DDL)) == truth(rows, 10)


def test_many_lists_reach_nine_tenths(spark):
    rows = rows_of(3000, 1, 40)
    got, want = near(spark.createDataFrame(rows, DDL), per_list=150), truth(rows, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[k]) & set(want[k])) / 10 for k in want]) >= 0.9


def copies(rows, kind, n):
    """n rows that are copies of a vector in one way or another, under keys before, among and after the others."""
    rng = np.random.default_rng(5)
    base = np.asarray(rows[0][1])
    vec = {
        "equal": lambda i: base,
        "scaled": lambda i: base * (1 + i % 7) / 3,
        "near": lambda i: base * (1 + 1e-12 * rng.standard_normal(24)),
    }[kind]
    return [(f"{'ahz'[i % 3]}{i:05}", [float(x) for x in vec(i)], "a", 1.0) for i in range(n)]


@pytest.mark.parametrize("hot", [1, 1000])
@pytest.mark.parametrize("kind", ["equal", "scaled", "near"])
def test_many_copies_are_exact(spark, monkeypatch, kind, hot):
    monkeypatch.setattr(knn, "HOT_LISTS", hot / 1000)
    rows = rows_of(150, 2)
    rows += copies(rows, kind, 1100)
    assert near(spark.createDataFrame(rows, DDL), per_list=4096, epsilon=1e3) == truth(rows, 10)  # one list, nothing abandoned early: exact


def test_many_unusable_copies_take_no_part(spark):
    rows = rows_of(150, 2)
    bad = ([0.0] * 24, [-0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23)
    rows += [(f"bad{j}{i:04}", v, "a", 1.0) for j, v in enumerate(bad) for i in range(1100)]
    assert near(spark.createDataFrame(rows, DDL), epsilon=1e3) == truth(rows[:150], 10)


def test_keys_with_several_vectors_count_once(spark):
    rows = rows_of(60, 3)
    df = spark.createDataFrame(rows + [(r[0], [-x for x in r[1]], "b", 2.0) for r in rows[:30]] * 2, DDL)
    one, two = near(df), near(df.orderBy("neg", "key"))
    assert one == two and len(one) == 60 and all(len(set(v)) == 10 and key not in v for key, v in one.items())


def test_lists_are_divided_and_cut_into_blocks(spark, monkeypatch):
    rows = rows_of(3000, 1, 40)
    want = truth(rows, 10)
    monkeypatch.setattr(knn, "MAX_CENTROIDS", 5)
    model = knn.fit(np.asarray([r[1] for r in rows], dtype=np.float32) / 9, 20, 3000, 60)
    assert len(model.subs) == 4 and model.n_lists == 4 * len(model.fine) and model.blocks.max() > 1
    df = spark.createDataFrame(rows, DDL)
    recall = lambda got: np.mean([len(set(got[k]) & set(want[k])) / 10 for k in want])
    whole = near(df, per_list=150)
    assert whole.keys() == want.keys() and recall(whole) >= 0.9
    monkeypatch.setattr(knn, "LONG", 0.2)
    assert near(df, per_list=150) == whole


def test_short_results_are_searched_for_again(spark, monkeypatch):
    monkeypatch.setattr(knn, "MAX_PROBES", 1)
    rows = rows_of(120, 1, 30)  # about four vectors in a list
    got = near(spark.createDataFrame(rows, DDL), per_list=4)
    assert len(got) == 120 and all(len(v) == 10 for v in got.values())


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    rows = rows_of(n)
    assert near(spark.createDataFrame(rows, DDL)) == truth(rows, 10)


def test_scan_abandons_without_loss():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((900, 192)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    q, b, s = knn.scan(base[:200], base, np.arange(200), 10)
    sims = base[:200].astype(float) @ base.T.astype(float)
    sims[np.arange(200), np.arange(200)] = -9
    want = {(i, j) for i in range(200) for j in np.argsort(-sims[i])[:10]}
    assert len(want & set(zip(q.tolist(), b.tolist(), strict=True))) / len(want) >= 0.98
    assert np.allclose(s, sims[q, b], atol=1e-6)
