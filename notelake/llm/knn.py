"""Most similar vectors for every vector (problem 3).

Method: an inverted file whose lists are searched by adaptive dimension scan. A bounded sample fits the centroids of the
lists; every vector is rotated once, goes to its nearest list and is searched for there and in the neighbouring lists
that are about as near. Inside a list the vectors lie in column blocks: partial distances over the first columns are
computed for all candidates, and a hypothesis test on the partial distance - after a random rotation d of D columns
hold about d/D of the squared distance - abandons candidates that can hardly reach the k nearest. The few that stay
get all columns and the exact similarity in double precision.

Scale: the number of lists follows the number of rows, so a list holds about ``per_list`` vectors at every size. The model
stays bounded all the same: up to ``MAX_CENTROIDS`` centroids are fitted, and where more lists are wanted each is divided
by one shared set of centroids of the residuals. A list that the sample shows too long is cut into blocks of candidates,
which its queries visit one by one, so no list is one task. What moves: keys with a hash of their vector (one narrow table,
which also holds the sample), the 32-bit vectors of the lists and their visitors, and the k best per list and query.

Copies: vectors equal after normalization are one class. Inside a list a class is searched for once and offers its k + 1
smallest keys, which is all that any neighbour list can hold of it. A class with more rows than ``HOT_LISTS`` lists and
one in ``HOT_SHARE`` of the table sends only those keys to the lists at all (so there are at most HOT_SHARE such classes);
its other members get the result of the smallest key. Both are exact, and nothing depends on where the line is.
A vector whose lists hold fewer than k others is searched for again in more lists, up to all.

Defined results: rows without a key or with a vector that is null, of another length, not finite or all zero take no part;
repeated keys count once (of rows that differ always the same one); similarity is the cosine rounded to 9 decimals, and of
equal ones the smaller key goes first; fewer than k + 1 vectors give all others; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

#: Bounds of the fit, independent of the data: centroids, and sampled vectors in all (on average) and per list.
MAX_CENTROIDS, MAX_SAMPLE, SAMPLE_PER_LIST = 8192, 131_072, 256
#: A list is also probed if its squared distance is at most so many times that of the nearest one.
PROBE_WITHIN, MAX_PROBES = 1.3, 5
#: Significance of the test: a partial distance may exceed its expectation by 1 + EPSILON / sqrt(columns seen).
EPSILON = 2.1
#: Ends of the column blocks as shares of the width.
BLOCKS = (1 / 6, 1 / 3, 1 / 2, 2 / 3, 1.0)
#: Below this share of candidates left, they are followed one by one.
FEW = 0.04
#: A list of more than so many times per_list vectors is cut into blocks of that many.
LONG = 8
HOT_LISTS, HOT_SHARE = 4, 100_000


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of x, normalized, and which they are."""
    with np.errstate(all="ignore"):
        largest = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
        ok = np.isfinite(x).all(axis=1) & (largest > 0)
        x = x[ok] / largest[ok, None]
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), ok


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-6, total / np.maximum(norm, 1e-6)[:, None], c)
    return c, (x @ c.T).argmax(axis=1)


@dataclass
class Model:
    """The lists: unit vectors in two levels, residual centroids that divide each list, blocks of each list and their numbers."""

    coarse: np.ndarray
    fine: np.ndarray
    parent: np.ndarray
    subs: np.ndarray
    blocks: np.ndarray
    offset: np.ndarray

    @property
    def n_lists(self) -> int:
        return len(self.fine) * len(self.subs)


def _residual_centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    k = max(1, min(k, len(x)))
    if k == 1:
        return np.zeros((1, x.shape[1]), dtype=np.float32)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(axis=1) - 2 * x[i : i + 8192] @ c.T).argmin(axis=1) for i in range(0, len(x), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c.astype(np.float32)


def fit(sample: np.ndarray, n_lists: int, n_rows: int = 0, longest: int = 1 << 40) -> Model:
    """The lists fitted to a sample of n_rows vectors; those of more than ``longest`` by the sample are cut into blocks."""
    rng = np.random.default_rng(11)
    width = sample.shape[1]
    if len(sample) == 0:
        one = np.eye(1, width, dtype=np.float32)
        return Model(one, one, np.zeros(1, dtype=np.int64), 0 * one, np.ones(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    n_sample = len(sample)
    sample = np.unique(sample.view(np.dtype((np.void, 4 * width))).ravel()).view(np.float32).reshape(-1, width)  # copies need one list
    n_fine = min(n_lists, MAX_CENTROIDS)
    coarse, near = _kmeans(sample, int(np.ceil(np.sqrt(n_fine))), rng)
    fair = len(sample) / n_fine
    fine, parent = [], []
    for c in range(len(coarse)):
        todo = [(sample[near == c], None)]
        todo[0] = (todo[0][0], max(1, round(len(todo[0][0]) / fair)))
        while todo:
            x, k = todo.pop()
            if len(x) == 0:
                continue
            centres, own = _kmeans(x, k, rng)
            for i in range(len(centres)):
                mine = x[own == i]
                if len(mine) > 3 * fair + 8 and len(mine) < len(x):
                    todo.append((mine, max(2, round(len(mine) / fair))))
                elif len(mine):
                    fine.append(centres[i])
                    parent.append(c)
    model = Model(coarse, np.asarray(fine, dtype=np.float32), np.asarray(parent), np.zeros((1, width), dtype=np.float32), np.ones(len(fine), dtype=np.int64), np.arange(len(fine)))
    if n_lists > n_fine:
        row, cell, home, _ = assign(sample, model, 1)
        model.subs = _residual_centres(sample[row] - model.fine[cell], -(-n_lists // n_fine), rng)
    _, cell, home, _ = assign(sample, model, 1)
    rows = np.bincount(cell[home], minlength=model.n_lists) * (n_rows / n_sample)
    model.blocks = np.maximum(1, np.ceil(rows / longest)).astype(np.int64)
    model.offset = np.cumsum(model.blocks) - model.blocks
    return model


def assign(x: np.ndarray, model: Model, probes: int = MAX_PROBES, within: float = PROBE_WITHIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, is it the row's own list?, squared distance) of the lists that each row of x lives in or visits."""
    coarse, fine, parent, m = model.coarse, model.fine, model.parent, len(model.subs)
    wide = max(MAX_PROBES, probes)
    step = max(1, 8_000_000 // (wide * m))
    if len(x) > step:  # bounds the memory
        parts = [assign(x[i : i + step], model, probes, within) for i in range(0, len(x), step)]
        row = np.concatenate([p[0] + i * step for i, p in enumerate(parts)])
        return row, *(np.concatenate([p[j] for p in parts]) for j in (1, 2, 3))
    sims = x @ coarse.T
    top = np.argsort(-sims, axis=1)[:, : min(max(3, probes), len(coarse))]
    best = np.full((len(x), wide), -2.0, dtype=np.float32)
    which = np.full((len(x), wide), -1, dtype=np.int64)
    for c in np.unique(top):
        cells = np.flatnonzero(parent == c)
        rows = np.flatnonzero((top == c).any(axis=1))
        if not len(cells):
            continue
        s = x[rows] @ fine[cells].T
        few = np.argsort(-s, axis=1)[:, :wide]
        s2 = np.concatenate([best[rows], np.take_along_axis(s, few, 1)], axis=1)
        w2 = np.concatenate([which[rows], cells[few]], axis=1)
        order = np.argsort(-s2, axis=1, kind="stable")[:, :wide]
        best[rows], which[rows] = np.take_along_axis(s2, order, 1), np.take_along_axis(w2, order, 1)
    far = np.where(which >= 0, np.maximum(2 - 2 * best, 0), np.inf)
    if m > 1:  # the divisions of those lists, by the distance of the residuals
        rest = np.einsum("ij,kj->ik", x, model.subs)[:, None, :] - np.einsum("ij,kj->ik", fine, model.subs)[which]
        divided = np.maximum(far[:, :, None] - 2 * rest + (model.subs**2).sum(axis=1), 0).reshape(len(x), -1)
        order = np.argsort(divided, axis=1, kind="stable")[:, :wide]
        far = np.take_along_axis(divided, order, 1)
        which = np.where(np.isfinite(far), (which[:, :, None] * m + np.arange(m)).reshape(len(x), -1)[np.arange(len(x))[:, None], order], -1)
    use = (which >= 0) & (far <= (within * np.maximum(far[:, :1], 1e-9) + 1e-9)) & (np.arange(wide) < probes)
    row, col = np.nonzero(use)
    return row, which[row, col], col == 0, far[row, col]


def scan(q: np.ndarray, base: np.ndarray, own: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base row, similarity) of the k nearest rows of base to each query; own: the query's row in base or -1."""
    width = q.shape[1]
    ends = sorted({max(1, round(width * b)) for b in BLOCKS})
    part = np.zeros((len(q), len(base)), dtype=np.float32)
    mine = np.flatnonzero(own >= 0)
    bound, few, d = np.full(len(q), np.inf), None, 0
    for end in ends:
        if few is None:  # all candidates by columns, as long as many are left
            a, b = q[:, d:end], base[:, d:end]
            part += np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
            if d == 0:
                part[mine, own[mine]] = np.inf
            if end < width and len(base) - 1 > 2 * k:  # a bound on the k-th distance, from the nearest so far
                seed = np.argpartition(part, k, axis=1)[:, :k]
                diff = q[:, None, :] - base[seed]
                bound = np.minimum(bound, np.einsum("ijk,ijk->ij", diff, diff).max(axis=1) + 1e-5)
        else:  # the candidates left, one by one
            qi, bi = few
            diff = q[qi, d:end] - base[bi, d:end]
            dist += np.einsum("ij,ij->i", diff, diff)
        d = end
        slack = (1 + epsilon / np.sqrt(d)) ** 2 if d < width else 1.0
        limit = (bound * slack * d / width + 1e-5).astype(np.float32)
        if few is not None:
            keep = dist <= limit[qi]
            few, dist = (qi[keep], bi[keep]), dist[keep]
        else:
            stay = part <= limit[:, None]
            stay &= np.isfinite(part)
            if d == width or np.count_nonzero(stay) < FEW * stay.size:
                few = np.nonzero(stay)
                dist = part[few]
    qi, bi = few
    order = np.lexsort((dist, qi))  # the k nearest in single precision, and all that may equal the last of them
    qi, bi, dist = qi[order], bi[order], dist[order]
    first = np.searchsorted(qi, np.arange(len(q) + 1))
    last = np.minimum(first[:-1] + k, first[1:]) - 1
    keep = dist <= dist[np.maximum(last, 0)][qi] + 2e-5 if len(dist) else np.zeros(0, dtype=bool)
    qi, bi = qi[keep], bi[keep]
    q_size, base_size = (np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)) for v in (q, base))
    sim = np.empty(len(qi))
    for i in range(0, len(qi), 65_536):
        a, b = qi[i : i + 65_536], bi[i : i + 65_536]
        sim[i : i + 65_536] = np.einsum("ij,ij->i", q[a].astype(np.float64), base[b].astype(np.float64)) / (q_size[a] * base_size[b])
    sim = np.round(sim, 9)
    order = np.lexsort((bi, -sim, qi))
    qi, bi, sim = qi[order], bi[order], sim[order]
    first = np.searchsorted(qi, np.arange(len(q)))
    rank = np.arange(len(qi)) - first[qi]
    return qi[rank < k], bi[rank < k], sim[rank < k]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _within(group: np.ndarray) -> np.ndarray:
    """The place of each row among the earlier rows of its group."""
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], group[order])
    out = np.empty(len(group), dtype=np.int64)
    out[order] = np.arange(len(group)) - first
    return out


def _search_list(width: int, k: int, epsilon: float):
    def run(group: pa.Table) -> pa.Table:
        keys = np.asarray(group.column("key").to_pylist(), dtype=object)
        flags = group.column("role").to_numpy(zero_copy_only=False)
        vec = np.frombuffer(b"".join(group.column("vec").combine_chunks().to_pylist()), dtype=np.float32).reshape(-1, width)
        order = np.lexsort((-flags, keys)) if len(keys) else np.zeros(0, dtype=np.int64)
        order = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])] if len(order) else order  # each key once
        keys, flags, vec = keys[order], flags[order], vec[order]
        _, first, copy = np.unique(vec.view(np.dtype((np.void, 4 * width))).ravel(), return_index=True, return_inverse=True) if len(vec) else (None, order, order)
        base = np.flatnonzero(flags & 1)
        base = base[_within(copy[base]) <= k]  # of copies the k + 1 smallest keys are all that can come out
        ask = np.flatnonzero(flags & 2)
        asked, of = np.unique(copy[ask], return_inverse=True)  # copies are searched for once
        qs, bs, sims = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        step = max(32, min(512, 4_000_000 // max(1, len(base))))
        for s in range(0, len(asked) if len(base) else 0, step):
            some = vec[first[asked[s : s + step]]]
            q, b, sim = scan(some, vec[base], np.full(len(some), -1), k + 1, epsilon)
            qs.append(q + s)
            bs.append(b)
            sims.append(sim)
        q, b, sim = np.concatenate(qs), base[np.concatenate(bs)], np.concatenate(sims)
        start = np.searchsorted(q, np.arange(len(asked) + 1))
        n = np.diff(start)[of]
        row = np.repeat(np.arange(len(ask)), n)
        at = start[of][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        other = b[at] != ask[row]  # not itself
        row, at = row[other], at[other]
        few = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, at = row[few], at[few]
        ends = np.searchsorted(row, np.arange(len(ask) + 1)).astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(-sim[at]), pa.array(keys[b[at]], pa.string())], names=["neg", "key"])
        return pa.table([pa.array(keys[ask], pa.string()), pa.ListArray.from_arrays(pa.array(ends), near)], names=["key", "near"])

    return run


NEAR = "key string, near array<struct<neg: double, key: string>>"


def _hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 32-bit numbers."""
    return np.fromiter((xxhash.xxh3_64_intdigest(r) for r in np.ascontiguousarray(x)), dtype=np.uint64, count=len(x)).view(np.int64)


def neighbours(df: DataFrame, key: str, vector: str, width: int, k: int = 10, per_list: int = 1024, epsilon: float = EPSILON) -> DataFrame:
    """key, near: the k most similar others of each usable vector, array<struct<neg, key>> with neg = -similarity.

    A larger epsilon abandons fewer candidates.
    """
    spark = df.sparkSession
    usable = F.forall(vector, lambda x: F.abs(x) < float("inf")) & F.exists(vector, lambda x: x != 0)  # NaN sorts above infinity
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == width) & usable).select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vec"))
    n_rows = df.count()  # from the files' metadata
    share = min(-(-n_rows // per_list) * SAMPLE_PER_LIST, MAX_SAMPLE) / max(1, n_rows)
    turn = rotation(width)

    def turned(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        x, ok = _unit(_vectors(batch.column(1), width))
        return ok, np.ascontiguousarray((x @ turn).astype(np.float32) + np.float32(0)), np.flatnonzero(ok)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            ok, x, _ = turned(batch)
            picked = rng.random(len(x)) < share
            vec = pa.array([r.tobytes() if p else None for r, p in zip(x, picked, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array(_hashes(x)), vec], names=["key", "h", "vec"])

    seen = cut_lineage(rows.mapInArrow(look, "key string, h bigint, vec binary"), "hashes")
    sample = np.frombuffer(b"".join(seen.where("vec IS NOT NULL").select("vec").toArrow().column(0).to_pylist()), dtype=np.float32).reshape(-1, width)
    n_rows = seen.count()
    model = fit(sample, max(1, -(-n_rows // per_list)), n_rows, LONG * per_list)

    # repeated keys whose vectors differ: the smallest hash stays
    odd = cut_lineage(seen.groupBy("key").agg(F.min("h").alias("keep"), F.max("h").alias("most")).where("keep < most").select("key", "keep"), "odd-keys")
    rows = rows.withColumn("keep", F.lit(None).cast("bigint")) if odd.isEmpty() else rows.join(odd, "key", "left")

    # classes of copies too large for a list: at most HOT_SHARE of them
    hot = seen.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_LISTS * per_list, n_rows / HOT_SHARE)).select("h")
    hot = cut_lineage(hot, "hot-copies")
    members, last = None, {}
    if not hot.isEmpty():
        members = seen.join(F.broadcast(hot), "h").select("h", "key").distinct().join(odd, "key", "left").where("keep IS NULL OR keep = h").select("h", "key")
        members = cut_lineage(members, "hot-members")
        first = members.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("key"))).where(F.col("r") <= k + 1)
        last = {r.h: (r.lo, r.hi) for r in first.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}  # at most HOT_SHARE
    shared = spark.sparkContext.broadcast((model, np.array(sorted(last), dtype=np.int64), {h: hi for h, (_, hi) in last.items()}))

    def place(probes: int, within: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, hot_hashes, hot_last = shared.value
            sent = set()
            for batch in batches:
                _, x, at = turned(batch)
                h = _hashes(x)
                keys = batch.column(0).take(pa.array(at))
                keep = batch.column(2).take(pa.array(at))
                take = keep.is_null().to_numpy(zero_copy_only=False) | (h == keep.fill_null(0).to_numpy(zero_copy_only=False))
                for i in np.flatnonzero(np.isin(h, hot_hashes) & take):
                    name = keys[int(i)].as_py()
                    take[i] = name <= hot_last[h[i]] and name not in sent
                    sent.add(name if take[i] else None)
                some = np.flatnonzero(take)
                x, keys = x[some], keys.take(pa.array(some))
                row, cell, home, _ = assign(x, model, probes, within)
                ask = batch.column(3).take(pa.array(at)).take(pa.array(some)).to_numpy(zero_copy_only=False).astype(bool)[row]
                n = model.blocks[cell]
                pos = np.repeat(np.arange(len(row)), n)
                nth = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
                own = home[pos] & (nth == (h[some][row[pos]] % n[pos]))
                role = (own * 1 + ask[pos] * 2).astype(np.int8)
                used = np.flatnonzero(role)
                row, pos = row[pos[used]], pos[used]
                flat = pa.py_buffer(np.ascontiguousarray(x[row]))
                ends = pa.py_buffer(np.arange(0, 4 * width * len(row) + 1, 4 * width, dtype=np.int32))
                vec = pa.Array.from_buffers(pa.binary(), len(row), [None, ends, flat])
                where = pa.array((model.offset[cell[pos]] + nth[used]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([where, keys.take(pa.array(row)), pa.array(role[used]), vec], names=["cell", "key", "role", "vec"])

        return run

    def search(asked: DataFrame, probes: int, within: float) -> DataFrame:
        """key, near of rows(key, vec, keep, ask) that ask."""
        placed = asked.select("key", "vec", "keep", "ask").mapInArrow(place(probes, within), "cell bigint, key string, role tinyint, vec binary")
        found = placed.groupBy("cell").applyInArrow(_search_list(width, k, epsilon), NEAR)
        merged = found.groupBy("key").agg(F.flatten(F.collect_list("near")).alias("near"))
        return cut_lineage(merged.select("key", F.slice(F.array_sort("near"), 1, k).alias("near")), "nearest")

    found = search(rows.withColumn("ask", F.lit(True)), MAX_PROBES, PROBE_WITHIN)
    probes, most = MAX_PROBES, None
    while probes < model.n_lists and not (short := found.where(F.size("near") < (k if most is None else most))).isEmpty():
        most = min(k, seen.agg(F.count_distinct("key")).first()[0] - 1) if most is None else most
        probes *= 8
        ask = short.where(F.size("near") < most).select("key", F.lit(True).alias("ask"))
        again = search(rows.join(ask, "key", "left").withColumn("ask", F.coalesce("ask", F.lit(False))), min(probes, model.n_lists), float("inf"))
        found = cut_lineage(found.join(again.select("key"), "key", "left_anti").unionByName(again), "nearest")
    if members is None:
        return found
    lows = spark.createDataFrame([(h, lo, hi) for h, (lo, hi) in last.items()], "h bigint, lo string, hi string")
    of_class = lows.join(found, lows["lo"] == found["key"]).select("h", "lo", "hi", "near")  # at most HOT_SHARE rows
    self_ = F.array(F.struct(F.lit(-1.0).alias("neg"), F.col("lo").alias("key")))
    rest = members.join(F.broadcast(of_class), "h").where("key > hi").select("key", F.slice(F.array_sort(F.concat("near", self_)), 1, k).alias("near"))
    return found.unionByName(rest)


def pairs(near: DataFrame) -> DataFrame:
    """key_a < key_b where at least one is among the nearest of the other."""
    one = near.select("key", F.explode("near").alias("n"))
    return one.select(F.least("key", "n.key").alias("key_a"), F.greatest("key", "n.key").alias("key_b")).distinct()
