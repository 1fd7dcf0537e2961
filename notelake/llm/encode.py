"""Encoding of a corpus with a public byte-level tokenizer (problem 6).

Method: forced boundaries. A byte pair that occurs inside no token of the vocabulary can never be joined by a merge, so
the text may be cut between its two bytes wherever it stands; the fragments are encoded independently and their ids
concatenated. The tokenizer's own splitting pattern gives further cuts, which do depend on context, so it is applied to
the whole text first and the forced cuts inside its pieces. Fragments repeat, so each worker keeps a bounded cache.

Spark partitions the work by document (``mapInArrow``, no shuffle); the vocabulary file (under 1 MB, a fixed size) is
read once by the driver from the path given and broadcast.

Defined results: null and empty texts give an empty list; texts of any length are encoded whole; special tokens are
ordinary text; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as the tokenizer's pattern means it (Unicode White_Space), and the pattern itself.
WHITE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Fragments of up to so many bytes are remembered, up to so many of them in a worker.
CACHED_BYTES, CACHED_FRAGMENTS = 64, 400_000
SHORT = 48


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The vocabulary file: a token in base64 and its id on each line."""
    pairs = (line.split() for line in raw.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def pairs_inside(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256: does the byte pair occur inside any token?"""
    inside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
    return inside


class Encoder:
    """Encodes whole texts by independent fragments."""

    def __init__(self, raw: bytes) -> None:
        self.ranks = read_ranks(raw)
        self.inside = pairs_inside(self.ranks)
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            known = self.known
            for piece in self.pieces.findall(text):
                got = known.get(piece)
                if got is None:
                    got = self._piece(piece)
                ids.extend(got)
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(data)
        got = (rank,) if rank is not None else tuple(i for f in self.fragments(data) for i in self._fragment(f))
        if len(data) <= CACHED_BYTES:
            if len(self.known) >= CACHED_FRAGMENTS:
                self.known.clear()
            self.known[piece] = got
        return got

    def fragments(self, data: bytes) -> Iterator[bytes]:
        """data, cut at every byte pair that no token holds."""
        b = np.frombuffer(data, dtype=np.uint8)
        start = 0
        for cut in np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1:
            yield data[start:cut]
            start = cut
        yield data[start:]

    def _fragment(self, data: bytes) -> list[int]:
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        return self._merge_short(data) if len(data) <= SHORT else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same merges with a heap, for fragments of any length."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
            for a in (before[i], i):
                if a >= 0 and (b := end[a]) < n and (r := ranks.get(data[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b]))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]


@lru_cache(maxsize=2)
def _encoder(raw: bytes) -> Encoder:
    return Encoder(raw)


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, ids array<int> of the text of each row."""
    raw = _vocabulary(df, path)
    narrow = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value)
        for batch in batches:
            flat, ends = array("i"), [0]
            for t in batch.column(1).to_pylist():
                flat.extend(encoder.encode(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, n_tokens of the text of each row, without shipping the ids."""
    raw = _vocabulary(df, path)
    narrow = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value)
        for batch in batches:
            n = [len(encoder.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, n_tokens bigint")
