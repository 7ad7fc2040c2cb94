"""Operator 10: exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors become integers, floor(256 * component). A block of vectors is an index: a posting segment
holds the vectors that have one quantised impact (absolute value by `STEP`) with one sign in one
dimension, and segments are processed by descending impact for a chunk of queries at once. What is
still unprocessed is below the current impact, so each score is known within a bound (sums stay exact
integers in floats of sufficient width); a query stops when so few vectors can still be among its k best that scoring those exactly is cheaper than going
on. All possible members are rescored exactly, so the result is exact wherever a query stops.

Queries are broadcast in blocks of at most `QUERY_BLOCK`, and `PASS_BLOCKS` blocks make one pass over
the vectors, in which each index is built once for all of them; a partition returns k rows a query,
and the last step picks among them.

Vectors with a component beyond `WIDE` are not in the index: they meet the queries, and queries that
hold such a component meet all vectors, in Python's integers, which have no bound.

Rows: vectors that are null, or hold null or non-finite components, and rows with a null vec_id take
no part. Vectors of different lengths score over their common components. Rows with a query's vec_id
are its own and no candidates; a repeated query id is asked once, with its largest vector. Ties go
to the smaller vec_id; ranks follow exact scores, and a score that no long can hold is returned as the
nearest long; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, STEP, INDEX_ROWS, QUERY_BLOCK, PASS_BLOCKS, CHUNK = 256, 4, 4096, 2048, 8, 256
CHECKS = (8, 4, 2, 1, 0)  # impacts at which queries may stop
WIDE = 2**19  # sums over 2**15 dimensions of products below stay exact in floats
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(lists: pa.Array, width: int = 0) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Integer rows, shorter ones filled with 0; rows with a component beyond `WIDE` are 0 there and stand apart by row."""
    sizes = np.asarray(lists.value_lengths(), np.int64)
    raw = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    far = np.unique(owner[np.abs(raw) * SCALE >= WIDE])
    if len(sizes) and int(sizes.max()) > 2**15:
        far = np.arange(len(sizes))
    # From 2**52 on a float is an integer, so it is scaled as one.
    wide = {int(r): [int(x) * SCALE if abs(x) >= 2**52 else math.floor(x * SCALE) for x in raw[owner == r].tolist()] for r in far}
    flat = np.floor(SCALE * np.where(np.isin(owner, far), 0.0, raw))
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, wide


class ImpactIndex:
    """Posting segments of a block of integer vectors, by descending quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.floats, self.peak = ids, vectors.astype(float), int(np.abs(vectors).max(initial=0))
        level = np.abs(vectors) // STEP
        rows, dims = np.nonzero(level)
        levels, signs = level[rows, dims], vectors[rows, dims] < 0
        order = np.lexsort((rows, signs, dims, -levels))
        rows, dims, levels, signs = rows[order], dims[order], levels[order], signs[order]
        key = (levels * vectors.shape[1] + dims) * 2 + signs
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        self.segments = [
            (int(levels[a]), int(dims[a]), -1 if signs[a] else 1, rows[a:b]) for a, b in zip(cut, np.append(cut[1:], len(key)), strict=True)
        ]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int]]:
        """(query row, vector row, exact score) of all vectors that can be among the k best of a query and reach its floor."""
        n = len(self.ids)
        reach = np.abs(queries).sum(1)
        kind = np.float32 if reach.max() * (self.peak + 2 * STEP) < 2**24 else np.float64
        scores = np.zeros((n, len(queries)), kind)
        order = np.argsort(query_ids)
        near = order[np.minimum(np.searchsorted(query_ids, self.ids, sorter=order), len(order) - 1)]
        own = np.flatnonzero(query_ids[near] == self.ids)
        scores[own, near[own]] = -np.inf
        by_dim = np.ascontiguousarray(queries.T).astype(kind)
        out, open_, at = [], np.arange(len(queries)), 0
        groups = np.arange(0, n, max(1, n // (16 * k)))
        while True:
            level = self.segments[at][0] if at < len(self.segments) else 0
            if level in CHECKS or at >= len(self.segments):
                # Unprocessed impacts are below (level + 1) * STEP, processed ones known within STEP / 2.
                seen = scores if len(open_) == len(queries) else scores[:, open_]
                bound = reach[open_] * ((level + 1) * STEP if at < len(self.segments) else STEP)
                # The k-th best of the groups' best is at most the k-th best of all.
                best = np.maximum.reduceat(seen, groups, 0)
                least = np.partition(best, len(best) - k, 0)[len(best) - k] - bound if len(best) >= k else np.full(len(open_), -np.inf)
                may = seen >= np.maximum(least, floor[open_]) - bound
                may &= seen > -np.inf
                done = (may.sum(0) <= 8 * k) | (at >= len(self.segments))
                for j in np.flatnonzero(done):
                    rows = np.flatnonzero(may[:, j])
                    exact = self.floats[rows] @ queries[open_[j]].astype(float)
                    out += [(int(open_[j]), r, s) for r, s in zip(rows.tolist(), exact.astype(np.int64).tolist(), strict=True)]
                open_ = open_[~done]
            if not len(open_):
                return out
            while at < len(self.segments) and self.segments[at][0] == level:
                _, dim, sign, rows = self.segments[at]
                scores[rows] += by_dim[dim] * kind(sign * (level * STEP + STEP // 2))
                at += 1


def _order_key(score: int) -> str:
    """Text that sorts as scores do which no long can hold: length and digits, complemented below 0."""
    digits = f"{abs(score):x}"
    text = f"{len(digits):08x}{digits}"
    return "p" + text if score >= 0 else "n" + "".join(f"{15 - int(c, 16):x}" for c in text)


def _exact(queries: np.ndarray, wide_queries: dict, vectors: np.ndarray, wide_vectors: dict):
    """(query row, vector row, score) of all pairs in which a wide vector takes part."""
    for q, own in wide_queries.items():
        for r in range(len(vectors)):
            yield q, r, sum(x * y for x, y in zip(own, wide_vectors.get(r) or vectors[r].tolist()))
    for r, own in wide_vectors.items():
        for q in range(len(queries)):
            if q not in wide_queries:
                yield q, r, sum(x * y for x, y in zip(own, queries[q].tolist()))


class _Best:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, wide: dict, k: int):
        self.ids, self.queries, self.wide, self.k = ids, queries, wide, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), np.iinfo(np.int64).min // 4)
        self.narrow = np.array([q for q in range(len(ids)) if q not in wide], np.int64)

    def ask(self, index: ImpactIndex | None, ids: np.ndarray, vectors: np.ndarray, wide: dict) -> None:
        queries = self.queries if vectors.shape[1] == self.queries.shape[1] else np.pad(self.queries, ((0, 0), (0, vectors.shape[1] - self.queries.shape[1])))
        for c in range(0, len(self.narrow) if index else 0, CHUNK):
            part = self.narrow[c : c + CHUNK]
            for q, row, score in index.search(self.ids[part], queries[part], self.k, self.floor[part]):
                self.found[part[q]].append((-score, int(index.ids[row])))
        for q, row, score in _exact(queries, self.wide, vectors, wide):
            if ids[row] != self.ids[q]:
                self.found[q].append((-score, int(ids[row])))
        for q, found in enumerate(self.found):
            found.sort()
            del found[self.k :]
            if len(found) == self.k:
                self.floor[q] = max(-(2**61), min(2**61, -found[-1][0]))


def _search(shared: list, k: int):
    def run(batches):
        blocks = [_Best(*block.value, k) for block in shared]
        width = max(block.queries.shape[1] for block in blocks)
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_ROWS):
                some = batch.slice(at, INDEX_ROWS)
                vectors, wide = _matrix(some.column(1), width)
                ids = some.column(0).to_numpy()
                narrow = np.array([r for r in range(len(ids)) if r not in wide], np.int64)
                index = ImpactIndex(ids[narrow], vectors[narrow]) if len(narrow) else None
                for block in blocks:
                    block.ask(index, ids, vectors, wide)
        rows = [(int(block.ids[q]), vec, -negative) for block in blocks for q, found in enumerate(block.found) for negative, vec in found]
        if rows:
            beyond = [(s > LONG) - (s < -LONG) for *_, s in rows]
            columns = [[q for q, *_ in rows], [v for _, v, _ in rows], [max(-LONG, min(LONG, s)) for *_, s in rows], beyond]
            keys = [_order_key(s) if far else "" for (*_, s), far in zip(rows, beyond, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(keys)], ["query_id", "vec_id", "score", "beyond", "order_key"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score) of each query's k highest scores."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sc = vectors.sparkSession.sparkContext
    passes, ids, rows = [[]], [], []

    def flush():
        if len(passes[-1]) == PASS_BLOCKS:
            passes.append([])
        passes[-1].append(sc.broadcast((np.array(ids, np.int64), *_matrix(pa.array(rows, pa.list_(pa.float64()))))))
        ids.clear(), rows.clear()

    for row in good.where(is_query).groupBy("vec_id").agg(F.max("embedding").alias("embedding")).toLocalIterator():
        ids.append(row[0])
        rows.append(row[1])
        if len(ids) == QUERY_BLOCK:
            flush()
    if ids or not passes[0]:
        flush()
    found = [good.mapInArrow(_search(blocks, k), "query_id long, vec_id long, score long, beyond long, order_key string") for blocks in passes]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("order_key"), F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
