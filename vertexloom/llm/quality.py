"""Operator 6: quality classifier, histogram gradient-boosted trees over document statistics.

Statistics of whole texts (lengths, character classes, repetition of words, word runs and lines) are
computed block-wise with numpy. Trees are grown on at most `SAMPLE` labelled rows (those with the
lowest hash of doc_id) over `BINS` quantile bins with second-order logistic gains, and flattened into
arrays that all rows walk together. Labels, lang, source and doc_id are no inputs of a score.

Rows: one for each row of docs; null is an empty text, whose statistics are 0. Labels that are null
or meet no document teach nothing; without labels of both kinds the score is the constant share of
label 1, (ones + 1) / (rows + 1). Repeated rows have equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import LOWER, SPACE_SEP, blocks, held_out, materialize, mix, word_hashes, word_spans

SAMPLE, BINS, TREES, DEPTH, RATE, L2, MIN_ROWS, THRESHOLD = 20_000, 64, 60, 5, 0.15, 1.0, 20, 0.7

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "other_bytes": range(128, 256), "space": [32, 9, 11, 12, 13], "line": [10],
    "sentence": b".,;:?'\"()-", "mark": b"!", "symbol": b"#%&$*@^~_=+<>{}[]\\/`", "bar": b"|",
}


def _distinct(keys: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct keys and of the most frequent key, by owner."""
    own = mix(keys + mix(owner.astype(np.uint64) + np.uint64(1)))
    _, at, counts = np.unique(own, return_index=True, return_counts=True)
    distinct, most = np.bincount(owner[at], minlength=rows), np.zeros(rows, np.int64)
    np.maximum.at(most, owner[at], counts)
    return distinct, most


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, statistics) float32."""
    out = []
    for _, data, offsets in blocks(texts):
        rows, size = len(offsets) - 1, np.diff(offsets)
        columns = [np.log1p(size)]
        safe = np.maximum(size, 1)
        for members in _CLASSES.values():
            table = np.zeros(256, np.int64)
            table[list(members)] = 1
            columns.append(np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets]) / safe)
        starts, ends, bounds = word_spans(data, offsets, SPACE_SEP)
        n = np.diff(bounds)
        words = np.maximum(n, 1)
        owner = np.repeat(np.arange(rows), n)
        length = ends - starts
        hashes = word_hashes(LOWER[data], starts, ends)
        per = lambda flags: np.bincount(owner, weights=flags, minlength=rows) / words
        columns += [np.log1p(n), per(length), per(length**2), per(length <= 2), per(length >= 15)]
        last = data[ends - 1] if len(ends) else data[:0]
        columns.append(per(~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128))))
        distinct, most = _distinct(hashes, owner, rows)
        columns += [distinct / words, most / words, distinct / np.sqrt(words)]
        again = np.zeros(len(hashes))
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        columns.append(per(again))
        for k in (2, 4):
            m = max(0, len(hashes) - k + 1)
            run = sum((hashes[j : j + m] * np.uint64(2 * j + 3) for j in range(k)), np.zeros(m, np.uint64))
            same = owner[:m] == owner[k - 1 : k - 1 + m]
            distinct, most = _distinct(mix(run[same]), owner[:m][same], rows)
            whole = np.maximum(n - k + 1, 1)
            columns += [distinct / whole, most / whole]
        is_break = np.zeros(256, bool)
        is_break[10] = True
        starts, ends, bounds = word_spans(data, offsets, is_break)
        lines = np.diff(bounds)
        distinct, most = _distinct(word_hashes(data, starts, ends), np.repeat(np.arange(rows), lines), rows)
        columns += [np.log1p(lines), distinct / np.maximum(lines, 1), most / np.maximum(lines, 1), n / np.maximum(lines, 1)]
        out.append(np.stack(columns, 1).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, 1), np.float32)


class Forest:
    """Trees as flat arrays: node k splits on feature[k] <= cut[k] into left[k] and left[k] + 1; leaves lead to themselves."""

    def __init__(self, base: float):
        self.base, self.roots = base, np.zeros(0, np.int64)
        self.feature, self.cut, self.left, self.value = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0)

    def add(self, feature, cut, left, value) -> None:
        at = len(self.feature)
        self.roots = np.append(self.roots, at)
        self.feature, self.cut, self.value = np.append(self.feature, feature), np.append(self.cut, np.float32(cut)), np.append(self.value, value)
        leaf = np.array(left) < 0
        self.left = np.append(self.left, np.where(leaf, np.arange(len(leaf)), left) + at)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, all trees of a chunk of rows at a time."""
        total = np.full(len(x), self.base)
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            node = np.repeat(self.roots[None, :], len(part), 0)
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                right = part[rows, self.feature[node]] > self.cut[node]
                after = self.left[node]
                node = np.where(after == node, node, after + right)
            total[a : a + 4096] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosts logistic loss; x float32 rows, y 0 or 1."""
    ones = int(y.sum())
    prior = (ones + 1) / (len(y) + 1) if ones in (0, len(y)) else ones / len(y)
    prior = min(prior, 1 - 1e-6)
    forest = Forest(float(np.log(prior / (1 - prior))))
    if ones in (0, len(y)):
        return forest
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower").astype(np.float32)) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    raw = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        feature, cut, left, value = [0], [0.0], [-1], [0.0]
        node, open_ = np.zeros(len(y), np.int64), [0]
        for depth in range(DEPTH + 1):
            place = np.full(len(feature), -1)
            place[open_] = np.arange(len(open_))
            mine = place[node]
            live = mine >= 0
            g0, h0 = (np.bincount(mine[live], weights=v[live], minlength=len(open_)) for v in (grad, hess))
            for k, o in enumerate(open_):
                value[o] = float(-RATE * g0[k] / (h0[k] + L2))
            if depth == DEPTH or not open_:
                break
            best = np.full(len(open_), 1e-6)
            choice = [None] * len(open_)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                key = mine[live] * width + bins[live, f]
                g, h, n = (np.bincount(key, weights=v, minlength=len(open_) * width).reshape(-1, width).cumsum(1)[:, :-1] for v in (grad[live], hess[live], np.ones(live.sum())))
                count = np.bincount(mine[live], minlength=len(open_))[:, None]
                gain = g**2 / (h + L2) + (g0[:, None] - g) ** 2 / (h0[:, None] - h + L2) - (g0**2 / (h0 + L2))[:, None]
                gain[(n < MIN_ROWS) | (count - n < MIN_ROWS)] = -1
                top = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(len(open_)), top] > best):
                    best[k], choice[k] = gain[k, top[k]], (f, int(top[k]))
            now = []
            for k, o in enumerate(list(open_)):
                if choice[k] is None:
                    continue
                f, b = choice[k]
                feature[o], cut[o], left[o] = f, float(cuts[f][b]), len(feature)
                at = np.flatnonzero(node == o)
                node[at] = len(feature) + (bins[at, f] > b)
                now += [len(feature), len(feature) + 1]
                feature += [0, 0]
                cut += [0.0, 0.0]
                left += [-1, -1]
                value += [0.0, 0.0]
            open_ = now
        raw += np.array(value)[node]
        forest.add(feature, cut, left, value)
    return forest


def _measure(batches):
    for batch in batches:
        if batch.num_rows:
            x = statistics(batch.column(1))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), stats], ["doc_id", "held_out", "stats"])


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Learns from the labelled rows of measured(doc_id, held_out, stats) that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("y")).where("y is not null")
    rows = measured.where("not held_out").join(marks, F.col("doc_id") == F.col("label_id")).select("stats", "y", F.xxhash64("doc_id").alias("key"))
    # A bounded sample: the documented number of labelled rows.
    found = rows.orderBy("key", "stats", "y").limit(sample).select("stats", "y").toArrow()
    y = found.column(1).to_numpy().astype(float)
    x = found.column(0).combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 1), np.float32)
    return grow(x, (y > 0).astype(float))


def measure(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, stats), written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", held_out(F.col("doc_id"), 4).alias("held_out"))
    return materialize(rows.mapInArrow(_measure, "doc_id long, held_out boolean, stats array<float>"), "stats")


def score(measured: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each measured row."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = shared.value.scores(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array(p >= threshold).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return measured.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured = measure(docs)
    return score(measured, train(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score at least threshold; learns as classify does."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out(F.col("doc_id"), 4))
    marks = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").join(known, "doc_id", "left_semi")
    marks = materialize(marks.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample), "sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks.select("doc_id").distinct()), "doc_id", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(train(measure(rows), marks, sample))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.scores(statistics(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
