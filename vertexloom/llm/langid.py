"""Operator 1: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-cased letters with single code point for everything else; n-grams of 1 to `ORDER`
characters are hashed into `BUCKETS` buckets, weighted by (1 + log count) * idf and scaled to unit
length. Document frequencies cover all training rows. The weights are learned by follow-the-
regularised-leader with elastic-net penalties on a sample of training rows, spread evenly over the
languages by a hash of doc_id and text: about `SAMPLE` rows, or `LEAST` a language if that is more, and
never above 1.25 times as many. Every lang value is learned, those with few rows from all of them; the
model takes 256 KB a language. A softmax temperature is fitted on every fifth row of each language, which
is kept out of the learning. Prediction reads whole texts only.

Rows: one for each row of docs. Null texts and texts without letters are `und` with score 0, as are
all if there is nothing to learn from. Training rows need a text and a lang; null doc_ids count as
the empty text where rows are split. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import blocks, held_out

ORDER, BUCKETS, SAMPLE, LEAST = 3, 1 << 15, 3000, 10
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 2


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def features(texts: pa.Array):
    """(buckets, counts) of each text of an array; none for a text without letters."""
    for _, data, offsets in blocks(texts):
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        points = _letters()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
        space = points == 32
        codes = []
        value = np.zeros(len(points), np.uint64)
        for n in range(1, ORDER + 1):
            value = value[: max(0, len(points) - n + 1)] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
            h = value * np.uint64(0x9E3779B97F4A7C15)
            codes.append((h >> np.uint64(49)).astype(np.int32))
            # Two spaces in a row, or a lone one, say nothing.
            blank = space.copy() if n == 1 else space[:-1] & space[1:]
            bad = blank[: len(value)].copy()
            for k in range(1, n - 1):
                bad |= blank[k : k + len(value)]
            codes[-1][bad] = -1
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = np.concatenate([c[a : max(a, b - n)] for n, c in enumerate(codes)])
            counts = np.bincount(own + 1, minlength=BUCKETS + 1)[1:]
            at = np.flatnonzero(counts) if not space[a:b].all() else np.zeros(0, np.int64)
            yield at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(1e-12, math.sqrt(float(x @ x)))


def _frequencies(batches):
    total = np.zeros(BUCKETS, np.int64)
    rows = 0
    for batch in batches:
        for at, _ in features(batch.column(0)):
            total[at] += 1
            rows += 1
    at = np.flatnonzero(total)
    # Bucket -1 holds the number of rows.
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], ["bucket", "n"])


def _sparse(batches):
    for batch in batches:
        found = list(features(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())],
            ["lang", "order_key", "buckets", "counts"],
        )


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """(classes, buckets) weights by follow-the-regularised-leader (proximal) with L1 and L2 penalties."""
    z, n = np.zeros((classes, BUCKETS)), np.zeros((classes, BUCKETS))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            p = np.exp((s := w @ x) - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x[None, :]
            after = ns + g * g
            z[:, at] = zs + g - (np.sqrt(after) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = after
    return weights(z, n)


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(-1, keepdims=True)
    return s - np.log(np.exp(s).sum(-1, keepdims=True))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The softmax temperature with the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -_log_softmax(scores / math.exp(t))[np.arange(len(labels)), labels].mean()
    low, high, ratio = -2.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, weights, idf, temperature) from the training rows of docs(doc_id, text, lang)."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text is not null and lang is not null").where(~held_out(F.col("doc_id"), 4))
    df = {r[0]: r[1] for r in known.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()}
    total = df.pop(-1, 0)
    seen = np.zeros(BUCKETS)
    seen[list(df)] = list(df.values())
    idf = np.log((1 + total) / (1 + seen)) + 1

    counts = known.groupBy("lang").count().collect()  # a row a language
    languages = sorted(r[0] for r in counts)
    if not languages:
        return [], np.zeros((0, BUCKETS)), idf, 1.0
    # An even share of the sample for each language; the limit takes rare languages, which give all rows, first.
    parts, size = 1 << 30, max(sample, LEAST * len(languages))
    shares = [(lang, math.ceil(parts * min(1, size / len(languages) / n))) for lang, n in counts]
    share = docs.sparkSession.createDataFrame(shares, "lang string, share long")
    chosen = known.withColumn("order_key", F.xxhash64("doc_id", "text")).join(F.broadcast(share), "lang")
    chosen = chosen.where(F.pmod(F.col("order_key"), F.lit(parts)) < F.col("share"))
    chosen = chosen.orderBy(F.desc(F.col("share") == parts), "order_key").limit(math.ceil(1.25 * size)).select("lang", "text", "order_key")
    number, seen_rows = {lang: k for k, lang in enumerate(languages)}, [0] * len(languages)
    learned, kept = [], []
    order = lambda r: ((r[1] * 0x9E3779B97F4A7C15) % 2**64, r[0], bytes(r[2]))
    for r in sorted(chosen.mapInArrow(_sparse, "lang string, order_key long, buckets binary, counts binary").collect(), key=order):
        at, count = np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32)
        if len(at):
            y = number[r[0]]
            seen_rows[y] += 1
            (learned if seen_rows[y] % 5 else kept).append((at, weighted(at, count, idf), y))
    weights = ftrl(learned, len(languages))
    scores = np.array([weights[:, at] @ x for at, x, _ in kept]).reshape(-1, len(languages))
    return languages, weights, idf, temperature(scores, np.array([y for *_, y in kept], int))


def identify(docs: DataFrame, model: tuple) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, lang_pred, score), a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        languages, weights, idf, heat = shared.value
        columns = np.ascontiguousarray(weights.T)
        for batch in batches:
            names, scores = [], []
            for at, counts in features(batch.column(1)):
                if len(at) and languages:
                    p = np.exp(_log_softmax(weighted(at, counts, idf) @ columns[at] / heat))
                    best = int(p.argmax())
                    names.append(languages[best])
                    scores.append(min(1.0, float(p[best])))
                else:
                    names.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", held_out(F.col("doc_id"), 4).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
