"""Operator 3: interpolated modified Kneser-Ney scoring with a memory-mapped n-gram model of order 2 or 3.

Words are counted under 64-bit hashes, sorted into arrays, and numbered by their place there. A longer
gram is the pair (number of its first words, number of its last words) of two grams one word shorter,
and is numbered by its place among the sorted pairs in turn, so grams never share a key whatever the
vocabulary; counts are 64 bits wide. Pairs are dealt to buckets by (mix(prefix) + suffix) modulo their
number, which spreads the grams of a frequent word over all of them, and within a bucket a pair is one
64-bit key.

Counting, once an order: each task sorts its keys per chunk of text, counts repeats, and sends what
falls into a bucket as one row of delta-coded bytes (map-side combining); a bucket merges its rows,
writes its keys as a sorted array into the shared folder, and adds up what its grams tell of their
prefixes (totals and numbers of followers seen once, twice and more often) and of their suffixes
(how many words they follow). Discounts come from counts of counts, order by order; grams that begin a
text keep their counts on lower orders; the unigram level interpolates with a uniform distribution
over the vocabulary and one unknown word. Scoring maps the arrays into memory, and looks up the sorted
distinct grams of a chunk of text at once, in those buckets into which they fall.

A task that is run again writes the same file again (a rename puts it in place). The shared folder
must be one that workers can map: a file system path, as file: or no scheme; others raise.

Rows: one for each row of docs; null and wordless texts are one end token. Repeated rows count as
often as they stand there; null doc_ids count as the empty text where rows are split. If nothing is
trained on, all probabilities are uniform over one unknown word (scores 0). Further columns are
ignored.
"""

from __future__ import annotations

import mmap
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import LOWER, SPACE_SEP, blocks, held_out, materialize, mix, shared_dir, word_hashes, word_spans

MOD, ORDER, CHUNK_WORDS, BUCKET_CHARACTERS, PARTS = 7, 3, 2_000_000, 8_000_000, 4096
SCORED_BYTES = 6_000_000  # of text that meet the arrays at once
MAPS = 32_768  # files that a process maps at once, half of what Linux allows; beyond that the oldest go and are mapped again
BATCH_BYTES = 8_000_000  # of packed counts that go to a worker at once
#: By kind of file its columns of counts; the highest order's count is its value.
COLUMNS = {"grams": ["count"], "told": ["total", "ones", "twos", "more", "value"]}
END = np.uint64(0x5EED5EED5EED5EED)
_HIGH = np.uint64(32)


def tokens(texts: pa.Array):
    """(hashes, bounds) of the tokens of each block of texts, the end token of each included."""
    for _, data, offsets in blocks(texts, SCORED_BYTES):
        data = LOWER[data]
        starts, ends, bounds = word_spans(data, offsets, SPACE_SEP)
        n = len(offsets) - 1
        out = np.full(len(starts) + n, END, np.uint64)
        out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(bounds))] = word_hashes(data, starts, ends)
        yield out, bounds + np.arange(n + 1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences; the high planes are mostly 0 and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() if len(keys) else b""


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, after one byte that tells how many."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 256**w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_counts(raw: bytes, n: int) -> list[np.ndarray]:
    """The arrays of n counts that stand in raw one after another."""
    out, at = [], 0
    while at < len(raw):
        out.append(np.frombuffer(raw, f"<u{raw[at]}", n, at + 1).astype(np.int64))
        at += 1 + raw[at] * n
    return out


def merge(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sums of values by key, keys sorted."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if not len(key):
        return key, *(np.zeros(0, np.int64) for _ in values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], *(np.add.reduceat(np.concatenate(v)[order], first) for v in values)


def tally(bucket: np.ndarray, key: np.ndarray, inverse: bool = False) -> tuple[np.ndarray, ...]:
    """(buckets, keys, counts or each one's place) of the distinct pairs, sorted."""
    span = int(key.max(initial=0)) + 1
    if (int(bucket.max(initial=0)) + 1) * span <= 2**64:
        found = np.unique(bucket.astype(np.uint64) * np.uint64(span % 2**64) + key, return_inverse=inverse, return_counts=not inverse)
        parts = (np.zeros(len(found[0]), np.uint64), found[0]) if span == 2**64 else np.divmod(found[0], np.uint64(span))
        return parts[0].astype(np.int64), parts[1], found[1]
    order = np.lexsort((key, bucket))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (bucket[order][1:] != bucket[order][:-1]))
    first = np.flatnonzero(new)
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(new) - 1
    return bucket[order][first], key[order][first], back if inverse else np.diff(np.append(first, len(key)))


def _slices(bucket: np.ndarray):
    """(bucket, slice) of sorted buckets, of those that are there."""
    if not len(bucket):
        return
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


_PACKED = "kind int, bucket int, keys binary, counts binary"
GRAM, PREFIX, SUFFIX, SUMMARY = range(4)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "keys", "counts"])


def _rows(kind: int, bucket: np.ndarray, keys: np.ndarray, values: list[np.ndarray]):
    """A row for each of the sorted buckets."""
    for b, part in _slices(bucket):
        yield _batch([(kind, b, pack_keys(keys[part]), b"".join(pack_counts(v[part]) for v in values))])


def _local(folder: str) -> str:
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"workers cannot map files in {folder}; spark.checkpoint.dir must be a file system path")
    return folder


def _save(folder: str, name: str, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    """Puts sorted keys and columns of counts into one file of the folder; a later attempt replaces an earlier one whole.

    A byte a count; those that need more stand apart with their places.
    """
    os.makedirs(folder, exist_ok=True)
    far = [np.flatnonzero(c >= 255) for c in columns]
    parts = [np.array([len(keys), len(columns[0]), *map(len, far)]), keys.view(np.int64), *(x.astype(np.int64) for f, c in zip(far, columns, strict=True) for x in (f, c[f]))]
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(temp, "wb") as file:
        for part in (*parts, *(np.minimum(c, 255).astype(np.uint8) for c in columns)):
            part.tofile(file)
    os.replace(temp, f"{folder}/{name}")


def _load(path: str, columns: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(keys, (bytes, places of larger counts, these) by column) of a saved file, mapped; no file stays open."""
    with open(path, "rb") as file:
        raw = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    size, n, *far = np.frombuffer(raw, np.int64, 2 + columns).tolist()
    at = 8 * (2 + columns)
    keys, at = np.frombuffer(raw, np.uint64, size, at), at + 8 * size
    large = []
    for m in far:
        large.append((np.frombuffer(raw, np.int64, m, at), np.frombuffer(raw, np.int64, m, at + 8 * m)))
        at += 16 * m
    return keys, [(np.frombuffer(raw, np.uint8, n, at + k * n), *pair) for k, pair in enumerate(large)]


def place_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """A word's bucket; it grows with the hash."""
    return ((words >> _HIGH) * np.uint64(buckets) >> _HIGH).astype(np.int64)


class Grams:
    """How pairs of grams become buckets and keys; ids of the shorter grams are below size (prefixes at most size)."""

    def __init__(self, size: int, buckets: int):
        self.buckets, self.width = buckets, size // buckets + 1

    def _turn(self, prefix: np.ndarray) -> np.ndarray:
        return (mix(prefix.astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)

    def keys(self, prefix: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = (self._turn(prefix) + suffix) % self.buckets
        return bucket, prefix.astype(np.uint64) * np.uint64(self.width) + (suffix // self.buckets).astype(np.uint64)

    def pair(self, bucket: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prefix, part = (x.astype(np.int64) for x in np.divmod(key, np.uint64(self.width)))
        return prefix, part * self.buckets + (bucket - self._turn(prefix)) % self.buckets


class Model:
    """The mapped arrays of a model as far as it is built; numbers grams and looks up what is known of them."""

    def __init__(self, about: dict):
        self.about, self.folder, self.maps = about, _local(about["folder"]), {}
        self.offsets = [np.array(o) for o in about["offsets"]]  # by order: the first number of each bucket, and the end

    def grams(self, level: int) -> Grams:
        return Grams(int(self.offsets[level - 2][-1]), self.about["buckets"])

    def part(self, kind: str, level: int, bucket: int) -> tuple:
        """What a bucket's file of a kind holds."""
        name = f"{kind}{level}-{bucket}"
        if name not in self.maps:
            while len(self.maps) >= MAPS:
                self.maps.pop(next(iter(self.maps)))
            self.maps[name] = _load(f"{self.folder}/{name}", len(COLUMNS[kind]))
        return self.maps[name]

    def counts(self, column: str, level: int, bucket: int, at: np.ndarray) -> np.ndarray:
        kind = "told" if level < self.about["order"] and column != "count" else "grams"
        narrow, places, large = self.part(kind, level, bucket)[1][COLUMNS[kind].index(column) if kind == "told" else 0]
        out = narrow[at].astype(np.int64)
        if len(much := np.flatnonzero(out == 255)):
            out[much] = large[np.searchsorted(places, at[much])]
        return out

    def find(self, level: int, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct keys, -1 of absent ones."""
        out = np.full(len(keys), -1, np.int64)
        offsets = self.offsets[level - 1]
        for b, part in _slices(bucket):
            if offsets[b] == offsets[b + 1]:
                continue
            stored = self.part("grams", level, b)[0]
            at = np.minimum(np.searchsorted(stored, keys[part]), len(stored) - 1)
            out[part] = np.where(stored[at] == keys[part], offsets[b] + at, -1)
        return out

    def values(self, level: int, ids: np.ndarray, columns: list[str]) -> list[np.ndarray]:
        """What is stored of grams by number, 0 for -1; other numbers must ascend. The number after the last word's is the start mark's."""
        out = [np.zeros(len(ids), np.int64) for _ in columns]
        offsets = self.offsets[level - 1]
        known = np.flatnonzero(ids >= 0)
        for b, part in _slices(np.searchsorted(offsets, ids[known], "right") - 1):
            at = ids[known[part]] - offsets[b]
            for column, found in zip(columns, out, strict=True):
                found[known[part]] = self.counts(column, level, b, at)
        return out

    def number(self, words: np.ndarray, bounds: np.ndarray, upto: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """By order: the numbers of the distinct grams (-1 of unknown ones and, last, of none), and for each token the place of the one that ends there."""
        own, back = np.unique(words, return_inverse=True)
        out = [(np.append(self.find(1, place_of(own, self.about["buckets"]), own), -1), back)]
        for level in range(2, upto + 1):
            prefix, suffix = self.ends(out[-1], bounds, level)
            known = np.flatnonzero((prefix >= 0) & (suffix >= 0))
            bucket, keys, places = tally(*self.grams(level).keys(prefix[known], suffix[known]), inverse=True)
            back = np.full(len(words), -1, np.int64)
            back[known] = places
            out.append((np.append(self.find(level, bucket, keys), -1), back))
        return out

    def ends(self, shorter: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix and suffix of the grams of an order that end at each token, by number."""
        suffix = shorter[0][shorter[1]]
        prefix = np.empty_like(suffix)
        prefix[1:] = suffix[:-1]
        # The start mark stands before the first word; nothing stands before that.
        prefix[bounds[:-1]] = self.offsets[0][-1] if level == 2 else -1
        return prefix, suffix

    def log10(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(model's log10 probability, training count) of each token."""
        about = self.about
        numbers = self.number(words, bounds, about["order"])
        (ids, back) = numbers[0]
        count, follows = (v[back] for v in self.values(1, ids, ["count", "value"]))
        uniform, total = 1 / (about["vocabulary"] + 1), about["sums"][1]
        if not total:
            return np.full(len(words), np.log10(uniform)), count
        d = np.array([0, *about["discounts"][1]])
        p = (follows - d[np.minimum(follows, 3)]) / total + about["spare"] / total * uniform
        names = COLUMNS["told"][:-1]
        for level in range(2, about["order"] + 1):
            (ids, back), (shorter, before) = numbers[level - 1], numbers[level - 2]
            d = np.array([0, *about["discounts"][level]])
            value = self.values(level, ids, ["value"])[0]
            first = [v[0] for v in self.values(1, self.offsets[0][-1:], names)] if level == 2 else [0] * 4
            # By prefix: 1 / total, and what the discounts leave to the lower order (all of it for an unknown prefix).
            total, ones, twos, more = (np.append(v, x) for v, x in zip(self.values(level - 1, shorter, names), first, strict=True))
            there = np.maximum(total, 1)
            share, spare = (total > 0) / there, np.where(total > 0, (d[1] * ones + d[2] * twos + d[3] * more) / there, 1.0)
            place = np.empty(len(words), np.int64)
            place[1:] = before[:-1]
            place[place == -1] = len(shorter) - 1
            place[bounds[:-1]] = len(shorter)
            p *= spare[place]
            p += share[place] * (value - d[np.minimum(value, 3)])[back]
        return np.log10(p), count


_MODELS: dict[tuple, Model] = {}


def _model(about: dict) -> Model:
    """A process keeps the newest model's maps."""
    key = about["folder"], len(about["offsets"]), "spare" in about
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(about)
    return _MODELS[key]


def _count(about: dict, level: int):
    """Packed counts of a chunk's grams of an order."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            words = np.concatenate([w for w, _ in held])
            starts = np.cumsum([0, *(len(w) for w, _ in held)])
            bounds = np.concatenate([*(b[:-1] + s for (_, b), s in zip(held, starts[:-1], strict=True)), starts[-1:]])
            held.clear()
            if level == 1:
                keys, counts = np.unique(words, return_counts=True)
                bucket = place_of(keys, about["buckets"])
            else:
                model = _model(about)
                prefix, suffix = model.ends(model.number(words, bounds, level - 1)[-1], bounds, level)
                there = prefix >= 0
                bucket, keys, counts = tally(*model.grams(level).keys(prefix[there], suffix[there]))
            yield from _rows(GRAM, bucket, keys, [counts])

        for batch in batches:
            for part in tokens(batch.column(0)):
                held.append(part)
                if sum(len(w) for w, _ in held) >= CHUNK_WORDS:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _groups(batches):
    """Merges the consecutive rows of each bucket (rows come sorted by it): (bucket, {kind: (keys, value arrays)})."""
    now, found = None, {}

    def merged():
        return now, {kind: merge(keys, *values) for kind, (keys, values) in found.items()}

    for batch in batches:
        for row in range(batch.num_rows):
            kind, bucket, raw, counts = (c[row].as_py() for c in batch.columns)
            if bucket != now and now is not None:
                yield merged()
                found = {}
            now = bucket
            if raw:
                key = unpack_keys(raw)
                values = unpack_counts(counts, len(key))
                keys, sums = found.setdefault(kind, ([], [[] for _ in values]))
                keys.append(key)
                for value, more in zip(sums, values, strict=True):
                    value.append(more)
    if now is not None:
        yield merged()


def _tell(model: Model, level: int, bucket: int, keys: np.ndarray, values: np.ndarray):
    """Rows of what grams of an order tell of their prefixes and suffixes, one word shorter, and of their own values."""
    yield _batch([(SUMMARY, bucket, b"", np.array([len(keys), int(values.sum()), *((values == k).sum() for k in (1, 2, 3, 4))], "<i8").tobytes())])
    if level == 1:
        return
    offsets = model.offsets[level - 2]
    prefix, suffix = model.grams(level).pair(bucket, keys)
    first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])[: len(prefix)])
    if not len(first):
        return
    stats = [np.add.reduceat(v.astype(np.int64), first) for v in (values, values == 1, values == 2, values >= 3)]
    yield from _rows(PREFIX, np.searchsorted(offsets, prefix[first], "right") - 1, prefix[first].astype(np.uint64), stats)
    suffix, types = np.unique(suffix, return_counts=True)
    yield from _rows(SUFFIX, np.searchsorted(offsets, suffix, "right") - 1, suffix.astype(np.uint64), [types])


def _store(about: dict, level: int):
    """Stores each merged bucket of an order's grams. Those of the highest order tell of shorter ones at once."""

    def run(batches):
        model = _model(about)
        for bucket, found in _groups(batches):
            keys, counts = found.get(GRAM, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            _save(model.folder, f"grams{level}-{bucket}", keys, [counts])
            if level == about["order"]:
                yield from _tell(model, level, bucket, keys, counts)
            else:
                yield _batch([(SUMMARY, bucket, b"", np.array([len(keys), int(counts.sum())], "<i8").tobytes())])

    return run


def _settle(about: dict, level: int):
    """Stores by bucket what longer grams told of an order's grams; what that makes of these they tell of shorter ones."""

    def run(batches):
        model, offsets = _model(about), about["offsets"][level - 1]
        for bucket, found in _groups(batches):
            begin = offsets[bucket]
            n = offsets[bucket + 1] - begin if bucket + 1 < len(offsets) else 1  # the start mark is alone
            told = []
            for kind, columns in ((PREFIX, COLUMNS["told"][:-1]), (SUFFIX, COLUMNS["told"][-1:])):
                keys, *sums = found.get(kind, (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in columns)))
                for own in sums:
                    dense = np.zeros(n, np.int64)
                    dense[keys.astype(np.int64) - begin] = own
                    told.append(dense)
            if level > 1:
                # Grams that begin a text have nothing before them: their count stands.
                grams = model.part("grams", level, bucket)[0]
                starts = np.flatnonzero(model.grams(level).pair(bucket, grams)[0] == model.offsets[0][-1])
                dense[starts] = model.counts("count", level, bucket, starts)
            _save(model.folder, f"told{level}-{bucket}", np.zeros(0, np.uint64), told)
            if level > 1:
                yield from _tell(model, level, bucket, grams, dense)
            else:
                yield from _tell(model, level, bucket, dense[dense > 0], dense[dense > 0])

    return run


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from counts of counts; kept in (0, count)."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def train(docs: DataFrame, mod: int = MOD, order: int = ORDER) -> dict:
    """Counts the training rows of docs(doc_id, text) and writes the model; returns what scoring needs to find it."""
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    spark = docs.sparkSession
    texts = docs.where(~held_out(F.col("doc_id"), mod)).select("text")
    size = docs.select(F.sum(F.length("text"))).first()[0] or 0
    about: dict = {"folder": f"{shared_dir(spark)}/kneser-{uuid.uuid4().hex}", "buckets": max(4, size // BUCKET_CHARACTERS + 1), "order": order, "offsets": [], "sums": {}, "discounts": {}}
    _local(about["folder"])

    def dealt(rows: DataFrame, step, name: str) -> tuple[DataFrame, list[list[int]]]:
        """A step by bucket, every bucket at least with a row without keys; and the summary numbers by bucket (a few each)."""
        buckets = about["buckets"]
        every = spark.range(buckets + 1).select(F.lit(GRAM).alias("kind"), F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"))
        sorted_rows = rows.where("kind <> 3").union(every).repartition(min(buckets + 1, PARTS), "bucket").sortWithinPartitions("bucket", "kind")
        out = materialize(sorted_rows.mapInArrow(step, _PACKED), name, BATCH_BYTES)
        numbers = [[0] * 6 for _ in range(buckets + 1)]
        for bucket, raw in out.where("kind = 3").select("bucket", "counts").toLocalIterator():
            numbers[bucket] = np.frombuffer(raw, "<i8").tolist()
        return out, numbers

    for level in range(1, order + 1):
        rows, numbers = dealt(texts.mapInArrow(_count(dict(about), level), _PACKED), _store(dict(about), level), "grams")
        about["offsets"].append([0, *np.cumsum([n[0] for n in numbers[:-1]]).tolist()])
        if level == 1:
            about["vocabulary"], about["tokens"] = about["offsets"][0][-1], sum(n[1] for n in numbers)
    for level in range(order, 0, -1):
        types, total, ones, twos, *more = np.sum(numbers, 0).tolist()
        about["sums"][level], about["discounts"][level] = total, discounts([ones, twos, *more])
        if level > 1:
            rows, numbers = dealt(rows, _settle(dict(about), level - 1), "told")
    d = about["discounts"][1]
    about["spare"] = d[0] * ones + d[1] * twos + d[2] * (types - ones - twos)
    return about


def score(docs: DataFrame, about: dict, mod: int = MOD) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs."""

    def run(batches):
        model = _model(about)
        n, v = about["tokens"], about["vocabulary"]
        for batch in batches:
            at = 0
            for words, bounds in tokens(batch.column(1)):
                rows = len(bounds) - 1
                logs, counts = model.log10(words, bounds)
                base = np.log10((counts + 1) / (n + v + 1))
                sums = [np.add.reduceat(x, bounds[:-1]) for x in ((counts > 0).astype(np.int64), base, logs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), batch.column(2).slice(at, rows), pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array(np.full(rows, n, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                at += rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", held_out(F.col("doc_id"), mod).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_corpus(docs: DataFrame, mod: int = MOD, order: int = ORDER) -> DataFrame:
    return score(docs, train(docs, mod, order), mod)
