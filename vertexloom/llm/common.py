"""Shared pieces: shared-folder tables, vectorised tokenising and hashing of whole Arrow columns.

Texts stay bytes: words are found with byte tables and hashed with a prefix-sum polynomial over a
block of texts at once, so no Python object is made per word. Blocks hold at most `BLOCK_BYTES` of
text (or one longer text), which bounds a worker's memory whatever the batch or partition holds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 2_000_000
BROADCAST_BYTES = 16_000_000
HOT_SHARE, HOT_ROWS = 512, 10_000

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C13  # 3 mod 8: as few factors of two in base-1 as an odd base can have
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+` as a table of separator bytes.
SPACE_SEP = np.zeros(256, bool)
SPACE_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing) as a table of separator bytes.
ALNUM_SEP = np.zeros(256, bool)
ALNUM_SEP[0x00:0x30] = ALNUM_SEP[0x3A:0x61] = ALNUM_SEP[0x7B:0x80] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors.

    Rows go to Python workers in batches of about batch_bytes at most (or one larger row); without it only their number is bounded.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Nothing reads the shuffles of a written table again, so their files go as soon as it stands.
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_bytes is not None:
        held["spark.sql.execution.arrow.maxBytesPerBatch"] = str(batch_bytes)
    before = {key: spark.conf.get(key, None) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def held_out(doc_id: Column, mod: int) -> Column:
    return id_remainder(doc_id, mod) == 2


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; beyond that the join is left to shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows, found without counting beyond them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_light(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows, of so many bytes each besides 32, take at most limit; beyond that the join is left to shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes + 32)).first()[0] or 0) <= limit else df


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold more than one in `HOT_SHARE` of the rows each, fewer than `HOT_SHARE` of them; small tables have none."""
    total = rows.count()
    if total < HOT_ROWS:
        return []
    return [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * HOT_SHARE > total).collect()]


def spread_join(rows: DataFrame, other: DataFrame, key: str, hot: list, how: str = "inner", other_bytes: Column | None = None) -> DataFrame:
    """rows joined (inner or left) with other, whose keys are distinct; rows of hot keys are not brought together.

    They meet a broadcast of other's rows, fewer than `HOT_SHARE` of fixed size, or of other_bytes each, which
    then decide whether there is a broadcast. The remaining rows are joined as usual. rows is read twice.
    """
    if not hot:
        return rows.join(other, key, how)
    is_hot = F.coalesce(F.col(key).isin([bytes(k) if isinstance(k, bytearray) else k for k in hot]), F.lit(False))
    few = other.where(is_hot)
    few = F.broadcast(few) if other_bytes is None else broadcast_if_light(few, other_bytes)
    return rows.where(is_hot).join(few, key, how).unionByName(rows.where(~is_hot).join(other.where(~is_hot), key, how))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a copy)."""
    x = x.copy()
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def blocks(array: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string or binary array into (first row, bytes, offsets) of bounded size; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    if not len(array):
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(array):
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(len(array), max(at + 1, to))
        yield at, data[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at]).astype(np.int64)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a block, and where each text's words begin (one more entry than texts)."""
    word = ~sep[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends = word
    ends[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, the same wherever a word stands."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * down[starts]
    return mix(found + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def hash_words(words: list[str]) -> np.ndarray:
    """word_hashes of given words."""
    raw = [w.encode() for w in words]
    at = np.cumsum([0, *map(len, raw)])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])


_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n-word shingle in text order, and each text's bounds; a shorter text is one shingle."""
    sizes = np.diff(bounds)
    total = np.zeros(max(0, len(words)), np.uint64)
    for k in range(n):
        total[: len(words) - k] += words[k:] * _SHINGLE[k]
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)
    found = total[at]
    for k in np.flatnonzero((sizes > 0) & (sizes < n)):
        own = words[bounds[k] : bounds[k + 1]]
        found[out[k]] = (np.append(own, _U(1)) * np.append(_SHINGLE[: len(own)], _SHINGLE[32 + len(own)])).sum(dtype=np.uint64)
    return mix(found), out


def text_shingles(array: pa.Array, n: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, shingle hashes, bounds) of the lower-cased, space-separated words of an array, in blocks."""
    for at, data, offsets in blocks(array):
        data = LOWER[data]
        starts, ends, bounds = word_spans(data, offsets, SPACE_SEP)
        yield at, len(offsets) - 1, *shingle_hashes(word_hashes(data, starts, ends), bounds, n)


def binary_rows(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column of distinct longs, and its name: doc_id where that is one; others follow the largest.

    Of rows that share a doc_id the first by text keeps it; rows with a null doc_id have none to keep.
    """
    name = f"row_{uuid.uuid4().hex}"
    rows = docs.withColumn(name, F.col("doc_id").cast("long"))
    if rows.groupBy(name).count().where(F.col(name).isNull() | (F.col("count") > 1)).isEmpty():
        return rows, name
    low, high = rows.agg(F.min(name), F.max(name)).first()
    if (high or 0) < 2**62:
        base = (high or 0) + 1
    elif low > 0:
        base = -(2**62)
    else:
        raise ValueError("no room for ids of rows that have none of their own")
    nth = F.row_number().over(Window.partitionBy(name).orderBy("text"))
    own = rows.where(F.col(name).isNotNull()).withColumn(name, F.when(nth == 1, F.col(name)))
    every = own.unionByName(rows.where(F.col(name).isNull()))
    return materialize(every.withColumn(name, F.coalesce(F.col(name), F.lit(base) + F.monotonically_increasing_id())), "rows"), name


def cut_words(docs: DataFrame, marks: DataFrame, key: str, sep: np.ndarray, follow: bool) -> DataFrame:
    """docs without the words of marks(id, spans array of (a, b)), sorted word ranges [a, b) of the row whose key is id.

    follow: the separators after a range go with it; else a space takes the range's place. Ranges beyond a
    text's end stop there. n_chars follows the text where it is a column; rows without marks stay as they are.
    """
    marks = materialize(marks, "marks")
    ident, spans = f"id_{uuid.uuid4().hex}", f"spans_{uuid.uuid4().hex}"
    named = broadcast_if_light(marks.select(F.col("id").alias(ident), F.col("spans").alias(spans)), 16 * F.size(spans))
    columns = docs.columns
    joined = docs.join(named, F.col(key) == F.col(ident), "left").select(*columns, spans)
    clean, dirty = joined.where(F.col(spans).isNull()).select(columns), joined.where(F.col(spans).isNotNull())

    def run(batches):
        for batch in batches:
            texts, found = batch.column(columns.index("text")), batch.column(len(columns))
            out = []
            for at, data, offsets in blocks(texts):
                starts, ends, bounds = word_spans(LOWER[data], offsets, sep)
                for k in range(len(offsets) - 1):
                    first, stop = starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]]
                    parts, last, end = [], int(offsets[k]), int(offsets[k + 1])
                    for span in found[at + k].as_py():
                        a, b = span["a"], min(span["b"], len(first))
                        if a >= b:
                            continue
                        parts.append(data[last : max(int(first[a]), last)].tobytes())
                        past = int(stop[b - 1]) if not follow else int(first[b]) if b < len(first) else end
                        last = max(past, last)
                    parts.append(data[last:end].tobytes())
                    out.append((b"" if follow else b" ").join(parts).decode().strip())
            arrays = [pa.array(out, batch.column(j).type) if c == "text" else pa.array(map(len, out), batch.column(j).type) if c == "n_chars" else batch.column(j) for j, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return clean.unionByName(dirty.mapInArrow(run, clean.schema))
