"""Operator 4: MinHash near-duplicates by tensored banding.

Two small collections of bands are computed, `BANDS` left and `BANDS` right ones of `ROWS` minima
each. A table of the usual scheme is a (left, right) pair: `BANDS`**2 tables come from
2 * `BANDS` * `ROWS` minima, about the square root of what they would cost apart. Only left keys are
shuffled; the right keys ride along, so a table key is formed where a left key has partners.

A pair at similarity s meets in some table with (1 - (1 - s**ROWS)**BANDS)**2, 0.9997 at 0.75.
Every candidate is verified on full shingle sets. Documents with equal sets form a class first.
Two rounds link every member of a left group to one hub (linear in the rows); after them, whatever
still lies in different components of a table bucket is compared by odd sketches: the ones in the XOR
of two sketches count at most the sets' symmetric difference, and where a sketch is crowded the
expected count plus `SIGMAS` deviations is the bound. Pairs within it are verified. Left keys, classes
and hubs that hold many rows are joined without bringing these rows together (`common.spread_join`).

Rows: null or wordless text has an empty set and is linked with nothing; rows with a null doc_id
take no part in links (component_id null, kept true); rows with the same doc_id are one document.
Columns beyond doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import HOT_ROWS, HOT_SHARE, binary_rows, broadcast_if_small, hot_keys, materialize, mix, spread_join, text_shingles, with_row_ids
from vertexloom.llm.components import connected_components

BANDS, ROWS, SHINGLE, PERCENT = 16, 3, 5, 75
SKETCH_BITS, SIGMAS = 1024, 6
BROADCAST_IDS = 500_000  # ids (8 bytes each) that a broadcast may hold; beyond it the join shuffles
_SEEDS = np.random.default_rng(4).integers(1, 2**63, (2, 2 * BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNATURE = "doc_id long, n_shingles long, cls binary, left_keys array<long>, right_keys array<int>"


def _minima(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, hashes) minima; texts without shingles must not be there."""
    out = np.empty((len(bounds) - 1, _SEEDS.shape[1]), np.uint64)
    for k in range(_SEEDS.shape[1]):
        h = sets * _SEEDS[0, k]
        h ^= h >> np.uint64(32)
        h *= _SEEDS[1, k]
        out[:, k] = np.minimum.reduceat(h, bounds[:-1])
    return out


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, with their bounds."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(parts or [hashes[:0]]), np.cumsum([0, *map(len, parts)])


def _signatures(batches):
    for batch in batches:
        ids = batch.column(0)
        for at, rows, hashes, bounds in text_shingles(batch.column(1), SHINGLE):
            sets, bounds = distinct_sets(hashes, bounds)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            left, right, cls = [None] * rows, [None] * rows, [None] * rows
            if len(full):
                starts = bounds[:-1][full]
                minima = _minima(sets, np.append(starts, len(sets)))
                bands = np.zeros((len(full), 2 * BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + minima[:, r :: ROWS])
                bands = mix(bands + np.arange(2 * BANDS, dtype=np.uint64))
                lk = bands[:, :BANDS].view(np.int64)
                rk = bands[:, BANDS:].astype(np.uint32).view(np.int32)
                two = [np.add.reduceat(mix(sets ^ np.uint64(s)), starts) for s in (0x1234567, 0x89ABCDEF01)]
                both = np.stack(two, 1)
                for j, k in enumerate(full):
                    left[k], right[k], cls[k] = lk[j], rk[j], both[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, rows), pa.array(sizes, pa.int64()), binary_rows(cls), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "cls", "left_keys", "right_keys"],
            )


def _odd_sketch(own: np.ndarray) -> np.ndarray:
    bits = np.bincount((own >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(batches):
    for batch in batches:
        for at, rows, hashes, bounds in text_shingles(batch.column(1), SHINGLE):
            sets, bounds = distinct_sets(hashes, bounds)
            own = [sets[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, rows), binary_rows([x.tobytes() for x in own]), pa.array([_odd_sketch(x) for x in own], pa.list_(pa.int64()))], ["id", "shingles", "sketch"]
            )


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, last, left = [], None, None
            for x, y in zip(a, b, strict=True):
                if x is not last:
                    last, left = x, np.frombuffer(x, np.uint64)
                right = np.frombuffer(y, np.uint64)
                small, large = (left, right) if len(left) < len(right) else (right, left)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                same = int((large[at] == small).sum())
                keep.append(100 * same >= percent * (len(left) + len(right) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    hubs = hot_keys(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    both = spread_join(pairs, right, "b", hubs, other_bytes=F.length("sb"))
    both = spread_join(both, left, "a", hubs, other_bytes=F.length("sa")).select("a", "b", "sa", "sb")
    return both.mapInArrow(_linked(percent), "a long, b long")


def _hub_pairs(bands: DataFrame, hot: list, salt: int, percent: int) -> DataFrame:
    """Each member of a left group with the group's hub, where some right key agrees and sizes allow a link."""
    hub = F.min(F.struct(F.xxhash64("rep", F.lit(salt)).alias("p"), "rep", "n", "right_keys", "label"))
    hubs = bands.groupBy("lk").agg(hub.alias("h"))
    met = F.exists(F.zip_with("right_keys", "h.right_keys", lambda x, y: x == y), lambda x: x)
    rows = spread_join(bands, hubs, "lk", hot).where("label <> h.label").where(f"100 * least(n, h.n) >= {percent} * greatest(n, h.n)").where(met)
    return rows.select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b")).distinct()


def _rest_pairs(bands: DataFrame, hot: list, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that share a table bucket, still lie in different components and may be near enough by their sketches."""
    mixed = bands.groupBy("lk").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("lk")
    rows = spread_join(bands, mixed, "lk", hot).select("rep", "n", "label", "li", "lk", F.posexplode("right_keys").alias("j", "rk"))
    rows = rows.select("rep", "n", "label", "li", "j", F.xxhash64("lk", "j", "rk").alias("bucket"))
    split = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    rows = materialize(rows.join(split, "bucket"), "buckets")
    rows = rows.join(sketches, rows.rep == sketches.id).drop("id")
    ones = " + ".join(f"bit_count(x.sketch[{k}] ^ y.sketch[{k}])" for k in range(SKETCH_BITS // 64))
    apart = f"((x.n + y.n) * {100 - percent} / {100 + percent}.0D)"
    crowded = f"({SKETCH_BITS / 2} * (1 - exp(-{2 / SKETCH_BITS} * {apart})) + {SIGMAS * SKETCH_BITS**0.5 / 2})"
    x, y = rows.alias("x"), rows.alias("y")
    near = f"x.bucket = y.bucket and x.label < y.label and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and ({ones}) <= least({apart} + 1e-6, {crowded})"
    # A pair that meets in several buckets counts in the first of them.
    near += "".join(f" and array_position(zip_with(x.{keys}, y.{keys}, (u, v) -> u = v), true) = x.{at} + 1" for keys, at in (("left_keys", "li"), ("right_keys", "j")))
    return x.join(y, F.expr(near)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = materialize(docs.mapInArrow(_signatures, _SIGNATURE), "signatures")
    own = sig.where("doc_id is not null and n_shingles > 0")
    first = F.min_by(F.struct("n_shingles", "left_keys", "right_keys"), "doc_id")
    classes = materialize(own.groupBy("cls").agg(F.min("doc_id").alias("rep"), first.alias("s"), F.count("*").alias("members")), "classes")
    total = classes.agg(F.sum("members")).first()[0] or 0
    copied = classes.where(F.lit(total >= HOT_ROWS) & (F.col("members") * HOT_SHARE > total)).select("cls", "rep").collect()
    bands = classes.select("rep", F.col("s.n_shingles").alias("n"), F.col("s.right_keys").alias("right_keys"), F.posexplode("s.left_keys").alias("li", "lk"))
    shared = bands.groupBy("lk").agg(F.count("*").alias("members")).where("members > 1").select("lk")
    hot = hot_keys(bands, "lk")
    bands = materialize(spread_join(bands, shared, "lk", hot), "bands")

    ids = materialize(bands.select("rep").distinct(), "candidates")
    wanted = ids.select(F.col("rep").alias("doc_id"))
    found = docs.join(broadcast_if_small(wanted, BROADCAST_IDS), "doc_id")
    sets = materialize(found.select("doc_id", "text").mapInArrow(_sets, "id long, shingles binary, sketch array<long>"), "sets")

    keys = classes.select(F.col("rep").alias("key_id"), "s.left_keys", "s.right_keys")
    profiles = sets.select("id", "sketch").join(keys, F.col("id") == F.col("key_id")).drop("key_id")
    same = spread_join(own.select("cls", F.col("doc_id").alias("b")), classes.select("cls", F.col("rep").alias("a")), "cls", [r.cls for r in copied]).where("a < b").select("a", "b")
    links, done, labels = None, None, None
    for step in range(3):
        now = bands.withColumn("label", F.col("rep")) if labels is None else bands.join(labels, bands.rep == labels.id, "left").select(*bands.columns, F.coalesce("label", "rep").alias("label"))
        pairs = _hub_pairs(now, hot, step, percent) if step < 2 else _rest_pairs(now, hot, profiles, percent)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        good = materialize(_verify(pairs, sets, percent), "links")
        links = good if links is None else links.union(good)
        done = pairs if done is None else done.union(pairs)
        labels = connected_components(links)
    # An id whose rows have different sets joins their classes.
    if not (twice := own.groupBy("doc_id").agg(F.countDistinct("cls").alias("n")).where("n > 1").select(F.col("doc_id").alias("b"))).isEmpty():
        labels = connected_components(links.union(same).union(same.join(twice, "b").select("a", "b")))
    # Rows that share a class follow the class's first id.
    firsts = spread_join(same, labels.withColumnRenamed("id", "a"), "a", [r.rep for r in copied], "left").select(F.col("b").alias("id"), F.coalesce("label", "a").alias("label"))
    labels = materialize(labels.union(firsts).groupBy("id").agg(F.min("label").alias("label")), "labels")
    out = sig.join(labels, sig.doc_id == labels.id, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id.

    Each row is a document of its own, also one with a null or repeated doc_id: such rows stay unless their
    text is a near-duplicate of one that does.
    """
    rows, key = with_row_ids(docs)
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), percent)
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias(key)), "gone")
    return rows.join(broadcast_if_small(gone, BROADCAST_IDS), key, "left_anti").select(docs.columns)
