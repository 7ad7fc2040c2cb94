"""Operator 5: benchmark decontamination with one FM-index per training shard.

A shard is about `SHARD_WORDS` words of whole documents (one longer document is a shard of its own).
Its words get ranks, the word string a suffix array (prefix doubling on the still tied suffixes), the
Burrows-Wheeler string a wavelet matrix. All test phrases of a block search backwards together
through the wavelet ranks; occurrences are located by walking to sampled suffix positions, and the
spans that they cover are merged per document. Documents are not shuffled: index, search and merge
happen where the text was read.

Test phrases are broadcast in blocks of at most `BLOCK_WINDOWS` windows and `PASS_BLOCKS` blocks a
pass; a larger benchmark takes more passes, whose spans are merged by row.

Rows: one for each row of docs. Null or wordless text has no words and no hits; repeated rows give
repeated results; items with null id or null text have no windows; an item of fewer words than a
window is one window. An empty table on either side is fine. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import ALNUM_SEP, LOWER, blocks, cut_words, with_row_ids, word_hashes, word_spans

WINDOW, SHARD_WORDS, SAMPLE = 10, 600_000, 16
BLOCK_WINDOWS, PASS_BLOCKS = 50_000, 8
SCHEMA = "doc_id long, n_words long, span_starts array<long>, span_ends array<long>, items array<long>, text_key binary"


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of an array of small non-negative integers; a shorter suffix comes first."""
    n = len(symbols)
    width = max(1, int(symbols.max(initial=0) + 1).bit_length())
    pack = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for k in range(pack):
        key <<= width
        key[: max(0, n - k)] |= symbols[k:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def ranks(rows: np.ndarray, new: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Gives rows (in order) the position of their group's first row; returns which rows are tied."""
        first = np.flatnonzero(new)
        rank[rows] = np.repeat(base[first], np.diff(np.append(first, len(rows))))
        alone = new & np.append(new[1:], True)
        return ~alone

    ordered = key[order]
    tied = ranks(order, np.append(True, ordered[1:] != ordered[:-1])[:n], np.arange(n))
    at = np.flatnonzero(tied)
    h = pack
    while len(at):
        rows = order[at]
        ahead = np.where(rows + h < n, rank[np.minimum(rows + h, n - 1)], -1)
        own = rank[rows]
        sub = np.lexsort((ahead, own))
        rows, ahead, own = rows[sub], ahead[sub], own[sub]
        order[at] = rows
        new = np.append(True, (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1]))
        at = at[ranks(rows, new, at)]
        h *= 2
    return order


class FMIndex:
    """Backward search and location over a string of integers in which 0 never occurs in a pattern."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        # The end mark is unique, else walking back over the start would not meet its row.
        symbols = np.append(symbols + 1, 0)
        order = suffix_array(symbols)
        n = self.n = len(symbols)
        bwt = symbols[order - 1].astype(np.int64)
        self.top = int(symbols.max(initial=0)) - 1
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << 1))])
        self.ones, self.zeros = [], []
        for b in range(self.levels - 1, -1, -1):
            bit = ((bwt >> b) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        kept = order % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.positions = order[kept]

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the symbols before rows at, in the Burrows-Wheeler string."""
        zero = np.zeros_like(at)
        for k in range(self.levels):
            bit = (symbols >> (self.levels - 1 - k)) & 1 == 1
            one, base = self.ones[k], self.zeros[k]
            at, zero = (np.where(bit, base + one[x], x - one[x]) for x in (at, zero))
        return at - zero

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of right-aligned patterns; those with a symbol below 1 or not in the text are absent."""
        width = patterns.shape[1]
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        inside = np.arange(width)[None, :] >= (width - lengths)[:, None]
        high[(((patterns < 1) | (patterns > self.top)) & inside).any(1)] = 0
        for step in range(width):
            on = np.flatnonzero((lengths > step) & (high > low))
            if not len(on):
                break
            c = patterns[on, width - 1 - step] + 1
            both = self._down(np.concatenate([c, c]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = self.smaller[c] + both[: len(on)], self.smaller[c] + both[len(on) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to sampled ones."""
        out = np.empty(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.kept[rows + 1] > self.kept[rows]
            out[left[done]] = self.positions[self.kept[rows[done]]] + steps
            left, rows, steps = left[~done], rows[~done], steps + 1
            symbol, at, zero = np.zeros_like(rows), rows, np.zeros_like(rows)
            for k in range(self.levels):
                one, base = self.ones[k], self.zeros[k]
                bit = one[at + 1] > one[at]
                symbol = symbol * 2 + bit
                at, zero = (np.where(bit, base + one[x], x - one[x]) for x in (at, zero))
            rows = self.smaller[symbol] + at - zero
        return out


def _windows(texts: list[str], ids: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right-aligned word hashes, lengths and item ids of all windows of items."""
    rows, lengths, owners = [], [], []
    at = 0
    for _, data, offsets in blocks(pa.array(texts, pa.string())):
        data = LOWER[data]
        starts, ends, bounds = word_spans(data, offsets, ALNUM_SEP)
        hashes = word_hashes(data, starts, ends)
        for k in range(len(offsets) - 1):
            own = hashes[bounds[k] : bounds[k + 1]]
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                row = np.zeros(window, np.uint64)
                row[window - size :] = own[i : i + size]
                rows.append(row)
                lengths.append(size)
                owners.append(ids[at + k])
        at += len(offsets) - 1
    return np.array(rows, np.uint64).reshape(-1, window), np.array(lengths, np.int64), np.array(owners, np.int64)


def _benchmark_blocks(bench: DataFrame, window: int):
    """Blocks of windows, read item by item, so the driver holds one pass's windows at most."""
    texts, ids, words = [], [], 0
    for row in bench.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        words += len(row[1]) // 2 + 1
        if words >= BLOCK_WINDOWS:
            yield _windows(texts, ids, window)
            texts, ids, words = [], [], 0
    yield _windows(texts, ids, window)


def _scan(pass_blocks):
    def shard(ids, words, bounds, keys):
        n_docs = len(bounds) - 1
        sizes = np.diff(bounds)
        spans_of, items_of = [([], []) for _ in range(n_docs)], [[] for _ in range(n_docs)]
        if len(words):
            vocabulary, symbols = np.unique(words, return_inverse=True)
            # A 0 stands after each document, so no occurrence runs over its end.
            text = np.zeros(len(words) + n_docs, np.int64)
            text[np.arange(len(words)) + np.repeat(np.arange(n_docs), sizes)] = symbols + 1
            starts = bounds[:-1] + np.arange(n_docs)
            index = FMIndex(text)
            cover = np.zeros(len(text) + 1, np.int64)
            met = []
            for block in pass_blocks:
                patterns, lengths, owners = block.value
                if not len(patterns):
                    continue
                near = np.minimum(np.searchsorted(vocabulary, patterns), len(vocabulary) - 1)
                low, high = index.search(np.where(vocabulary[near] == patterns, near + 1, 0), lengths)
                found = high - low
                hit = np.flatnonzero(found)
                if not len(hit):
                    continue
                counts = found[hit]
                rows = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = index.locate(rows)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + np.repeat(lengths[hit], counts), -1)
                docs = np.searchsorted(starts, at, "right") - 1
                met.append(np.unique(np.stack([docs, np.repeat(owners[hit], counts)]), axis=1))
            if met:
                on = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
                docs = np.searchsorted(starts, edge[::2], "right") - 1
                for d, a, b in zip(docs.tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    spans_of[d][0].append(a - int(starts[d]))
                    spans_of[d][1].append(b - int(starts[d]))
                for d, item in np.unique(np.concatenate(met, 1), axis=1).T.tolist():
                    items_of[d].append(item)
        big = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array([s[0] for s in spans_of], big), pa.array([s[1] for s in spans_of], big), pa.array(items_of, big), pa.array(keys, pa.binary())],
            ["doc_id", "n_words", "span_starts", "span_ends", "items", "text_key"],
        )

    def run(batches):
        ids, words, sizes, keys, held = [], [], [], [], 0

        def flush():
            out = shard(pa.concat_arrays(ids), np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), keys)
            ids.clear(), words.clear(), sizes.clear(), keys.clear()
            return out

        for batch in batches:
            for at, data, offsets in blocks(batch.column(1)):
                raw = data
                data = LOWER[data]
                starts, ends, bounds = word_spans(data, offsets, ALNUM_SEP)
                ids.append(batch.column(0).slice(at, len(offsets) - 1).cast(pa.int64()))
                words.append(word_hashes(data, starts, ends))
                sizes.append(np.diff(bounds))
                keys += [hashlib.md5(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] if len(pass_blocks) and run.keyed else [None] * (len(offsets) - 1)
                held += len(starts)
                if held >= SHARD_WORDS:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    run.keyed = False
    return run


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text), bench(item_id, text) -> (doc_id, n_words, span_starts, span_ends, items), a row for each row of docs.

    Spans are merged word ranges [start, end) inside occurrences; items the ids found, ascending.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext
    passes, now = [], []
    for block in _benchmark_blocks(bench, window):
        now.append(sc.broadcast(block))
        if len(now) == PASS_BLOCKS:
            passes.append(now)
            now = []
    if now or not passes:
        passes.append(now)
    scans = []
    for blocks_now in passes:
        scan = _scan(blocks_now)
        scan.keyed = len(passes) > 1
        scans.append(docs.mapInArrow(scan, SCHEMA))
    if len(scans) == 1:
        return scans[0].drop("text_key")
    every = scans[0]
    for scan in scans[1:]:
        every = every.union(scan)
    spans = F.flatten(F.collect_list(F.arrays_zip("span_starts", "span_ends")))
    merged = every.groupBy("doc_id", "text_key").agg(
        (F.count("*") / len(scans)).cast("int").alias("copies"), F.first("n_words").alias("n_words"), F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    joined = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<span_starts:bigint,span_ends:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1).span_ends >= s.span_starts), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).span_starts.alias("span_starts"), F.greatest(F.element_at(acc, -1).span_ends, s.span_ends).alias("span_ends"))))).otherwise(F.concat(acc, F.array(s))),
    )
    out = merged.withColumn("spans", joined).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("doc_id", "n_words", F.col("spans.span_starts").alias("span_starts"), F.col("spans.span_ends").alias("span_ends"), "items")


def contamination_report(found: DataFrame) -> DataFrame:
    """The digest of find_contamination's rows."""
    hit = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    names = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def remove_spans(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Docs with the text of their spans cut out (each replaced by one space); n_chars follows where it is a column.

    Rows meet by the column key, whose values must be distinct; rows that have no spans stay as they are.
    """
    spans = F.zip_with("span_starts", "span_ends", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    marks = found.where(F.size("span_starts") > 0).select(F.col("doc_id").alias("id"), spans.alias("spans"))
    return cut_words(docs, marks, key, ALNUM_SEP, follow=False)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Docs without what they hold of bench; each row is a document of its own, also one with a null or repeated doc_id."""
    rows, key = with_row_ids(docs)
    found = find_contamination(rows.select(F.col(key).alias("doc_id"), "text"), bench, window)
    return remove_spans(rows, found, key).select(docs.columns)
