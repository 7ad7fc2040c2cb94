"""Operator 2: best-fit packing of documents into training sequences, as vector bin packing.

A document becomes its token ids and an end id; one longer than a sequence is cut into full pieces,
of which the first may be shorter. A bin has three capacities: tokens, documents and attention cost
(the sum of squared piece lengths). Pieces of equal length are alike, so the plan is made on counts
by length, longest first: at most `tokens` counts reach the driver whatever the corpus holds. Among
the bins that can take a piece under every constraint, the one with the best score gets it: the
weighted norm of what would stay free ("norm", smallest) or the weighted dot product of demand and
free capacity ("dot", largest). Bins that took the same pieces are handled together. A placement says which
ranks of a length go to which bins; each piece's rank is its place among those of its length, from
counts by input partition, so no task sees all pieces of a length.

Rows: one for each piece; null text is an empty document (its end id alone); null or repeated
doc_ids are packed row by row. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import materialize

TOKENS, END_ID = 1024, 2
_MARK = "<|endoftext|>"  # a special token of the vocabulary: in a text, the tokenizer takes it for its id
LONG_SPACE = 20_000  # characters of white space in a row that are encoded apart
#: The characters that \\s of the tokenizer's pattern means.
_LONG = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_SPACE)
_ENCODERS: dict[str, tuple] = {}


def encoder(path: str):
    """Encodes text as the tokenizers file at path does (byte-level BPE); its ranks are built once a process."""
    if path not in _ENCODERS:
        if path.endswith(".json"):
            import tokenizers

            tool = tokenizers.Tokenizer.from_file(path)
            vocabulary = tool.get_vocab(with_added_tokens=False)
            plain = {chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None: b for b in range(256)}
            rest = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
            plain |= {chr(256 + k): b for k, b in enumerate(rest)}
            ranks = {bytes(plain[c] for c in token): k for token, k in vocabulary.items() if token != _MARK}
            mark = tool.token_to_id(_MARK)
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            mark = None
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), mark
    tool, mark = _ENCODERS[path]

    def plain(text: str) -> list[int]:
        """A run of white space is one piece but for its last character before something else; the pattern's matcher overflows on very long ones."""
        out, at = [], 0
        if len(text) > LONG_SPACE:
            for run in _LONG.finditer(text):
                end = run.end() - (run.end() < len(text))
                out += tool.encode_ordinary(text[at : run.start()]) + tool._encode_single_piece(text[run.start() : end])
                at = end
        return out + tool.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        if mark is None or _MARK not in text:
            return plain(text)
        out: list[int] = []
        for k, part in enumerate(text.split(_MARK)):
            out += ([mark] if k else []) + plain(part)
        return out

    return encode


def tokenized_pieces(docs: DataFrame, vocabulary: str, tokens: int = TOKENS, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> pieces (doc_id, piece, start, length, ids_crc32[, ids binary], part, place), written to the shared folder.

    part and place: the input partition and the piece's place there among those of its length.
    """

    def run(batches):
        encode = encoder(vocabulary)
        part, seen = TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                some = batch.slice(at, 500)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), END_ID], "<u4")
                    first = len(ids) % tokens or tokens
                    cuts = [0, *range(first, len(ids) + 1, tokens)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        raw = ids[a:b].tobytes()
                        rows.append((doc_id, k, a, b - a, zlib.crc32(raw), raw if keep_ids else None, part, int(seen[b - a])))
                        seen[b - a] += 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "place"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, place long"
    )
    return materialize(found if keep_ids else found.drop("ids"), "pieces")


def plan(counts: dict[int, int], tokens: int = TOKENS, documents: int = TOKENS, attention: int = TOKENS**2, rule: str = "norm", weights=(1.0, 1e-4, 1e-4)) -> np.ndarray:
    """Placements (length, rank, bin, bins, copies, offset): ranks rank.. of a length, `copies` to each of bins bin.., from offset on.

    counts: pieces by length, each of which must fit into an empty bin.
    """
    capacity, weight = np.array([tokens, documents, attention], float), np.array(weights)
    free, size, start = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        demand = np.array([length, 1, length * length], float)
        if (demand > capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds a bin's capacities")
        while left:
            able = np.flatnonzero((free >= demand).all(1))
            if len(able):
                after = (free[able] - demand) / capacity
                score = (weight * after**2).sum(1) if rule == "norm" else -(weight * (demand / capacity) * (free[able] / capacity)).sum(1)
                at = able[int(score.argmin())]
            else:
                most = int(min(capacity // demand))
                free = np.vstack([free, capacity])
                size, start = np.append(size, -(-left // most)), np.append(start, bins)
                bins += int(size[-1])
                at = len(size) - 1
            copies = int(min(free[at] // demand))
            copies = min(copies, left) if left < copies else copies
            used = min(int(size[at]), left // copies)
            out.append((length, rank, int(start[at]), used, copies, int(tokens - free[at][0])))
            if used < size[at]:  # the rest of the bins stays as it is
                free, size, start = np.vstack([free, free[at]]), np.append(size, size[at] - used), np.append(start, start[at] + used)
                size[at] = used
            free[at] = free[at] - copies * demand
            left, rank = left - used * copies, rank + used * copies
        # Bins that can take nothing more need no entry.
        keep = (free[:, 0] > 0) & (free[:, 1] > 0) & (free[:, 2] > 0)
        free, size, start = free[keep], size[keep], start[keep]
    return np.array(out, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, tokens: int = TOKENS, **limits) -> DataFrame:
    """Adds sequence_id and offset to tokenized_pieces' rows (part and place go)."""
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most `tokens` rows
    placed = plan(counts, tokens, **limits)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast(placed)
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place")).drop("part", "place", "base")

    def run(batches):
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            nth = rank - row[1]
            names = [c for c in batch.schema.names if c != "rank"]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(row[2] + nth // row[4]), pa.array(row[5] + nth % row[4] * length)], [*names, "sequence_id", "offset"])

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, tokens: int = TOKENS, keep_ids: bool = False, **limits) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), a row for each piece."""
    found = pack(tokenized_pieces(docs, vocabulary, tokens, keep_ids), tokens, **limits)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset")
