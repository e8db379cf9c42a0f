"""Packing of documents into training sequences: first-fit decreasing in randomised groups.

A document's ids (with an end id) are cut into pieces of at most the capacity; pieces are dealt
at random into groups of about group_pieces, and each group is packed on its own: pieces in
decreasing length, each into the first sequence with room, which a tournament tree over the
sequences' free capacities finds in logarithmic time. No group grows with the data.

A null text is empty and gives the end id alone. Repeated rows are packed as rows of their own;
ties in length go by id, then by start. An empty table gives an empty result. Further columns of
documents are ignored, those of given pieces are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citytables.llm.common import fields, free_names, pieces, tidy, tidy_group, written
from citytables.llm.tokens import BATCH_BYTES, encoder, with_end

CAPACITY = 1024
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_LOCAL_BITS = 24


class Tournament:
    """Free capacities of bins at the leaves; each inner node holds the larger of its children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take size from the first bin with room; there is one, as there are as many bins as items."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        bin_ = at - self.leaves
        free[at] -= size
        at //= 2
        while at:
            a, b = free[2 * at], free[2 * at + 1]
            free[at] = a if a > b else b
            at //= 2
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset in it) of each item, items taken from the longest; equal ones in the given order."""
    tree = Tournament(len(lengths), capacity)
    filled: dict[int, int] = {}
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = tree.first_fit(lengths[i])
        at = filled.get(b, 0)
        out[i] = (b, at)
        filled[b] = at + lengths[i]
    return out


def _cut(path, special, end_id, capacity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special)
        for b in pieces(batches, "text", BATCH_BYTES):
            ids, ends = with_end(*enc.encode(b.column("text")), end_id)
            data, begin, rows = ids.astype("<u4").tobytes(), 0, []
            for doc, end in zip(b.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                for a in range(begin, end, capacity):
                    z = min(a + capacity, end)
                    rows.append((doc, a - begin, z - a, zlib.crc32(data[4 * a : 4 * z]), end - begin))
                begin = end
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, end_id: int = 0, capacity: int = CAPACITY, vocabulary: str | None = None, special: bool = True) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32 (of the ids as little-endian 32-bit), doc_tokens.

    special: whether the strings of special tokens in a text stand for those tokens.
    """
    return docs.select("doc_id", "text").mapInArrow(tidy(_cut(vocabulary, special, end_id, capacity)), PIECES)


def _packed(capacity, row, group_of):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), (row, "ascending")])
        placed = first_fit_decreasing(group.column("length").to_pylist(), capacity)
        base = group.column(group_of)[0].as_py() << _LOCAL_BITS
        own = group.drop_columns([row, group_of])
        return own.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return run


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = 4096, seed: int = 11) -> DataFrame:
    """piece_rows (doc_id, start, length and more) with sequence_id and offset; no sequence exceeds capacity."""
    stored = written(piece_rows, "pack-pieces")
    groups = max(1, -(-stored.count() // group_pieces))
    row, group_of = free_names(stored.columns, "__row", "__group")
    dealt = stored.withColumn(row, F.monotonically_increasing_id()).withColumn(group_of, F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(groups)))
    return dealt.groupBy(group_of).applyInArrow(tidy_group(_packed(capacity, row, group_of)), f"{fields(stored.schema)}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, end_id: int = 0, capacity: int = CAPACITY, vocabulary: str | None = None, special: bool = True) -> DataFrame:
    """Every document cut and packed."""
    return pack(token_pieces(docs, end_id, capacity, vocabulary, special), capacity)


def padding(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Padding ids that sequences of these lengths need: none at a power of two, else up to the capacity."""
    whole = (lengths & (lengths - 1)) == 0
    return int(np.where(whole, 0, capacity - lengths).sum())
