"""Benchmark decontamination by FM-indexes over shards of the training text.

Benchmark items become windows of words. Each task builds FM-indexes over its shard of training
words, backward-searches all windows through wavelet-tree ranks, locates the occurrences by
sampled suffix positions and merges them into removal spans; there is no shuffle. Words that no
benchmark item has can't be part of an occurrence: a run of them stands in the indexed text as one separator,
which loses nothing. With narrow, words of which no pair of neighbours stands in any window are left out of
the index too; that loses nothing either and costs less, but then the pairs do most of the search.

The benchmark is read in blocks of at most block_windows windows (a longer item in overlapping slices), so
what is broadcast and held has a fixed size; with several blocks the documents pass once for each.

Null texts have no words. An item without words has no window; one of fewer words than a window
is a window itself; an item without id has the empty string for one. Ties and repeated rows are found each on
their own. Empty tables: nothing is hit. The digest of no items is that of the empty string. Further
columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citytables.llm.common import fields, free_names, lower_ascii, pieces, tidy, written
from citytables.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
SHARD_WORDS = 1 << 19


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text or ""))


class Windows:
    """The windows of some benchmark items, by length, over numbered words (from 1)."""

    def __init__(self, items: list[tuple[str, list[str]]], size: int):
        self.number: dict[str, int] = {}
        grouped: dict[int, dict[tuple, list[int]]] = {}
        self.items: list[str] = []
        for item, words in items:
            if not words:
                continue
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words]
            n = min(size, len(w))
            self.items.append(item)
            for i in range(len(w) - n + 1):
                own = grouped.setdefault(n, {}).setdefault(tuple(w[i : i + n]), [])
                if not own or own[-1] != len(self.items) - 1:
                    own.append(len(self.items) - 1)
        self.patterns = {n: np.array(list(p), dtype=np.int64) for n, p in grouped.items()}
        self.owners = {n: list(p.values()) for n, p in grouped.items()}
        self.top = len(self.number)
        self.single = np.zeros(self.top + 1, dtype=bool)
        self.pairs = np.zeros(0, dtype=np.int64)
        for n, p in self.patterns.items():
            if n == 1:
                self.single[p[:, 0]] = True
            else:
                self.pairs = np.union1d(self.pairs, (p[:, :-1] * (self.top + 1) + p[:, 1:]).ravel())
        self.shortest = min((n for n in self.patterns if n > 1), default=2)

    def kept(self, ids: np.ndarray, narrow: bool) -> np.ndarray:
        """Which words (0: unknown) go into the index: the known ones, or those that pairs say may lie in an occurrence."""
        if not narrow:
            return ids > 0
        keep = self.single[ids]
        if len(self.pairs) and len(ids) > 1:
            code = ids[:-1] * (self.top + 1) + ids[1:]
            code[(ids[:-1] == 0) | (ids[1:] == 0)] = -1
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            pair = np.concatenate([[False], self.pairs[at] == code, [False]])
            edge = np.flatnonzero(pair[1:] != pair[:-1])  # runs of pairs: [start, end) in pairs
            start, end = edge[::2], edge[1::2]
            long = end - start >= self.shortest - 1
            mark = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(mark, start[long], 1)
            np.add.at(mark, np.minimum(end[long] + 1, len(ids)), -1)
            keep = keep | (np.cumsum(mark[:-1]) > 0)
        return keep


def hits(windows: Windows, ids: np.ndarray, narrow: bool = False) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Hit words of a shard (0 separates documents and unknown words), and starts of each item's occurrences."""
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    items: dict[int, list[int]] = {}
    keep = windows.kept(ids, narrow) if len(ids) else np.zeros(0, dtype=bool)
    place = np.flatnonzero(keep)
    if not len(place):
        return np.zeros(len(ids), dtype=bool), items
    gap = np.concatenate([[False], np.diff(place) > 1])
    at = np.arange(len(place)) + np.cumsum(gap)
    text = np.zeros(at[-1] + 1, dtype=np.int64)
    text[at] = ids[place]
    origin = np.full(len(text), -1, dtype=np.int64)
    origin[at] = place
    index = FMIndex(text, windows.top)
    for n, patterns in windows.patterns.items():
        lo, hi = index.search(patterns)
        which, where = index.occurrences(lo, hi)
        start = origin[where]
        np.add.at(covered, start, 1)
        np.add.at(covered, start + n, -1)
        for p, s in zip(which.tolist(), start.tolist(), strict=True):
            for item in windows.owners[n][p]:
                items.setdefault(item, []).append(s)
    return np.cumsum(covered[:-1]) > 0, items


def _spans(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2).tolist()


def without(text: str, spans: list[list[int]]) -> str:
    """The text less the words of the spans (first word, end word) and what stands between them."""
    if not spans:
        return text
    ends = [m.span() for m in WORD.finditer(lower_ascii(text))]
    out, at = [], 0
    for a, z in spans:
        out.append(text[at : ends[a][0]])
        at = ends[z - 1][1]
    out.append(text[at:])
    return "".join(out)


def _searched(sent, shard_words, narrow, spans_of, items_of, n_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = sent.value
        number = windows.number
        for b in pieces(batches, "text", 8 * shard_words):
            rows = [words_of(t) for t in b.column("text").to_pylist()]
            sizes = np.array([len(w) for w in rows], dtype=np.int64)
            first = np.cumsum(sizes + 1) - sizes - 1  # one separator after each document
            ids = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
            for w, at in zip(rows, first.tolist(), strict=True):
                ids[at : at + len(w)] = [number.get(x, 0) for x in w]
            hit, items = hits(windows, ids, narrow)
            found: list[set[int]] = [set() for _ in rows]
            for item, starts in items.items():
                for d in np.unique(np.searchsorted(first, starts, side="right") - 1):
                    found[d].add(item)
            old_spans, old_items = b.column(spans_of).to_pylist(), b.column(items_of).to_pylist()
            spans, names = [], []
            for d, n in enumerate(sizes.tolist()):
                own = hit[first[d] : first[d] + n]
                if old_spans[d]:
                    own = own.copy()
                    for s in old_spans[d]:
                        own[s["first"] : s["end"]] = True
                spans.append([{"first": x[0], "end": x[1]} for x in _spans(own)] if own.any() else [])
                names.append(sorted({*old_items[d], *(windows.items[i] for i in found[d])}))
            out = {n: b.column(n) for n in b.schema.names}
            out[n_of] = pa.array(sizes, pa.int64())
            out[spans_of] = pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            out[items_of] = pa.array(names, pa.list_(pa.string()))
            yield pa.record_batch(list(out.values()), names=list(out))

    return run


def _blocks(benchmark: DataFrame, size: int, block_windows: int) -> Iterator[Windows]:
    held: list = []
    n = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        words = words_of(r["text"])
        for at in range(0, max(min(1, len(words)), len(words) - size + 1), block_windows):
            held.append((r["item"] or "", words[at : at + block_windows + size - 1]))
            n += max(1, len(held[-1][1]) - size + 1)
            if n >= block_windows:
                yield Windows(held, size)
                held, n = [], 0
    yield Windows(held, size)


def search_benchmark(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = 100_000, shard_words: int = SHARD_WORDS, narrow: bool = False, names: list[str] | None = None
) -> DataFrame:
    """docs with three columns more: number of words, spans (first, end: hit words) and ids, as strings, of items found.

    names: theirs, if docs have n_words, spans or items already.
    """
    spark = docs.sparkSession
    n_of, spans_of, items_of = names or free_names(docs.columns, "n_words", "spans", "items")
    span = "array<struct<first:bigint,end:bigint>>"
    schema = f"{fields(docs.schema)}, `{n_of}` bigint, `{spans_of}` {span}, `{items_of}` array<string>"
    out = docs.withColumns({n_of: F.lit(0).cast("long"), spans_of: F.array().cast(span), items_of: F.array().cast("array<string>")})
    for i, windows in enumerate(_blocks(benchmark, size, block_windows)):
        if i:
            out = written(out, "decontam")
            sent.unpersist()  # noqa: F821 - of the block before
        sent = spark.sparkContext.broadcast(windows)  # noqa: F841
        out = out.mapInArrow(tidy(_searched(sent, shard_words, narrow, spans_of, items_of, n_of)), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids, sorted as strings, comma-joined), contaminated."""
    found = search_benchmark(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _stripped(spans_of, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column("text").to_pylist(), b.column(spans_of).to_pylist()
            cut = [t if t is None or not s else without(t, [[x["first"], x["end"]] for x in s]) for t, s in zip(texts, spans, strict=True)]
            yield pa.record_batch([pa.array(cut, b.column(n).type) if n == "text" else b.column(n) for n in names], names=names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs, all columns, with the hit words removed from text."""
    names = free_names(docs.columns, "n_words", "spans", "items")
    found = search_benchmark(docs, benchmark, names=names, **options)
    return found.mapInArrow(tidy(_stripped(names[1], docs.columns)), fields(docs.schema))
