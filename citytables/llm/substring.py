"""Substring deduplication by FM-indexes over shards of repeated text.

A window is `size` consecutive words of one document. A window whose words also start earlier
(smaller id, or earlier in the same document) is a repeat, and the words it covers are removed;
windows are judged on the input, not on what is left.

1. Texts that are equal as a whole are told apart by their hash alone (128 bits): all but the one
   with the smallest id are repeats from end to end.
2. Every document is cut into segments, runs of windows with one anchor: the least hashed gram of `gram`
   words in a window. Equal windows have equal anchors, so all that a window could match lies in the
   segments of its anchor, and an anchor that stands in one place only can be left out.
3. Segments go to shards by the anchor's hash; equal ones travel once. A shard builds a compressed
   FM-index of its segments, then streams them as documents against it: backward search over the
   wavelet tree gives the matching statistics of every place, and where they reach `size`
   the interval of rows; an interval of several rows, or of a segment that stands for several places, is
   a repeat, and its earliest occurrence is located by the sampled suffix positions.
4. Repeats go back to their documents, as the runs of words that their windows cover. Each step's tables
   are deleted once no later one reads them.

An anchor of over hot_segments unlike segments is dealt out window by window under the hash of
the whole window, so no shard grows with one passage. Anchors and segments of over hot_rows places are few
(rows / hot_rows at most); what is joined to those is broadcast, so that no task holds all places of one.
Words are compared by 64-bit fingerprints, segments and texts by 128 bits.

Null or empty texts have no words. Repeated rows (same id and text) count as one document, so
none removes the other; rows of one id with different texts are ordered by the text's hash. A
null id sorts first. An empty table gives an empty result. Further columns are ignored or kept,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citytables.llm.common import dropped, fields, free_names, pieces, tidy, tidy_group, written
from citytables.llm.fmindex import FMIndex

SIZE = 20
GRAM = 8

_M = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0xD1B54A32D192ED03)  # odd, so it has an inverse modulo 2**64
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_S = np.uint64(0xA0761D6478BD642F)
_S_INVERSE = np.uint64(pow(int(_S), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _M)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts: byte spans, 64-bit fingerprints, and where each text's words lie."""

    def __init__(self, texts: list[str | None]):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = b"\n".join(raw) + b"\n"
        b = np.frombuffer(self.data, dtype=np.uint8)
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]  # the last byte is a space
        text_start = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        self.bounds = np.searchsorted(self.start, text_start)
        ahead = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[b] * _powers(_R, len(b)), dtype=np.uint64)])
        back = _powers(_R_INVERSE, len(b))
        self.prints = mixed((ahead[self.end] - ahead[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64) * _M)

    def of(self, i: int) -> list[bytes]:
        a, z = self.bounds[i], self.bounds[i + 1]
        return [self.data[s:e] for s, e in zip(self.start[a:z].tolist(), self.end[a:z].tolist(), strict=True)]


def gram_hashes(prints: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive fingerprints."""
    out = np.zeros(max(0, len(prints) - n + 1), dtype=np.uint64)
    for j in range(n):
        out = out * _R + prints[j : j + len(out)]
    return mixed(out)


def anchors(prints: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with one anchor: the anchor's hash, text, first word, number of windows.

    Text i has the words bounds[i] to bounds[i + 1].
    """
    n = max(0, len(prints) - size + 1)
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(own[:n] == own[size - 1 :]) if n else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), at, at, at
    g = gram_hashes(prints, gram)
    place = (np.arange(n) + sliding_window_view(g, size - gram + 1).argmin(axis=1))[at]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    return g[place[first]], own[at[first]], at[first], np.diff(np.append(first, len(at)))


class Stretches:
    """Hashes of stretches of fingerprints, 128 bits in two parts."""

    def __init__(self, prints: np.ndarray):
        self.parts = []
        for base, other in ((_R, _R_INVERSE), (_S, _S_INVERSE)):
            ahead = np.concatenate([[np.uint64(0)], np.cumsum(prints * _powers(base, len(prints)), dtype=np.uint64)])
            self.parts.append((ahead, _powers(other, max(1, len(prints)))))

    def of(self, start: np.ndarray, length: np.ndarray) -> list[pa.Array]:
        """Alike for equal stretches; each has a word at least."""
        return [pa.array(mixed((ahead[start + length] - ahead[start]) * back[start] + length.astype(np.uint64) * _M).view(np.int64)) for ahead, back in self.parts]


_ANCHORS = "anchor bigint, content bigint, also bigint, doc_id bigint, th bigint, first int, n int"


def _anchored(size, gram):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            words = Words(b.column("text").to_pylist())
            anchor, row, start, n = anchors(words.prints, words.bounds, size, gram)
            content, also = Stretches(words.prints).of(start, n + size - 1)
            take = pa.array(row, pa.int64())
            first = (start - words.bounds[row]).astype(np.int32)
            yield pa.record_batch(
                [pa.array(anchor.view(np.int64)), content, also, b.column("doc_id").take(take), b.column("th").take(take), pa.array(first), pa.array(n.astype(np.int32))],
                names=["anchor", "content", "also", "doc_id", "th", "first", "n"],
            )

    return run


SEGMENTS = "hot boolean, parent bigint, parent_also bigint, shard_key bigint, content bigint, also bigint, words binary, many boolean, doc_id bigint, th bigint, first int"


def _binary(prints: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The fingerprints of each stretch as one binary value."""
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], ends * 8]).astype(np.int32)), pa.py_buffer(prints[at].tobytes())])


def _cut_out(size):
    """The words of segments; of those with a hot anchor each window on its own, under the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            words = Words(b.column("text").to_pylist())
            runs = b.column("runs")
            row = np.repeat(np.arange(b.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            first, n, anchor, content, also, many, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n", "anchor", "content", "also", "many", "hot"))
            times = np.where(hot, n, 1)
            pick = np.repeat(np.arange(len(row)), times)
            step = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
            begin = first[pick] + step
            start = words.bounds[row[pick]] + begin
            length = np.where(hot[pick], size, n[pick] + size - 1).astype(np.int64)
            one, two = (x.to_numpy() for x in Stretches(words.prints).of(start, length))
            take = pa.array(row[pick], pa.int64())
            is_hot = hot[pick]
            yield pa.record_batch(
                [
                    pa.array(is_hot), pa.array(content[pick]), pa.array(also[pick]), pa.array(np.where(is_hot, one, anchor[pick])), pa.array(np.where(is_hot, one, content[pick])), pa.array(np.where(is_hot, two, also[pick])),
                    _binary(words.prints, start, length), pa.array(many[pick]), b.column("doc_id").take(take), b.column("th").take(take), pa.array(begin.astype(np.int32)),
                ],
                names=["hot", "parent", "parent_also", "shard_key", "content", "also", "words", "many", "doc_id", "th", "first"],
            )

    return run


_EARLIEST = pa.list_(pa.struct([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32())]))


def _shard_searched(size, streamed=4096):
    """Index a shard's segments and stream them against the index, streamed of them at a time."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        blobs = group.column("words").to_pylist()
        n_words = np.array([len(x) // 8 for x in blobs], dtype=np.int64)
        start = np.cumsum(n_words + 1) - n_words - 1
        total = int((n_words + 1).sum())
        flat = np.frombuffer(b"".join(blobs), dtype=np.uint64)
        unique, code = np.unique(flat, return_inverse=True)
        text = np.zeros(total, dtype=np.int64)
        inside = np.ones(total, dtype=bool)
        inside[start + n_words] = False
        text[inside] = code + 1
        index = FMIndex(text, len(unique), longest=size)
        many = group.column("many").to_numpy()  # the segment stands for several places
        docs, th, at_first = (group.column(c).to_numpy() for c in ("doc_id", "th", "first"))
        content, also = group.column("content").to_pylist(), group.column("also").to_pylist()
        out: dict[str, list] = {"content": [], "also": [], "earliest": []}
        for s in range(0, len(blobs), streamed):
            starts, sizes = start[s : s + streamed], n_words[s : s + streamed]
            begin, end = int(starts[0]), int(starts[-1] + sizes[-1])
            found, lo, hi = index.matching_statistics(text[begin:end], starts - begin, sizes)
            place = np.flatnonzero(found >= size)
            of = np.searchsorted(starts - begin, place, side="right") - 1
            often = (hi[place] - lo[place] > 1) | many[s + of]
            place, of = place[often], of[often]
            if not len(place):
                continue
            low, interval = np.unique(lo[place], return_inverse=True)
            top = np.zeros(len(low), dtype=np.int64)
            top[interval] = hi[place]
            which, where = index.occurrences(low, top)
            source = np.searchsorted(start, where, side="right") - 1
            at = at_first[source].astype(np.int64) + where - start[source]
            order = np.lexsort((at, th[source], docs[source], which))
            lead = order[np.concatenate([[True], which[order][1:] != which[order][:-1]])]
            e_doc, e_th, e_at = docs[source][lead][interval], th[source][lead][interval], at[lead][interval]
            rows: dict[int, list] = {}
            for w, i, d, t, a in zip(of.tolist(), (place - (starts - begin)[of]).tolist(), e_doc.tolist(), e_th.tolist(), e_at.tolist(), strict=True):
                own = rows.get(w)
                if own is None:
                    own = rows[w] = [None] * int(sizes[w] - size + 1)
                own[i] = {"doc_id": d, "th": t, "at": a}
            out["content"] += [content[s + w] for w in rows]
            out["also"] += [also[s + w] for w in rows]
            out["earliest"] += list(rows.values())
        return pa.table([pa.array(out["content"], pa.int64()), pa.array(out["also"], pa.int64()), pa.array(out["earliest"], _EARLIEST)], names=["content", "also", "earliest"])

    return run


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows (all of bounded size)."""
    return F.broadcast(df) if df.count() <= most else df


def _covered(size):
    """The runs of words that windows at starts cover, as from, to, from, to, ..., ascending and apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = b.column("starts")
            row = np.repeat(np.arange(b.num_rows), np.diff(starts.offsets.to_numpy()))
            at = starts.flatten().to_numpy()
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            first = np.ones(len(at), dtype=bool)
            first[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + size)
            last = np.append(first[1:], True)[: len(at)]
            edges = np.stack([at[first], at[last] + size], axis=1).ravel().astype(np.int32)
            bounds = np.concatenate([[0], 2 * np.cumsum(np.bincount(row[first], minlength=b.num_rows))]).astype(np.int32)
            yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(edges))], names=["doc_id", "th", "spans"])

    return run


def repeats(
    keyed: DataFrame, size: int = SIZE, gram: int = GRAM, shard_words: int = 1 << 18, hot_segments: int = 2000, hot_rows: int = 5000, broadcast_rows: int = 150_000
) -> DataFrame:
    """doc_id, th, copied (the whole text is), and spans (the words that windows which are repeats cover, see _covered) of keyed (doc_id, th, also, text)."""
    keys = keyed.select("doc_id", "th", "also")
    first_of = keys.groupBy("th", "also").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last")
    first_of = written(first_of.select("th", "also", "keeper"), "keepers")
    copies = written(keys.join(_few(first_of, broadcast_rows), ["th", "also"]).where("doc_id > keeper").select("doc_id", "th").distinct(), "copies")
    dropped(first_of)

    few = copies.count() <= broadcast_rows
    single = keyed.join(F.broadcast(copies), ["doc_id", "th"], "left_anti") if few else keyed
    found = single.select("doc_id", "th", "text").mapInArrow(tidy(_anchored(size, gram)), _ANCHORS)
    found = written(found if few else found.join(copies, ["doc_id", "th"], "left_anti"), "anchors")
    often = written(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "anchor-counts")
    hot_anchors = F.broadcast(often.where(F.col("c") > hot_rows).select("anchor"))
    warm = found.join(hot_anchors, "anchor", "left_anti").join(often.where(F.col("c") <= hot_rows).select("anchor"), "anchor", "left_semi")
    some = written(warm.unionByName(found.join(hot_anchors, "anchor", "left_semi")), "anchors-often")
    dropped(found)
    dropped(often)

    # of equal segments the earliest stands for all; only its words are read and travel
    content = ["content", "also"]
    leaders = some.groupBy(*content).agg(F.min(F.struct("doc_id", "th", "first")).alias("e"), F.first("anchor").alias("anchor"), F.first("n").alias("n"), F.count("*").alias("places"))
    leaders = written(leaders.select(*content, "anchor", "n", "places", (F.col("places") > 1).alias("many"), "e.doc_id", "e.th", "e.first"), "leaders")
    again = leaders.groupBy("anchor").agg(F.count("*").alias("c"), F.bool_or("many").alias("m")).where("c > 1 or m").select("anchor", (F.col("c") > hot_segments).alias("hot"))
    run_of = F.struct("first", "n", "anchor", "content", "also", "many", "hot")
    by_doc = written(leaders.join(again, "anchor").groupBy("doc_id", "th").agg(F.collect_list(run_of).alias("runs")), "runs")
    wanted = by_doc.select("doc_id", "th")
    texts = keyed.join(F.broadcast(wanted), ["doc_id", "th"], "left_semi") if wanted.count() <= broadcast_rows else keyed
    segments = written(texts.join(by_doc.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "text", "runs").mapInArrow(tidy(_cut_out(size)), SEGMENTS), "segments")
    dropped(by_doc)

    one = segments.where("hot").groupBy(*content).agg(F.first("shard_key").alias("shard_key"), F.first("words").alias("words"), F.min(F.struct("doc_id", "th", "first")).alias("e"), (F.bool_or("many") | (F.count("*") > 1)).alias("many"))
    columns = ["shard_key", *content, "words", "many"]
    one = one.select(*columns, "e.doc_id", "e.th", "e.first").unionByName(segments.where("not hot").select(*columns, "doc_id", "th", "first"))
    n = segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-n // (8 * shard_words)))
    sharded = one.withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(shards)))
    searched = sharded.groupBy("shard").applyInArrow(tidy_group(_shard_searched(size)), "content bigint, also bigint, earliest array<struct<doc_id:bigint,th:bigint,at:int>>")
    earliest = written(searched, "earliest")

    # back to the places; contents of many places are few, and what is known of them is broadcast
    places = some.select(*content, "doc_id", "th", "first")
    crowded = F.broadcast(leaders.where(F.col("places") > hot_rows).select(*content))

    def to_places(known: DataFrame) -> DataFrame:
        calm = places.join(crowded, content, "left_anti").join(known.join(crowded, content, "left_anti"), content)
        return calm.unionByName(places.join(F.broadcast(known.join(crowded, content, "left_semi")), content))

    late = F.transform("earliest", lambda e, i: F.when(e.isNotNull() & ~((e["doc_id"] == F.col("doc_id")) & (e["th"] == F.col("th")) & (e["at"] == F.col("first") + i)), F.col("first") + i))
    cold = to_places(earliest).select("doc_id", "th", F.filter(late, lambda s: s.isNotNull()).alias("s")).where("size(s) > 0")
    parents = leaders.select(F.col("content").alias("parent"), F.col("also").alias("parent_also"), F.col("first").alias("lead"))
    windows = segments.where("hot").select(*content, "parent", "parent_also", "first").join(earliest, content).join(parents, ["parent", "parent_also"])
    of_parent = F.collect_list(F.struct((F.col("first") - F.col("lead")).alias("i"), F.col("earliest")[0].alias("e")))  # as many as a segment has windows
    windows = written(windows.groupBy("parent", "parent_also").agg(of_parent.alias("own")).select(F.col("parent").alias("content"), F.col("parent_also").alias("also"), "own"), "hot-windows")
    dropped(segments)
    later = F.filter("own", lambda w: ~((w["e"]["doc_id"] == F.col("doc_id")) & (w["e"]["th"] == F.col("th")) & (w["e"]["at"] == F.col("first") + w["i"])))
    hot = to_places(windows).select("doc_id", "th", F.transform(later, lambda w: F.col("first") + w["i"]).alias("s")).where("size(s) > 0")
    starts = cold.unionByName(hot).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("s")).alias("starts"))
    parts = starts.mapInArrow(tidy(_covered(size)), "doc_id bigint, th bigint, spans array<int>").withColumn("copied", F.lit(False))
    whole = copies.select("doc_id", "th", F.array().cast("array<int>").alias("spans"), F.lit(True).alias("copied"))
    out = written(parts.unionByName(whole), "repeats")
    for done in (copies, some, leaders, earliest, windows):
        dropped(done)
    return out


def _mask(n: int, spans, copied: bool, size: int) -> np.ndarray:
    if copied:
        return np.full(n, n >= size)
    mark = np.zeros(n + 1, dtype=np.int64)
    mark[spans[::2]] = 1
    mark[spans[1::2]] = -1
    return np.cumsum(mark[:n]) > 0


def _digested(spans_of, copied_of, size):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            counts, removed, out = [], [], []
            for text, spans, copied in zip(*(b.column(c).to_pylist() for c in ("text", spans_of, copied_of)), strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                counts.append(len(words))
                gone = 0
                if spans or copied:
                    mask = _mask(len(words), spans, bool(copied), size)
                    gone = int(mask.sum())
                    words = [words[i] for i in np.flatnonzero(~mask).tolist()]
                removed.append(gone)
                out.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _stripped(spans_of, copied_of, size):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = b.column("text").to_pylist()
            for i, (spans, copied) in enumerate(zip(b.column(spans_of).to_pylist(), b.column(copied_of).to_pylist(), strict=True)):
                if texts[i] and (spans or copied):
                    texts[i] = _without(texts[i], spans, bool(copied), size)
            rest = {n: pa.array(texts, b.column(n).type) if n == "text" else b.column(n) for n in b.schema.names if n not in (spans_of, copied_of)}
            yield pa.record_batch(list(rest.values()), names=list(rest))

    return run


_WORD = re.compile("[^ \t\n\v\f\r]+")


def _without(text: str, spans, copied: bool, size: int) -> str:
    """The text less the words that go, each with the white space ahead of it."""
    words = [m.span() for m in _WORD.finditer(text)]
    gone = _mask(len(words), spans, copied, size)
    if not gone.any():
        return text
    parts: list[str] = []
    for j in np.flatnonzero(~gone).tolist():
        parts.append(text[words[j - 1][1] if j and parts else words[j][0] : words[j][1]])
    return "".join(parts)


def _joined(docs: DataFrame, size: int, **options) -> tuple[DataFrame, str, str]:
    """docs with two columns more, spans and copied, whose names are returned too."""
    text = F.coalesce("text", F.lit(""))
    th = F.xxhash64(text)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = docs.select(id_.alias("doc_id"), th.alias("th"), F.xxhash64(F.lit(7), text).alias("also"), "text")
    found = repeats(keyed, size=size, **options)
    doc, hash_, spans, copied = free_names(docs.columns, "__doc", "__th", "__spans", "__copied")
    found = found.select(F.col("doc_id").alias(doc), F.col("th").alias(hash_), F.col("spans").alias(spans), F.col("copied").alias(copied))
    small = (found.agg(F.sum(F.size(spans) + 4)).first()[0] or 0) <= 16 * options.get("broadcast_rows", 150_000)
    joined = docs.withColumns({doc: id_, hash_: th}).join(F.broadcast(found) if small else found, [doc, hash_], "left")
    return joined.drop(doc, hash_), spans, copied


def dedup_digest(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    joined, spans, copied = _joined(docs.select("doc_id", "text"), size, **options)
    return joined.mapInArrow(tidy(_digested(spans, copied, size)), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def dedup_texts(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """docs, all columns, with the repeats removed from text."""
    joined, spans, copied = _joined(docs, size, **options)
    return joined.mapInArrow(tidy(_stripped(spans, copied, size)), fields(docs.schema))
