"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

An id is stored as its rank by frequency over the whole table, in 1 to 4 bytes. The lengths are
two bits each, four to a control byte; control bytes and data bytes lie apart, so that numpy
decodes a block by table lookup. A file set is a folder with

  blocks/  rows (part, block, before, n_docs, n_tokens, payload), in ascending id order: part by
           part, block by block; before = ids in the part ahead of the block
  ranks/   rows (rank, token)

written by Spark, so any store works. A payload is a block of its own: magic, counts, document
ids with their null marks, lengths, control bytes, data bytes. Nulls: a null text is empty, and a
null id sorts first. Equal ids are ordered by a hash of their token ids. An empty table gives
empty files, which read back as no rows. Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citytables.llm.common import dropped, new_path, pieces, tidy, written
from citytables.llm.tokens import BATCH_BYTES, encoder, with_end

MAGIC = b"CTOK1\0\0\0"
BLOCK_TOKENS = 1 << 17
BLOCKS = "part int, block int, before bigint, n_docs int, n_tokens bigint, payload binary"

#: lengths (1..4) of the four ids of each control byte
LENGTHS = np.array([[((c >> (2 * i)) & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)


def encode_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype(np.uint32)
    n = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    code[: len(ranks)] = n - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = np.zeros(int(n.sum()), dtype=np.uint8)
    at = np.cumsum(n) - n
    for k in range(4):
        has = n > k
        data[at[has] + k] = (ranks[has] >> np.uint32(8 * k)) & 0xFF
    return control.tobytes(), data.tobytes()


def decode_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by lookup of their lengths in LENGTHS."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8)])
    out = np.zeros(n, dtype=np.uint32)
    for k in range(4):
        has = size > k
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(doc_ids: list, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ids(ranks)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([MAGIC, struct.pack("<IQQQ", len(doc_ids), len(ranks), len(control), len(data)), null.tobytes(), ids.tobytes(), lengths.astype("<u8").tobytes(), control, data])


def unpack_block(blob: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    if blob[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, n_control, n_data = struct.unpack_from("<IQQQ", blob, 8)
    at = 8 + struct.calcsize("<IQQQ")
    null = np.frombuffer(blob, np.uint8, docs, at)
    ids = np.frombuffer(blob, "<i8", docs, at + docs)
    lengths = np.frombuffer(blob, "<u8", docs, at + 9 * docs)
    at += 17 * docs
    ranks = decode_ids(blob[at : at + n_control], blob[at + n_control : at + n_control + n_data], n)
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], lengths.astype(np.int64), ranks


_TOKENS = "doc_id bigint, ids binary, width int, counts binary"


def _tokenised(path, special, end_id):
    """The ids of each text; and, as a last row of a task, how often each id came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special)
        top = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        kind = np.dtype("<u2") if top <= 1 << 16 else np.dtype("<u4")
        total = np.zeros(top, dtype=np.int64)
        names = ["doc_id", "ids", "width", "counts"]
        for b in pieces(batches, "text", BATCH_BYTES):
            ids, ends = with_end(*enc.encode(b.column("text")), end_id)
            total += np.bincount(ids, minlength=top)
            offsets = np.concatenate([[0], ends * kind.itemsize]).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind).tobytes())])
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), blob, pa.array([kind.itemsize] * len(ends), pa.int32()), pa.nulls(len(ends), pa.binary())], names=names)
        if total.any():
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([kind.itemsize], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=names)

    return run


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and the lengths of its rows."""
    width = batch.column("width")[0].as_py()
    column = batch.column("ids")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(f"<u{width}")
    return flat.astype(np.uint32), np.diff(offsets).astype(np.int64) // width


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | int = 0
    for b in batches:
        for counts in b.column("counts").to_pylist():
            total = total + np.frombuffer(counts, dtype=np.int64)
    if isinstance(total, np.ndarray):
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token", "n"])


def _blocks(rank_of, block_tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, part = rank_of.value, TaskContext.get().partitionId()
        block, before = 0, 0
        docs: list = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        count = 0

        def out():
            nonlocal block, before, count
            lengths, ranks = np.concatenate(sizes), np.concatenate(held)
            row = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(docs)], pa.int32()), pa.array([len(ranks)], pa.int64()), pa.array([pack_block(docs, lengths, ranks)], pa.binary())],
                names=["part", "block", "before", "n_docs", "n_tokens", "payload"],
            )
            block, before, count = block + 1, before + len(ranks), 0
            docs.clear(), sizes.clear(), held.clear()
            return row

        for b in pieces(batches, "ids", 2 * block_tokens):
            ids, lengths = _ids_of(b)
            docs += b.column("doc_id").to_pylist()
            sizes.append(lengths)
            held.append(rank[ids])
            count += len(ids)
            if count >= block_tokens:
                yield out()
        if docs:
            yield out()

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS, special: bool = True) -> None:
    """Encode docs (doc_id, text) and write the file set to path, in ascending doc_id order.

    special: whether the strings of special tokens in a text stand for those tokens.
    """
    spark = docs.sparkSession
    encoded = docs.select("doc_id", "text").mapInArrow(tidy(_tokenised(vocabulary, special, end_id)), _TOKENS)
    stored = written(encoded, "token-ids", compression="zstd")
    counts = stored.where("counts is not null").select("counts").mapInArrow(_counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    ranked = sorted((-r["n"], r["token"]) for r in counts.collect())  # at most one row for each entry of the vocabulary
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ranked)], "rank bigint, token bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max((t for _, t in ranked), default=0) + 1, dtype=np.uint32)
    for i, (_, t) in enumerate(ranked):
        rank[t] = i
    sent = spark.sparkContext.broadcast(rank)
    tokens = stored.where("counts is null").select("doc_id", "ids", "width")
    tie = F.xxhash64("ids")
    ordered = tokens.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.drop("tie").mapInArrow(tidy(_blocks(sent, block_tokens)), BLOCKS).write.parquet(f"{path}/blocks")
    sent.unpersist()
    dropped(stored)


def _read(token_of, digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_of.value
        for b in batches:
            for part, before, blob in zip(*(b.column(c).to_pylist() for c in ("part", "before", "payload")), strict=True):
                docs, lengths, ranks = unpack_block(blob)
                data, ends = table[ranks].astype("<u4").tobytes(), np.cumsum(lengths)
                starts = ends - lengths
                own = [data[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array(own, pa.binary())
                yield pa.record_batch(
                    [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(before + starts, pa.int64()), pa.array(lengths, pa.int64()), last],
                    names=["part", "doc_id", "at", "n_tokens", "last"],
                )

    return run


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, little-endian 32-bit), or ids_crc32 for digest."""
    ranks = [r["token"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]  # as many as the vocabulary has
    sent = spark.sparkContext.broadcast(np.array(ranks, dtype=np.uint32))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    name, kind = ("ids_crc32", "bigint") if digest else ("ids", "binary")
    rows = blocks.select("part", "before", "payload").mapInArrow(tidy(_read(sent, digest)), f"part int, doc_id bigint, at bigint, n_tokens bigint, last {kind}")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of the file set
    starts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return rows.join(starts, "part").select("doc_id", (F.col("base") + F.col("at")).cast("long").alias("start"), "n_tokens", F.col("last").alias(name))


def token_file_path(spark: SparkSession) -> str:
    return new_path(spark, "token-files")
