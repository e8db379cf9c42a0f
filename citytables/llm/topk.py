"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's score is the sum of partial scores over blocks of its dimensions. Each block is a list of its
own, a table of (class, part of the vector), whose pieces lie in tasks; no task sees whole vectors. For
a block of queries of bounded size:

1. each piece of a list gathers, for each query, its highest partial scores and its least; merged, that is
   the top of each list. The other parts of these few vectors are looked up, and the (k + 1)-th highest of
   their sums is a safe cutoff: the (k + 1)-th highest score of all is no lower;
2. the uniform threshold - what one list at least must exceed its least score by, if a sum is to reach the
   cutoff - is broadcast, and each list gives only the entries that pass it;
3. a vector that passed in some lists only has parts missing: these alone are fetched from the other
   lists, and the exact sums are ranked.

Equal vectors are one class, with the smallest k + 1 ids as members, so that copies cost nothing;
no link is lost, as a result never needs more of them. Vectors are integers; scores are exact
(float64 products while every sum stays under 2**53, else Python integers; beyond 64 bits it fails).

Null vectors and those with null or non-finite components take no part. Vectors of different
lengths are compared over their common dimensions (missing components count as 0). Rows that
repeat an id with another vector count as rows of their own, though never as a hit of that id.
An empty table, or one without queries, gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citytables.llm.common import dropped, new_path, tidy, written

LISTS = 2
CLASS = "vec: binary, ids: array<bigint>"
#: Products that a task holds at once.
PRODUCTS = 1 << 21


def _stacked(blobs: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(blobs), dims), dtype=np.int64)
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, dtype=np.int64)[:dims]
        out[i, : len(v)] = v
    return out


def _products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products, [vectors, queries]."""
    if not vectors.size or not queries.size:
        return np.zeros((len(vectors), len(queries)), dtype=np.int64)
    most = float(np.abs(vectors.astype(np.float64)).max()) * float(np.abs(queries.astype(np.float64)).max()) * vectors.shape[1]
    if most < 2**53:
        return (vectors.astype(np.float64) @ queries.astype(np.float64).T).astype(np.int64)
    return (vectors.astype(object) @ queries.astype(object).T).astype(np.int64)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of every component, for the vectors that take part."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v")
    )


def _classes(depth: int):
    """Equal vectors of a task, each with its smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out():
            part = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["vec", "ids"])
            held.clear()
            return part

        for b in batches:
            column = b.column("v")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            ends = ends - ends[0]
            for i, x in enumerate(b.column("id").to_pylist()):
                key = flat[ends[i] : ends[i + 1]].astype(np.int64).tobytes()
                ids = held.setdefault(key, [])
                if len(ids) < depth:
                    ids.append(x)
                elif x < (m := max(ids)):
                    ids[ids.index(m)] = x
            if len(held) >= 20_000:
                yield out()
        yield out()

    return run


ENTRIES = "q int, cid bigint, score bigint"
_ENTRY = ["q", "cid", "score"]


def _entries(q, cid, score) -> pa.RecordBatch:
    return pa.record_batch([pa.array(q.astype(np.int32)), pa.array(cid), pa.array(score.astype(np.int64))], names=_ENTRY)


def _cut(batches, n_queries):
    """Ids and vectors of a list, so many rows at a time that their products are bounded."""
    rows = max(1, PRODUCTS // max(1, n_queries))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part.column("cid").to_numpy(), part.column("part").to_pylist()


def _local_tops(sent, i, depth):
    """Phase 1: for each query the highest partial scores of this piece of list i, and - as cid -1 - the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value[i]
        n, dims = q.shape
        top = np.zeros((0, n), dtype=np.int64)
        ids = np.zeros((0, n), dtype=np.int64)
        low = None
        for cid, part in _cut(batches, n):
            p = _products(_stacked(part, dims), q)
            low = p.min(axis=0) if low is None else np.minimum(low, p.min(axis=0))
            top, ids = np.concatenate([top, p]), np.concatenate([ids, np.broadcast_to(cid[:, None], p.shape)])
            if len(top) > depth:
                at = np.argpartition(-top, depth - 1, axis=0)[:depth]
                top, ids = np.take_along_axis(top, at, axis=0), np.take_along_axis(ids, at, axis=0)
        if low is not None:
            yield _entries(np.tile(np.arange(n), len(top)), ids.ravel(), top.ravel())
            yield _entries(np.arange(n), np.full(n, -1), low)

    return run


def _over(sent, floors, i):
    """Phase 2: the entries of list i that pass its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value[i]
        for cid, part in _cut(batches, len(q)):
            p = _products(_stacked(part, q.shape[1]), q)
            row, col = np.nonzero(p >= floors.value[i][None, :])
            yield _entries(col, cid[row], p[row, col])

    return run


def _dots(cid: np.ndarray, part: list[bytes], queries: list, q: np.ndarray) -> pa.RecordBatch:
    """The partial scores of each vector with its own queries."""
    of = np.repeat(np.arange(len(cid)), [len(x) for x in queries])
    which = np.array([y for x in queries for y in x], dtype=np.int64)
    v = _stacked(part, q.shape[1])
    out = np.zeros(len(of), dtype=np.int64)
    step = max(1, PRODUCTS // max(1, q.shape[1]))
    for a in range(0, len(of), step):
        x, y = v[of[a : a + step]], q[which[a : a + step]]
        most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * q.shape[1]
        out[a : a + step] = (x * y).sum(axis=1) if most < 2**62 else [int(s) for s in (x.astype(object) * y.astype(object)).sum(axis=1)]
    return _entries(which, cid[of], out)


def _looked_up(sent, wanted, i):
    """The partial scores in list i of a few vectors, each with some queries; wanted: {class: queries}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = np.array(sorted(wanted.value), dtype=np.int64)
        for b in batches:
            hit = np.flatnonzero(np.isin(b.column("cid").to_numpy(), few))
            if len(hit):
                cid = b.column("cid").to_numpy()[hit]
                yield _dots(cid, b.column("part").take(pa.array(hit)).to_pylist(), [wanted.value[int(c)] for c in cid], sent.value[i])

    return run


def _fetched(sent, i):
    """Phase 3: the missing partial scores; rows (cid, part, qs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                yield _dots(b.column("cid").to_numpy(), b.column("part").to_pylist(), b.column("qs").to_pylist(), sent.value[i])

    return run


def _parts(cuts):
    """The part of each vector for each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column("vec").to_pylist()
            columns = [pa.array([x[8 * a : 8 * z] for x in blobs], pa.binary()) for a, z in cuts]
            yield pa.record_batch([b.column("cid"), *columns], names=["cid", *(f"part{i}" for i in range(len(cuts)))])

    return run


def exact_topk(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    block_queries: int = 2048,
) -> DataFrame:
    """For each query row, its k highest inner products with all other rows: query_id, rank, vec_id, score.

    is_query: a condition on the column id. Ties go to the smaller id. Queries are taken in
    blocks of at most block_queries rows, so what is broadcast has a fixed size; each block's result is written.
    """
    spark = vectors.sparkSession
    depth = k + 1
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    local = rows.mapInArrow(tidy(_classes(depth)), CLASS)
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, depth)
    classes = written(local.groupBy("vec").agg(smallest.alias("ids")).withColumn("cid", F.monotonically_increasing_id()), "topk-classes")
    asked = written(rows.where(is_query(F.col("id"))).select("id", "v").distinct().withColumn("n", F.monotonically_increasing_id()), "topk-queries")
    dims = asked.agg(F.max(F.size("v"))).first()[0] or 0
    cuts = [(dims * i // LISTS, dims * (i + 1) // LISTS) for i in range(LISTS)]
    names = [f"part{i}" for i in range(LISTS)]
    both = written(classes.select("cid", "vec").mapInArrow(tidy(_parts(cuts)), "cid bigint, " + ", ".join(f"{n} binary" for n in names)), "topk-lists")
    lists = [both.select("cid", F.col(n).alias("part")) for n in names]  # a column file each: reading one reads no other
    out = new_path(spark, "topk")
    spark.createDataFrame([], RESULT).write.parquet(out)
    part: list = []
    for r in asked.toLocalIterator():  # a block at a time on the driver
        part.append(r)
        if len(part) == block_queries:
            _search(spark, classes, lists, cuts, part, k, depth).write.mode("append").parquet(out)
            part = []
    if part:
        _search(spark, classes, lists, cuts, part, k, depth).write.mode("append").parquet(out)
    for done in (classes, asked, both):
        dropped(done)
    return spark.read.schema(RESULT).parquet(out)


RESULT = "query_id long, rank int, vec_id long, score long"


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _search(spark, classes: DataFrame, lists: list[DataFrame], cuts: list, part: list, k: int, depth: int) -> DataFrame:
    n = len(part)
    blobs = [np.asarray(r["v"], dtype=np.int64).tobytes() for r in part]
    dims = cuts[-1][1]
    whole = _stacked(blobs, dims)
    sent = spark.sparkContext.broadcast([whole[:, a:z] for a, z in cuts])

    # phase 1
    tops = written(_union([x.mapInArrow(tidy(_local_tops(sent, i, depth)), ENTRIES).withColumn("list", F.lit(i)) for i, x in enumerate(lists)]), "topk-tops")
    lows = np.zeros((len(lists), n), dtype=np.int64)
    for r in tops.where("cid = -1").groupBy("q", "list").agg(F.min("score").alias("low")).collect():  # one row a query and list
        lows[r["list"], r["q"]] = r["low"]
    best = Window.partitionBy("q", "list").orderBy(F.desc("score"))
    first = tops.where("cid >= 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= depth).select("q", "cid").distinct().collect()  # depth rows at most a query and list
    wanted: dict[int, list[int]] = {}
    for r in first:
        wanted.setdefault(r["cid"], []).append(r["q"])
    few = spark.sparkContext.broadcast(wanted)
    sums = _union([x.mapInArrow(_looked_up(sent, few, i), ENTRIES) for i, x in enumerate(lists)]).groupBy("q", "cid").agg(F.sum("score").alias("score")).collect()
    known: list[list[int]] = [[] for _ in range(n)]
    for r in sums:
        known[r["q"]].append(r["score"])
    cutoff = np.array([sorted(x, reverse=True)[depth - 1] if len(x) >= depth else -(2**62) for x in known], dtype=np.int64)

    # phase 2
    share = [-((int(s) - int(c)) // len(lists)) if c > -(2**62) else None for s, c in zip(lows.sum(axis=0), cutoff, strict=True)]  # rounded up
    floors = spark.sparkContext.broadcast([np.array([-(2**62) if x is None else int(low) + x for low, x in zip(own, share, strict=True)], dtype=np.int64) for own in lows])
    passed = written(_union([x.mapInArrow(tidy(_over(sent, floors, i)), ENTRIES).withColumn("list", F.lit(1 << i)) for i, x in enumerate(lists)]), "topk-entries")

    # phase 3
    half = written(passed.groupBy("q", "cid").agg(F.sum("score").alias("score"), F.bit_or("list").alias("has")), "topk-partial")
    found = [half.select("q", "cid", "score")]
    for i, x in enumerate(lists):
        missing = half.where(F.col("has").bitwiseAND(F.lit(1 << i)) == 0).groupBy("cid").agg(F.collect_list("q").alias("qs"))  # n at most
        found.append(missing.join(x, "cid").select("cid", "part", "qs").mapInArrow(tidy(_fetched(sent, i)), ENTRIES))
    exact = _union(found).groupBy("q", "cid").agg(F.sum("score").alias("score"))
    least = spark.createDataFrame([(i, r["id"], int(c)) for i, (r, c) in enumerate(zip(part, cutoff, strict=True))], "q int, query_id long, cutoff long")
    good = exact.join(F.broadcast(least), "q").where("score >= cutoff")
    # the classes over the cutoff; ties at the edge are kept as long as their smaller ids can matter
    hits = written(good.join(classes.select("cid", "ids"), "cid").select("q", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id"), "topk-hits")
    for done in (tops, passed, half):
        dropped(done)
    for b in (sent, few, floors):
        b.unpersist()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
