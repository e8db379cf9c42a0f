"""MinHash near-duplicates by tensored banding.

A document is the set of its word shingles. Two small collections of half keys are made from
minimum hashes, each half key from a few of them; a table's key is a pair of half keys, one of
each collection, so rows x rows tables cost only 2 x rows x per_half minimum hashes - about the
square root of what as many independent keys would take. Documents that share a key are
candidates, and every link is confirmed on the full sets. A pair of similarity s is a candidate with
probability (1 - (1 - s^per_half)^rows)^2. rows is chosen by the threshold: 12 at least, and as many
as give a pair at the threshold 0.9995; with 12 x 12 tables of 3 + 3 hashes that is 0.9996 at 0.8 and
0.99998 at 0.85. Half keys that only one document has make no tables.

1. Equal sets are one class, and stand for all their documents.
2. In each bucket every member is compared with one, the hub: that whose half keys are the most common in the
   corpus, so, in a group of near copies, most likely the text they come from. A pair that meets in
   several buckets is compared once. Links make components.
3. Buckets whose members are not all in one component yet are searched to the end: buckets with common
   members make a neighbourhood, whose members and sets come together once, in one task if they are
   at at most a block; in larger ones bucket by bucket, a block of the members with a group of those outside of
   the bucket's main component at a time. There each member is
   compared with those that share a table and aren't linked to it yet - in large buckets in the first of their
   common tables only, which both know from their half keys - and only links that join something leave
   the task. So no task emits all pairs of a group, and no link between candidates is lost.
4. Components by alternating hooking to the least neighbour and shortening, as joins.

Null texts and texts without words have empty sets and no links; with fewer words than a shingle the
whole sequence is the set's one element. Repeated rows of one id count as one document. A document
without an id is linked like any other; its component is the least id there is in it, null if it has none.
Further columns are ignored, or kept by keep_one, whatever their names. Ties don't matter: components are sets.
Shingles are compared by 64-bit fingerprints of their words. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citytables.llm.common import dropped, free_names, lower_ascii, pieces, tidy, tidy_group, written
from citytables.llm.substring import Words, gram_hashes, mixed

ROWS = 12
PER_HALF = 3
#: A pair at the threshold becomes a candidate with this probability at least.
RECALL = 0.9995
#: The low bits of a key are the number of its table.
TABLE_BITS = 12


def meeting(similarity: float, rows: int, per_half: int = PER_HALF) -> float:
    """The probability that a pair shares a table's key."""
    return (1 - (1 - similarity**per_half) ** rows) ** 2


def rows_for(percent: int, per_half: int = PER_HALF) -> int:
    """The half keys a side that a threshold needs."""
    if percent <= 0:
        raise ValueError("a threshold of 0 links everything")
    rows = ROWS
    while meeting(percent / 100, rows, per_half) < RECALL:
        rows += 1
    return rows


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    g = gram_hashes(words.prints, size)
    out = []
    for a, z in zip(words.bounds.tolist(), words.bounds[1:].tolist(), strict=False):
        n = z - a
        if not n:
            out.append(np.zeros(0, dtype=np.uint64))
        elif n < size:
            out.append(gram_hashes(words.prints[a:z], n) ^ np.uint64(n))
        else:
            out.append(np.unique(g[a : z - size + 1]))
    return out


def half_keys(sets: list[np.ndarray], rows: int = ROWS, per_half: int = PER_HALF) -> np.ndarray:
    """[set, 2 * rows] half keys; each set has an element at least."""
    flat = np.concatenate(sets)
    start = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.zeros((len(sets), 2 * rows), dtype=np.uint64)
    for i in range(2 * rows):
        key = np.full(len(sets), i + 1, dtype=np.uint64)
        for j in range(per_half):
            seed = mixed(np.array([1 + i * per_half + j], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
            low = np.minimum.reduceat(mixed(flat ^ seed), start)
            key = mixed(key * np.uint64(0xD1B54A32D192ED03) + low)
        out[:, i] = key
    return out


SIGNED = "doc_id bigint, n_shingles bigint, cid bigint, halves binary"


def _sets_of(texts: list, size: int) -> list[np.ndarray]:
    return shingle_sets(Words([None if t is None else lower_ascii(t) for t in texts]), size)


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set's content; 0 for the empty one."""
    out = np.zeros(len(sets), dtype=np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = np.bitwise_xor.reduce(mixed(s)) + mixed(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mixed(out).view(np.int64)


def _signed(size, rows, per_half):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            sets = _sets_of(b.column("text").to_pylist(), size)
            some = [i for i, s in enumerate(sets) if len(s)]
            halves: list = [None] * len(sets)
            if some:
                for i, k in zip(some, half_keys([sets[i] for i in some], rows, per_half), strict=True):
                    halves[i] = k.tobytes()
            yield pa.record_batch(
                [b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(class_ids(sets)), pa.array(halves, pa.binary())],
                names=["doc_id", "n_shingles", "cid", "halves"],
            )

    return run


def _fetched(size):
    """The sets of classes, from the text of their least document; another text of the same id is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            sets = _sets_of(b.column("text").to_pylist(), size)
            good = np.flatnonzero(class_ids(sets) == b.column("cid").to_numpy())
            take = pa.array(good, pa.int64())
            yield pa.record_batch([b.column("id").take(take), b.column("halves").take(take), pa.array([sets[i].tobytes() for i in good], pa.binary())], names=["id", "halves", "shingles"])

    return run


def _half_rows(rows):
    """One row for each half key of a class; place is its number among the 2 * rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h = np.frombuffer(b"".join(b.column("halves").to_pylist()), dtype=np.int64)
            place = pa.array(np.tile(np.arange(2 * rows, dtype=np.int16), b.num_rows))
            take = pa.array(np.repeat(np.arange(b.num_rows), 2 * rows), pa.int64())
            yield pa.record_batch([pa.array(h), place, b.column("id").take(take)], names=["half", "place", "id"])

    return run


def _table_keys(rows):
    """One row for each table a class is in whose half keys other classes have too."""
    if rows * rows > 1 << TABLE_BITS:
        raise ValueError("too many tables")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                h = np.frombuffer(b"".join(b.column("halves").to_pylist()), dtype=np.uint64).reshape(b.num_rows, 2 * rows)
                shared = np.zeros(h.shape, dtype=bool)
                places = b.column("shared")
                shared[np.repeat(np.arange(b.num_rows), places.value_lengths().to_numpy()), places.flatten().to_numpy()] = True
                of, left, right = np.nonzero(shared[:, :rows, None] & shared[:, None, rows:])
                key = mixed(h[of, left] ^ mixed(h[of, rows + right] + np.uint64(0x9E3779B97F4A7C15)))
                key = ((key >> np.uint64(TABLE_BITS)) << np.uint64(TABLE_BITS)) | (left * rows + right).astype(np.uint64)
                yield pa.record_batch([pa.array(key.view(np.int64)), b.column("id").take(pa.array(of, pa.int64()))], names=["key", "id"])

    return run


def first_tables(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """The first table in which each pair of half keys [pairs, 2 * rows] meets; -1 without one."""
    left, right = a[:, :rows] == b[:, :rows], a[:, rows:] == b[:, rows:]
    return np.where(left.any(axis=1) & right.any(axis=1), left.argmax(axis=1) * rows + right.argmax(axis=1), -1)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _close(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


#: Which members of a task are compared, by side, the one of the smaller id first: 0 of the main component, 1 a stray of
#: another block, 2 a stray of this block and of this group, 3 a stray of this block and of another group. Of all tasks
#: that see a pair with a stray in it, just one compares it.
_MEET = np.array([[0, 1, 1, 0], [1, 0, 0, 0], [1, 1, 1, 1], [0, 1, 0, 0]], dtype=bool)


def _searched(percent, rows, bucket):
    """Links that join members of a group that aren't joined yet: of a part of a bucket, or of several buckets at once."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        ids, side = group.column("id").to_pylist(), group.column("side").to_numpy()
        tab = group.column("key")[0].as_py() & ((1 << TABLE_BITS) - 1) if bucket else None
        n = len(ids)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("shingles").to_pylist()]
        halves = np.frombuffer(b"".join(group.column("halves").to_pylist()), dtype=np.uint64).reshape(n, 2 * rows)
        sizes = np.array([len(s) for s in sets])
        flat, start = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        label = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1]
        links = []
        for i in range(n - 1):
            other = label[i + 1 :] != label[i]
            if not other.any():
                if (label == label[0]).all():
                    break
                continue
            near = other & (100 * np.minimum(sizes[i], sizes[i + 1 :]) >= percent * np.maximum(sizes[i], sizes[i + 1 :]))
            near &= _MEET[side[i], side[i + 1 :]]
            cand = i + 1 + np.flatnonzero(near)
            if not len(cand):
                continue
            first = first_tables(halves[cand], np.broadcast_to(halves[i], (len(cand), 2 * rows)), rows)
            cand = cand[first == tab if bucket else first >= 0]
            if not len(cand):
                continue
            if len(cand) > 8:
                pick = np.concatenate([np.arange(start[c], start[c] + sizes[c]) for c in cand])
                x = flat[pick]
                at = np.searchsorted(sets[i], x)
                at[at == sizes[i]] = sizes[i] - 1
                both = np.add.reduceat(sets[i][at] == x, np.concatenate([[0], np.cumsum(sizes[cand])[:-1]]), dtype=np.int64)
            else:
                both = np.array([_common(sets[i], sets[c]) for c in cand])
            good = cand[100 * both >= percent * (sizes[i] + sizes[cand] - both)]
            for c in good.tolist():
                if label[c] != label[i]:
                    links.append((ids[c], ids[i]))
                    label[label == label[c]] = label[i]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """id, comp (the least id reachable) of every id in links (a, b); joins and aggregates only, a round at a time.

    Each round every node takes the least label around it, and then its label's label; so chains
    shorten by more than half.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = written(both.distinct(), "edges")
    state = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("id"), "comp"), "labels")
    while True:
        around = edges.join(state.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        hooked = state.join(around.withColumnRenamed("a", "id"), "id").select("id", "comp", F.least("comp", "near").alias("low"))
        # whoever a node stood under may learn of the lower label too
        told = hooked.groupBy("comp").agg(F.min("low").alias("root"))
        step = hooked.join(told, "comp").select("id", F.col("comp").alias("was"), F.least("low", "root").alias("comp"))
        labels = step.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = written(step.join(labels, "comp", "left").select("id", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        changed = new.where("comp <> was").limit(1).count()
        dropped(state)
        state = new.select("id", "comp")
        state._written_at = new._written_at
        if not changed:
            return state


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, rows: int | None = None, per_half: int = PER_HALF, block: int = 1000, broadcast_rows: int = 500_000
) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links), kept (it is that id itself).

    Documents are linked when 100 x |A and B| >= percent x |A or B| on their sets of size-word shingles.
    """
    rows = rows or rows_for(percent, per_half)
    docs = docs.select("doc_id", "text")
    signed = written(docs.mapInArrow(tidy(_signed(size, rows, per_half)), SIGNED), "signatures")
    classes = written(signed.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("halves").alias("halves")), "classes")

    own = classes.select("cid", "doc_id", "halves")
    halves = own.select(F.col("cid").alias("id"), "halves").mapInArrow(_half_rows(rows), "half bigint, place smallint, id bigint")
    common = halves.groupBy("half", "place").agg(F.count("*").alias("n")).where("n > 1")
    shared = halves.join(common, ["half", "place"]).groupBy(F.col("id").alias("cid")).agg(F.collect_set("place").alias("shared"), F.sum("n").alias("weight"))
    # classes are numbered from those whose half keys are the most common on: in a group of near copies that is the text they all come from
    ordered = own.join(shared, "cid").repartitionByRange(F.desc("weight"), "cid").sortWithinPartitions(F.desc("weight"), "cid")
    several = written(ordered.withColumn("id", F.monotonically_increasing_id()), "shared-halves")

    def sets_of(ids: DataFrame) -> DataFrame:
        """id, halves, shingles of the classes in ids (id)."""
        wanted = several.select("id", "cid", "doc_id", "halves").join(ids.distinct(), "id")
        if wanted.count() <= broadcast_rows:
            wanted = F.broadcast(wanted)
        found = docs.join(wanted.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of"))).select("id", "cid", "halves", "text")
        found = found.mapInArrow(tidy(_fetched(size)), "id bigint, halves binary, shingles binary")
        return written(found.dropDuplicates(["id"]), "sets")

    keys = several.select("id", "halves", "shared").mapInArrow(tidy(_table_keys(rows)), "key bigint, id bigint")
    # the members of a bucket pass in order, so its first is known from there on: one shuffle, nothing held
    by_key = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = written(keys.withColumn("hub", F.first("id").over(by_key)).where("id <> hub"), "buckets")
    pairs = written(found.select("id", "hub").distinct(), "pairs")
    x = sets_of(pairs.select("id").union(pairs.select("hub")))
    y = x.select(F.col("id").alias("hub"), F.col("shingles").alias("hub_shingles"))
    links = written(pairs.join(x.select("id", "shingles"), "id").join(y, "hub").mapInArrow(tidy(_checked(percent)), "a bigint, b bigint"), "links")
    comp = components(links)

    # buckets that hold two components, of three members at least: the pairs without the hub are still open
    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    of_hub = comp.select(F.col("id").alias("hub"), F.col("comp").alias("hub_comp"))
    apart = pairs.join(comp, "id", "left").join(of_hub, "hub", "left").where(F.coalesce("comp", "id") != F.coalesce("hub_comp", "hub")).select("id", "hub")
    apart = written(apart, "apart")
    # a hub with an open pair and all that met it are one neighbourhood, and so are hubs with common members
    met = written(pairs.join(few(written(apart.select("hub").distinct(), "open-hubs")), "hub"), "open-pairs")
    joined = components(met.select(F.col("id").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("comp", "place")
    stars = met.groupBy("hub").agg((F.count("*") + 1).alias("star")).join(joined.withColumnRenamed("id", "hub"), "hub").groupBy("place").agg(F.max("star").alias("star"))
    sizes = joined.groupBy("place").agg(F.count("*").alias("size")).where("size > 2").join(stars, "place").select("place", "size", (F.col("size") > F.greatest(F.lit(block), 4 * F.col("star"))).alias("loose"))
    sizes = written(sizes, "neighbourhoods")
    around = written(joined.join(few(sizes), "place").join(comp, "id", "left").select("id", "place", "size", "loose", F.coalesce("comp", "id").alias("comp")), "members")
    # in a small one every member and its set goes to one task
    small = around.where(F.col("size") <= block).withColumn("side", F.lit(2))
    more = small.join(x, "id").groupBy("place").applyInArrow(tidy_group(_searched(percent, rows, False)), "a bigint, b bigint")
    # a larger one, if most of it met at one hub, is dealt out as a whole; a loose one, which only a chain of hubs holds together, bucket by bucket
    loose = around.where("loose").select("id", "comp")
    keyed = found.join(few(written(loose.select(F.col("id").alias("hub")), "loose-hubs")), "hub")
    keyed = keyed.select("key", "id").unionByName(keyed.select("key", F.col("hub").alias("id")).distinct())
    large = around.where(~F.col("loose") & (F.col("size") > block)).select(F.col("place").alias("key"), "id", "comp", F.lit(False).alias("bucket")).unionByName(keyed.join(loose, "id").select("key", "id", "comp", F.lit(True).alias("bucket")))
    # most members of a group are in one component already; only the others, the strays, are to be compared with all. A task has a block of
    # the members and a set of the strays, so no task grows with a group
    large = written(large.withColumn("key", F.struct("bucket", "key")).drop("bucket"), "large-groups")
    parts = large.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", "c").alias("main"), F.sum("c").alias("n"), F.max("c").alias("most"))
    split = parts.where("most < n").select("key", "main", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.greatest(F.ceil((F.col("n") - F.col("most")) / block).cast("int"), F.lit(1)).alias("groups"))
    large = large.join(few(written(split, "splits")), "key")
    large = large.select("key", "id", "comp", (F.col("comp") != F.col("main")).alias("stray"), "blocks", "groups", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int").alias("set"))
    at_home = large.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(
        "key", "id", "comp", F.col("own").alias("block"), "group", F.when(~F.col("stray"), F.lit(0)).when(F.col("set") == F.col("group"), F.lit(2)).otherwise(F.lit(3)).alias("side")
    )
    away = large.where("stray").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own").select("key", "id", "comp", "block", F.col("set").alias("group"), F.lit(1).alias("side"))
    dealt = at_home.unionByName(away).join(x, "id").withColumns({"bucket": F.col("key.bucket"), "key": F.col("key.key")})
    for bucket in (False, True):
        own = dealt.where(F.col("bucket") == bucket).groupBy("key", "block", "group")
        more = more.unionByName(own.applyInArrow(tidy_group(_searched(percent, rows, bucket)), "a bigint, b bigint"))
    more = written(more, "links")
    for done in (found, pairs, apart, met, sizes, around, large, x):
        dropped(done)
    if more.limit(1).count():  # only components are joined now, and these are few
        ends = [comp.select(F.col("id").alias(c), F.col("comp").alias(f"of_{c}")) for c in ("a", "b")]
        joined = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        up = components(joined)
        moved = comp.join(up.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
        comp = written(moved.unionByName(up.join(comp.select("id"), "id", "left_anti").select("id", "comp")), "labels")
    of_id = several.select("id", "cid")
    comp = comp.join(of_id, "id").join(of_id.select(F.col("id").alias("comp"), F.col("cid").alias("root")), "comp").select(F.col("cid").alias("id"), F.col("root").alias("comp"))

    rooted = classes.select("cid", "doc_id").join(comp.withColumnRenamed("id", "cid"), "cid", "left").select("cid", "doc_id", F.coalesce("comp", "cid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
    of_class = rooted.join(least, "root").select("cid", "component")
    joined = signed.join(of_class, "cid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _checked(percent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [
                (x, y)
                for x, y, sx, sy in zip(*(b.column(c).to_pylist() for c in ("id", "hub", "shingles", "hub_shingles")), strict=True)
                if _close(np.frombuffer(sx, dtype=np.uint64), np.frombuffer(sy, dtype=np.uint64), percent)
            ]
            yield pa.record_batch([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["a", "b"])

    return run


def keep_one(docs: DataFrame, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """docs, all columns, with one document of each component: that of the least id.

    Of repeated rows of a kept id all stay, as they count as one document. Rows without an id can't be told
    apart, so they all stay.
    """
    (name,) = free_names(docs.columns, "gone")
    gone = written(near_duplicates(docs, broadcast_rows=broadcast_rows, **options).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    small = gone.count() <= broadcast_rows
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone[name], "left_anti")
