"""K-d sharding: balance, slots, hot values, nulls, empty tables."""

import zlib
from collections import Counter, defaultdict

from citytables.llm.sharding import kd_shards

SCHEMA = "doc_id long, text string, lang string, source string, extra struct<a:int>"


def rows_of(spark, rows, **kw):
    return kd_shards(spark.createDataFrame(rows, SCHEMA), **kw).collect()


def check(got, texts, shards):
    size = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter(zip((r["size"] for r in got), (r["text_crc32"] for r in got))) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    return [size[i] for i in range(shards)]


def test_balance_with_hot_source(spark):
    rows = [(i * 7 % 1009, "é" * (i * i % 300) if i % 11 else None, ("en", "de", None)[i % 3], "hot" if i % 3 else f"s{i % 20}", None) for i in range(1000)]
    sizes = check(rows_of(spark, rows, bins=256, rows_per_slot_run=10), [r[1] for r in rows], 24)
    target = sum(sizes) / 24
    assert all(abs(s - target) <= 5 * 600 for s in sizes)


def test_one_row_repeated(spark):
    rows = [(5, "same", "en", "a", None)] * 240
    assert check(rows_of(spark, rows), ["same"] * 240, 24) == [120] * 24


def test_few_rows_and_extremes(spark):
    rows = [(2**63 - 1, "a", None, None, None), (-(2**62), "", "x", "y", None), (0, None, None, None, None)]
    assert sum(check(rows_of(spark, rows), [r[1] for r in rows], 24)) == 25


def test_empty(spark):
    assert rows_of(spark, []) == []


def plain_tree(rows, shards, keys):
    """doc_id -> shard by a k-d tree in plain Python; rows (doc_id, size, values of the dimensions)."""
    spans = [max(1, max(r[2][k] for r in rows) - min(r[2][k] for r in rows)) for k in range(keys)]

    def split(own, first, s):
        if s == 1 or not own:
            return {r[0]: first for r in own}
        dim = max(range(keys), key=lambda k: (max(r[2][k] for r in own) - min(r[2][k] for r in own)) / spans[k])
        own = sorted(own, key=lambda r: (r[2][dim], r[0]))
        target, below, at = sum(r[1] for r in own) * (s // 2) / s, 0, 0
        while below + own[at][1] < target:
            below += own[at][1]
            at += 1
        at += below + own[at][1] - target <= target - below
        return split(own[:at], first, s // 2) | split(own[at:], first + s // 2, s - s // 2)

    return split(rows, 0, shards)


def test_against_a_plain_tree(spark):
    sources = [None, "https://a.example/", "https://a.example/x", "https://b", "ÿ", "zz", "", "https://a.example/xy"]
    rows = [(i * 7919 % 2003 - 500, "ab é"[: i % 5] * (i * i % 97), ("en", "de", None, "fr")[i % 4], sources[(i * i) % 8 if i % 3 else 1], None) for i in range(600)]
    rank = lambda values: {v: i for i, v in enumerate(sorted({v or "" for v in values}, key=str.encode))} | {None: -1}
    source, lang = rank([r[3] for r in rows]), rank([r[2] for r in rows])
    size = lambda r: len(r[1].encode()) + 8
    want = plain_tree([(r[0], size(r), (source[r[3]], lang[r[2]], size(r), r[0])) for r in rows], 24, 4)
    for bins in (4096, 7):
        assert {r["doc_id"]: r["shard"] for r in rows_of(spark, rows, bins=bins, tolerance=0.0)} == want


def test_any_types_and_names(spark):
    df = spark.createDataFrame([("k1", "t", "en", 3, None), ("k2", None, None, 1, 2.5), (None, "x", "de", None, 0.0)], "doc_id string, text string, lang string, source int, shard double")
    got = kd_shards(df, shards=2).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["None", "k1", "k2"] and {r["shard"] for r in got} == {0, 1}
