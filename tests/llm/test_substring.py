"""Substring deduplication against brute force."""

import hashlib
import os
import random
import re

from pyspark.sql import functions as F

from citytables.llm.common import shared_dir
from citytables.llm.substring import Words, dedup_digest, dedup_texts, repeats

SCHEMA = "doc_id long, text string, th string, spans int"


def brute(rows, size):
    first = {}
    docs = sorted({(d, t or "") for d, t, *_ in rows})
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", k[1]) for k in docs}
    for k in docs:
        for i in range(len(split[k]) - size + 1):
            first.setdefault(tuple(split[k][i : i + size]), (k, i))
    out = []
    for d, t, *_ in rows:
        k = (d, t or "")
        w = split[k]
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] != (k, i):
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def made():
    r = random.Random(9)
    word = lambda: r.choice(["a", "b", "Ç", "d.", "e f"])
    passages = [[word() for _ in range(r.randrange(8, 30))] for _ in range(8)]
    rows = []
    for i in range(150):
        w = [word() for _ in range(r.randrange(0, 25))]
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(0, len(w) + 1)
            w[at:at] = r.choice(passages)
        rows.append((i * 37 % 151, "".join(x + r.choice([" ", "\n", "\t ", "\x0b"]) for x in w), "x", None))
    rows += [(1000 + i, rows[3][1], None, i) for i in range(60)] + [(2000 + i, "q w e r t y u i o p " * 2 + f"tail {i}", None, None) for i in range(60)]
    return rows + [(3000, None, "x", 1), (3001, "", "x", 1), (3002, "z " * 5000, "x", 1), (3000, None, "x", 1)]


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows, 8)
    for kw in ({"hot_segments": 20, "shard_words": 500, "hot_rows": 30}, {"broadcast_rows": 0}):
        assert sorted(map(tuple, dedup_digest(df, size=8, gram=4, **kw).collect())) == want


def test_texts(spark):
    same = " ".join(f"w{i}" for i in range(25))
    rows = [(1, f"Start here\n{same} end", "t", 1), (2, f"Other\n\n  {same}\n\nlast  words", "t", 2), (3, None, "t", 3), (4, same, "t", 4), (5, same, "t", 5)]
    got = {r["doc_id"]: r for r in dedup_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "Other\n\nlast  words" and got[3]["text"] is None and got[4]["text"] == got[5]["text"] == ""
    assert got[2]["spans"] == 2 and got[2]["th"] == "t"
    names = ["doc_id", "text", "__doc", "__starts", "TH", "also"]
    clash = dedup_texts(spark.createDataFrame([(1, same, 5, "s", 2, "a"), (2, f"x {same}", 6, None, 3, None)], "doc_id int, text string, __doc int, __starts string, TH int, also string"))
    assert clash.columns == names and sorted(map(tuple, clash.collect())) == [(1, same, 5, "s", 2, "a"), (2, "x", 6, None, 3, None)]


def test_words_and_empty(spark):
    w = Words(["a bc\tdé", None, "", " bc "])
    assert [w.of(i) for i in range(4)] == [[b"a", b"bc", "dé".encode()], [], [], [b"bc"]]
    assert w.prints[1] == w.prints[3] and len(set(w.prints.tolist())) == 3
    assert dedup_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_what_repeats_leave_on_disk(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long), (2, f"x {long} y"), (3, f"{long} z {long}"), (4, long), (5, " ".join(f"w{i}" for i in range(7, 40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    for kw in ({}, {"hot_segments": 0}, {"hot_rows": 1, "broadcast_rows": 0}):
        got = repeats(df.select("doc_id", F.xxhash64("text").alias("th"), F.xxhash64(F.lit(7), "text").alias("also"), "text"), **kw)
        assert {r["doc_id"]: (r["spans"], r["copied"]) for r in got.collect()} == {2: ([1, 301], False), 3: ([0, 300, 301, 601], False), 4: ([], True), 5: ([0, 33], False)}
        left = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before
        assert len(left) == 1 and left.pop().startswith("repeats-")
        before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
