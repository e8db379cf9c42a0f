"""FM-index and decontamination against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from citytables.llm.decontam import contamination, decontaminate, words_of
from citytables.llm.fmindex import FMIndex, suffix_array

DOCS = "doc_id long, text string, lang string, items string"
BENCH = "item_id long, text string, doc_id long"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 3), min_size=3, max_size=3), min_size=1, max_size=6))
def test_fm_index(text, patterns):
    t = np.array(text)
    assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: text[i:])
    index = FMIndex(t, 3, sample=4)
    lo, hi = index.search(np.array(patterns))
    which, where = index.occurrences(lo, hi)
    want = sorted((k, i) for k, p in enumerate(patterns) for i in range(len(text) - 2) if text[i : i + 3] == p)
    assert sorted(zip(which.tolist(), where.tolist())) == want


def occurs(text, piece):
    return [i for i in range(len(text) - len(piece) + 1) if text[i : i + len(piece)] == piece]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 4), max_size=12), min_size=1, max_size=4), st.integers(1, 6))
def test_matching_statistics(text, streamed, longest):
    index = FMIndex(np.array(text), 3, longest=longest)
    sizes = np.array([len(s) for s in streamed])
    starts = np.cumsum(sizes) - sizes
    found, lo, hi = index.matching_statistics(np.array([x for s in streamed for x in s], dtype=np.int64), starts, sizes)
    for s, at in zip(streamed, starts.tolist()):
        for i in range(len(s)):
            best = max((n for n in range(1, min(longest, len(s) - i) + 1) if 0 not in s[i : i + n] and occurs(text, s[i : i + n])), default=0)
            assert found[at + i] == best
            if best:
                assert sorted(index.locate(np.arange(lo[at + i], hi[at + i])).tolist()) == occurs(text, s[i : i + best])


def brute(docs, bench, size=10):
    out = []
    for doc, text, *_ in docs:
        w = words_of(text)
        hit, items = set(), set()
        for item, t, _ in bench:
            b = words_of(t)
            n = min(size, len(b))
            for i in range(len(b) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit.update(range(j, j + n))
                        items.add(str(item))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def made():
    r = random.Random(4)
    word = lambda: r.choice(["a", "B", "c", "dé", "e1"])
    bench = [(i, " ".join(word() for _ in range(r.randrange(5, 25))), 0) for i in range(25)] + [(30, None, 1), (31, "", 1), (32, "...", 1), (33, "Q, r s", 1), (34, "solo", 1), (10, "x " * 12, 1)]
    docs = []
    for i in range(120):
        t = " ".join(word() for _ in range(r.randrange(0, 40)))
        if i % 3 == 0:
            t += "\n" + (r.choice(bench)[1] or "").upper().replace(" ", " - ") + " end q R; s tail"
        docs.append((i % 100, t, None, None))
    return docs + [(500, None, "x", None), (501, "", "x", None), (502, "solo", "x", None), (503, "x " * 30_000, "x", "y")], bench


def test_against_brute_force(spark):
    docs, bench = made()
    want = brute(docs[:-1], bench)
    for kw in ({}, {"block_windows": 40, "shard_words": 100}):
        got = contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, BENCH), **kw).collect()
        big = [tuple(g) for g in got if g["doc_id"] == 503]
        assert big[0][1:4] == (30_000, 30_000, 1)
        assert sorted(tuple(g) for g in got if g["doc_id"] != 503) == want


def test_stripped_texts(spark):
    docs = [(1, "Keep this. ONE two, three four five! Six seven eight nine ten eleven and that.", "en", None), (2, None, "en", None), (3, "clean, text", None, "z")]
    bench = [(1, "one two three four five six seven eight nine ten", 0)]
    got = {r["doc_id"]: r for r in decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()}
    assert got[1]["text"] == "Keep this.  eleven and that." and got[2]["text"] is None and got[3]["text"] == "clean, text" and got[3]["items"] == "z"


def test_empty(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    assert contamination(d, spark.createDataFrame([(1, "a b", 1)], BENCH)).collect() == []
    assert tuple(contamination(spark.createDataFrame([(1, "a b", "x", "y")], DOCS), b).first())[:4] == (1, 2, 0, 0)
