"""Near duplicates against brute force on sets, chains, hot groups and edge cases."""

import random
import re

import numpy as np

from citytables.llm import neardup
from citytables.llm.neardup import components, keep_one, near_duplicates

SCHEMA = "doc_id long, text string, id string, comp int"


def sets(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size, percent):
    own = {d: sets(t, size) for d, t, *_ in rows}
    up = {d: d for d in own}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(own[d]), root(d), root(d) == d) for d in own)


def made():
    r = random.Random(6)
    word = lambda: r.choice("alpha Beta gamma Ünder delta eps zeta eta theta iota kappa mu nu xi".split()) + str(r.randrange(30))
    rows = []
    for base in range(25):
        w = [word() for _ in range(r.randrange(30, 200))]
        chain = list(w)
        for _ in range(r.randrange(0, 9)):  # a chain: the ends differ, neighbours don't
            chain = list(chain)
            chain[r.randrange(len(chain))] = word()
            rows.append(r.choice([" ", "  ", "\n"]).join(chain))
        rows.append(" ".join(w).upper())
    rows += [rows[5]] * 40 + ["", None, " ", "one", "One", "two words", "two  Words", "x y z " * 3000, "x y z " * 3001]
    order = list(range(len(rows)))
    r.shuffle(order)
    return [(order[i], t, "q", None) for i, t in enumerate(rows)]


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 3, 85)
    assert sorted(map(tuple, near_duplicates(df, size=3, percent=85, block=4).collect())) == want
    kept = {r["doc_id"] for r in keep_one(df, size=3, percent=85, broadcast_rows=0).collect()}
    assert kept == {d for d, _, _, k in want if k}


def test_tables_meet(spark):
    r = np.random.default_rng(1)
    lost = 0
    for _ in range(300):
        base = r.integers(0, 2**63, 300).astype(np.uint64)
        other = base.copy()
        other[:24] = r.integers(0, 2**63, 24).astype(np.uint64)  # similarity 0.85
        h = neardup.half_keys([np.sort(base), np.sort(other)])
        lost += neardup.first_tables(h[:1], h[1:], neardup.ROWS)[0] < 0
    assert lost <= 6


def test_pairs_at_the_threshold(spark):
    r, rows = random.Random(4), []
    for i in range(0, 1200, 2):
        w = [f"w{r.randrange(10**9)}" for _ in range(182)]
        other = list(w)
        for at in range(20, 20 + 6 * 10, 10):  # 6 words change 18 of 180 shingles: 162 of 198 in common, 0.82
            other[at] = f"x{r.randrange(10**9)}"
        rows += [(i, " ".join(w), "x", 1), (i + 1, " ".join(other), "x", 1)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), size=3, percent=81).where("kept").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(0, 1200, 2))


def test_tables_by_threshold():
    for percent in (40, 60, 80, 81, 85, 95, 100):
        assert neardup.meeting(percent / 100, neardup.rows_for(percent)) >= neardup.RECALL
    assert neardup.rows_for(80) == neardup.rows_for(85) == 12 and neardup.meeting(0.85, 12) > 0.99997


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 150 and len(got) == 45


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "x", 1), (2, None, "x", 1), (2, "a b c d", "x", 1), (3, "q", "x", 1)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA), size=3, percent=85).collect()))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False), (3, 1, 3, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_each_pair_with_a_stray_meets_once():
    r = random.Random(1)
    for _ in range(200):
        n, blocks, groups = r.randrange(2, 14), r.randrange(1, 4), r.randrange(1, 4)
        members = [(i, r.random() < 0.4, r.randrange(blocks), r.randrange(groups)) for i in range(n)]
        tasks: dict = {}
        for i, stray, own, mine in members:
            for g in range(groups):
                tasks.setdefault((own, g), []).append((i, 0 if not stray else 2 if g == mine else 3))
            for b in range(blocks):
                if stray and b != own:
                    tasks.setdefault((b, mine), []).append((i, 1))
        met = [(i, j) for t in tasks.values() for k, (i, a) in enumerate(sorted(t)) for j, c in sorted(t)[k + 1 :] if neardup._MEET[a, c]]
        assert sorted(met) == [(x[0], y[0]) for x in members for y in members if x[0] < y[0] and (x[1] or y[1])]


def test_documents_without_an_id(spark):
    rows = [(None, "a b c d e", "x", 1), (None, "a b c d e", "x", 1), (4, "a b c d e", "x", 1), (None, "q r s t", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(df, size=3, percent=85).collect()
    assert sorted((r["n_shingles"], str(r["component_id"])) for r in got) == [(2, "None"), (3, "4"), (3, "4"), (3, "4")]
    assert keep_one(df.withColumnRenamed("comp", "gone"), size=3, percent=85).count() == 4  # rows without an id stay
