"""License scan against a plain search, and planted edits."""

import random
import re

from citytables.llm.licenses import BASE, NOTICES, WORD, license_scan, scan, seeds

SCHEMA = "doc_id long, text string, labels string, score int"


def brute(text):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_places(spark):
    r = random.Random(2)
    vocabulary = "MIT License mit-license apache license, general PUBLIC license the mits xmit É_mit İ K \n".split(" ")
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60))) for _ in range(200)]
    texts += [None, "", "  ", "mit license" * 3, "word " * 50_000 + "MIT license", "MIT license mit license"]
    rows = [(i % 150, t, "extra", None) for i, t in enumerate(texts)]
    got = sorted(license_scan(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect(), key=lambda x: (x["doc_id"], x["n_words"], x["n_base"], str(x)))
    want = sorted(((d, *brute(t)) for d, t, _, _ in rows), key=str)
    assert sorted(((g["doc_id"], g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) for g in got), key=str) == want
    assert all(set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) for g in got)
    assert all(0 <= g["score"] <= 1 and (g["score"] > 0) == bool(g["labels"]) for g in got)


def test_planted_edits():
    r = random.Random(5)
    for phrase, label, edits in NOTICES:
        assert "".join(p for p, _ in seeds(phrase, edits)) == phrase and len(seeds(phrase, edits)) == edits + 1
        for _ in range(20):
            s = list(phrase)
            for _ in range(r.randrange(0, edits + 1)):
                at = r.randrange(1, len(s) - 1)
                if s[at] != " ":
                    s[at] = r.choice("xqz")
            _, found = scan("some words " + "".join(s) + " more words")
            hit = [f for f in found if f[0] == phrase]
            assert hit and hit[0][1] == label and hit[0][4] <= edits, (phrase, "".join(s), found)
            assert hit[0][2] == 2
    assert scan("the mitigated licence of nothing at all") == (7, [])


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spans_by_brute_force():
    r = random.Random(8)
    notices = (("all rights reserved", "p", 1), ("mozilla public license", "m", 2), ("boost software license", "b", 1))
    for _ in range(150):
        words: list[str] = []
        for _ in range(r.randrange(1, 5)):
            s = list(r.choice(notices)[0])
            for _ in range(r.randrange(0, 4)):
                at = r.randrange(len(s))
                s[at : at + r.randrange(0, 2)] = r.choice(["", "x", "l", " ", "e"])
            words += "".join(s).split() + [r.choice(["fire", "wall", "all", "license", "xmozilla"])] * r.randrange(0, 2)
        _, found = scan(" ".join(words), (), notices)
        for phrase, _, edits in notices:
            mine = [(f[2], f[3], f[4]) for f in found if f[0] == phrase]
            assert all(distance(" ".join(words[a : z + 1]), phrase) <= e <= edits for a, z, e in mine)
            for a in range(len(words)):
                for z in range(a, min(len(words), a + 5)):
                    if distance(" ".join(words[a : z + 1]), phrase) <= edits:
                        assert any(x <= z and a <= y for x, y, _ in mine), (words, phrase, a, z, mine)


def test_words_are_whole_and_neighbours_apart():
    assert scan("firewall rights reserved")[1] == []
    _, found = scan("gnu generxl public license gnu general public license")
    assert [(f[2], f[3], f[4]) for f in found if f[0] == "gnu general public license"] == [(0, 3, 1), (4, 7, 0)]
