"""Exact top-k against brute force."""

import math
import random

from citytables.llm.topk import exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every:
            continue
        hits = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


def run(spark, rows, every=5, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, exact_topk(df, lambda c: c % every == 0, **kw).collect()))


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.25, r.random() - 0.5]) for _ in range(7)], 0) for i in range(300)]
    rows = [(i, rows[3][1] if i % 3 == 0 else v, None) for i, v, _ in rows]  # a third of all rows are copies
    rows += [(900, None, 1), (905, [0.5, None, 1.0] + [0.0] * 4, 1), (910, [float("nan")] * 7, 1), (915, [float("inf")] + [0.0] * 6, 1), (920, [0.0] * 7, 1), (925, [3e3] * 7, 2)]
    assert run(spark, rows, block_queries=16) == brute(rows, 10, 5)


def test_phases_touch_less_and_less(spark, monkeypatch):
    from citytables.llm import topk

    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(16)], 0) for i in range(3000)]
    sizes = {}
    real = topk.written
    monkeypatch.setattr(topk, "written", lambda df, tag: sizes.setdefault(tag, real(df, tag)) and sizes[tag])
    monkeypatch.setattr(topk, "dropped", lambda df: None)
    assert run(spark, rows, every=100) == brute(rows, 10, 100)
    counts = {tag: df.count() for tag, df in sizes.items()}
    products = 3000 * 30
    assert counts["topk-entries"] < 0.3 * 2 * products  # phase 2: of the entries of two lists
    missing = sizes["topk-partial"].where("has <> 3").count()
    assert 0 < missing <= counts["topk-partial"] <= counts["topk-entries"]
    assert counts["topk-hits"] < 0.05 * products


def test_huge_values(spark):
    rows = [(i, [float(i * 2**14), float(-i), 1.0], 0) for i in range(20)]
    assert run(spark, rows) == brute(rows, 10, 5)


def test_few_or_none(spark):
    rows = [(0, [1.0, 2.0], 0), (7, [1.0, 2.0], 0)]
    assert run(spark, rows) == brute(rows, 10, 5) and len(run(spark, rows)) == 1
    assert run(spark, []) == []
