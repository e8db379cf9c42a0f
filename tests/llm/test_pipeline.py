"""The pipeline, stage by stage, against brute force on a made corpus."""

import random
import re

import public_tokenizers
from test_decontam import words_of
from test_neardup import brute as near_brute
from tokenizers import Tokenizer

import corpus_pipeline
from citytables.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    en = [a + b for a in "th wh st br an or in re".split() for b in "e is at en ing er ly".split()]
    de = [a + b for a in "sch ver be zw gr un ei ö".split() for b in "ung en st ä keit lich".split()]
    say = lambda v, n: " ".join(r.choice(v) for _ in range(n))
    bench = [(i, say(en, r.randrange(6, 30)), None) for i in range(10)]
    shared = [say(en, 40) for _ in range(3)]
    texts = []
    for i in range(60):
        v, lang = (en, "en") if i % 3 else (de, "de")
        t = say(v, r.randrange(30, 120))
        if i % 7 == 0:
            t += "\n" + r.choice(shared) + "\n" + say(v, 20)
        if i % 9 == 0:
            t += " " + r.choice(bench)[1] + " " + say(v, 5)
        texts.append((t, lang))
    texts += [(texts[4][0] + " tail", "en"), (texts[5][0], "en"), (texts[5][0], None), ("", None), (None, "en"), ("12 34 !!", None)]
    return [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)], bench


def test_stages(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string, x string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(sorted(docs.collect(), key=lambda x: (x["doc_id"], x["start"] if "start" in docs.columns else 0)))
    language, near, parts, clean, packed = seen
    assert {x["doc_id"] for x in language} == {d for d, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    assert {x["doc_id"] for x in near} == {d for d, _, _, keep in near_brute([tuple(x) for x in language], 5, 80) if keep}

    first, words = {}, {x["doc_id"]: x["text"].split() for x in near}
    for d in sorted(words):
        for i in range(len(words[d]) - 19):
            first.setdefault(tuple(words[d][i : i + 20]), (d, i))
    for x in parts:
        w = words[x["doc_id"]]
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (x["doc_id"], i) for j in range(i, i + 20)}
        assert x["text"].split() == [y for j, y in enumerate(w) if j not in gone] and x["n_chars"] == len(x["text"])
    assert len(parts) == len(near) and sum(len(x["text"]) for x in parts) < sum(len(x["text"]) for x in near)

    windows = set()
    for _, t, _ in bench:
        b = words_of(t)
        windows |= {tuple(b[i : i + min(10, len(b))]) for i in range(len(b) - min(10, len(b)) + 1)}
    for x, y in zip(parts, clean, strict=True):
        w = words_of(x["text"])
        hit = {j for n in {len(v) for v in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        assert words_of(y["text"]) == [v for j, v in enumerate(w) if j not in hit]
        if not hit:
            assert tuple(x) == tuple(y)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {x["doc_id"]: len(tokenizer.encode(x["text"], add_special_tokens=False).ids) + 1 for x in clean}
    assert {x["doc_id"]: x["doc_tokens"] for x in packed} == n and sum(x["length"] for x in packed) == sum(n.values())


def test_registered(spark):
    assert queries()["pipeline"] is corpus_pipeline.run and [s for s, _ in corpus_pipeline.STAGES][0] == "language_id"
