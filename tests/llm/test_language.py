"""Language ID: Viterbi against brute force, held-out accuracy, mixed texts, scripts, edge cases."""

import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from citytables.llm import language
from citytables.llm.language import OTHER, fit, identify, letter_runs, scripts_of, train, viterbi
from citytables.llm.queries import op3_language_id

SCHEMA = "doc_id long, text string, lang string, score double"


def test_viterbi_is_exact():
    r = np.random.default_rng(0)
    for sizes, block in (([5, 0, 3, 7, 1], 2), ([6, 6], 32), ([0, 4], 3)):
        scores = r.normal(size=(sum(sizes), 3)) * 3
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        got = viterbi(scores, bounds, 2.0, block)
        for a, z in itertools.pairwise(bounds):
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in itertools.pairwise(p))
            best = max(map(value, itertools.product(range(3), repeat=z - a)))
            assert abs(value(got[a:z].tolist()) - best) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert got[0] > 150 and got[1] > 0.95, got


def test_mixed_text_and_edges(spark):
    model = fit([("en", ["the", "with", "that", "and", "which"] * 20), ("de", ["und", "nicht", "über", "schön", "zwischen"] * 20), ("ru", ["это", "что", "как", "не"] * 20)])
    en, de = ["the", "which", "that", "and", "with"] * 6, ["nicht", "über", "und", "schön", "zwischen"] * 6
    rows = [(1, " ".join(en + de), None, 1.0), (2, None, "x", 1.0), (3, "12 34 -- !!", "x", 1.0), (4, "", None, 1.0), (5, "что это и не", None, 1.0), (6, "漢字", None, 1.0), (7, "the " * 60_000, None, 1.0), (7, "the " * 3, None, 1.0)]
    got = identify(spark.createDataFrame(rows, SCHEMA), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and [tuple(s) for s in by[1]["spans"]] == [("en", 0, 30), ("de", 30, 60)]
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["spans"] == [] for i in (2, 3, 4))
    assert by[5]["lang_pred"] == "ru" and by[7]["lang_pred"] == "en" and by[6]["lang_pred"] in model.languages and by[6]["score"] < 0.1
    assert all(0 <= r["score"] <= 1 for r in got)
    points = scripts_of(np.array([ord(c) for c in "ézд\u0300"]))
    assert points[0] == points[1] != points[2] and points[3] == OTHER
    assert np.allclose(model.word_scores(["the", "über", "the" * 40]), np.concatenate([model.word_scores([w]) for w in ("the", "über", "the" * 40)]), atol=1e-3)
    empty = spark.createDataFrame([], SCHEMA)
    assert train(empty) is None and identify(empty, None).collect() == []
    assert {r["lang_pred"] for r in identify(spark.createDataFrame(rows, SCHEMA), None).collect()} == {"und"}


def test_one_language_corpus(spark):
    rows = [(1, "the which that and with", "en", 1.0), (2, "with the that", "en", 1.0), (3, "что это", None, 1.0), (4, "12 !!", None, 1.0), (5, None, "en", 1.0)]
    model = train(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "en", "en", "und", "und"]
    assert got[1]["score"] == got[2]["score"] == 1.0 and got[3]["score"] < 0.1
    kept = lambda rows: {r["doc_id"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept(rows) == {1, 2}
    assert kept([(i, t, None, s) for i, t, _, s in rows]) == {1, 2, 3}
    assert kept([(i, t, "en" if i == 4 else None, s) for i, t, _, s in rows]) == {1, 2, 3}  # a label of a text without a word


def test_sample_does_not_shrink(spark, monkeypatch):
    monkeypatch.setattr(language, "fit", lambda rows: rows)
    docs = spark.range(4_000_000).select(F.col("id").alias("doc_id"), F.lit("the which").alias("text"), F.when(F.col("id") % 4000 == 0, "de").otherwise("en").alias("lang"))
    assert Counter(lang for lang, _ in train(docs)) == {"en": 400, "de": 400}
    repeated = docs.withColumn("doc_id", F.col("doc_id") % 600)  # each id many times
    assert Counter(lang for lang, _ in train(repeated.where("lang = 'en'"))) == {"en": 400}


def test_long_runs_are_scored_whole(spark):
    r = np.random.default_rng(3)
    zh, ja = ["".join(r.choice(list(v), 30)) for v in ("的一是不了人我在有他", "日本語学校先生電車時")]
    kana = "これはひらがなのぶんしょうです"
    model = fit([("zh", letter_runs(zh * 20)), ("ja", letter_runs((ja + kana) * 20)), ("ru", letter_runs("это что как не " * 20))])
    assert letter_runs("ab12 Привет漢字kana " + "x" * 95) == ["ab", "Привет", "漢字", "kana", "x" * 40, "x" * 40, "x" * 15]
    assert letter_runs("azərbaycan əl") == ["azərbaycan", "əl"]  # letters outside all ranges go on with their run
    assert model.word_scores(["əя"]).argmax() == model.languages.index("ru")
    rows = [(1, zh * 2 + (ja + kana) * 10, None, 1.0), (2, "это" * 20 + kana * 40, None, 1.0), (3, zh * 9, None, 1.0)]
    by = {x["doc_id"]: x for x in identify(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["ja", "ja", "zh"]
    assert [s["lang"] for s in by[2]["spans"]] == ["ru", "ja"] and by[1]["spans"][0]["lang"] == "zh"
    assert language.Grams(["x" * 95]).count[0] > 2 * language.Grams(["x" * 40]).count[0]  # no letter is passed over


def test_letters_are_unicode_letters(spark):
    model = fit([("en", ["the", "with"] * 9), ("hi", letter_runs("हिन्दी भाषा में लिखा हुआ पाठ " * 9))])
    rows = [(1, "½ ² Ⅷ ٣ ①", None, 1.0), (2, "हिन्दी भाषा में", None, 1.0), (3, "\u0301\u0302", None, 1.0), (4, "the ½", None, 1.0)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1, 3)] == [("und", 0.0)] * 2
    assert got[2]["lang_pred"] == "hi" and got[4]["lang_pred"] == "en"
    assert letter_runs("हिन्दी e\u0301t 2x½y") == ["हिन्दी", "e\u0301t", "x", "y"]


def test_columns_of_any_name_are_carried(spark):
    rows = [(1, "the which that", "en", 1.0, "a"), (2, "12", None, 2.0, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __score double, LANG_PRED string")
    kept = corpus_pipeline.language_id(spark, df, "")
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [rows[0]]


def test_word_scores_by_brute_force():
    """The model written plainly: n-grams of marked words, counts to the power, logarithms."""
    rows = [("en", ["the", "with", "the", "this"]), ("de", ["und", "mit", "und", "und"])]
    model = fit(rows)
    features = lambda w: [("g", f"<{w}>"[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(w) + 3 - n)] + [("w", w)]
    log_p = {}
    for lang, words in rows:
        counts = Counter()
        for w, n in Counter(words).items():
            for f in features(w):
                counts[f] += n**0.75
        total = sum(counts.values()) + 0.05 * language.BUCKETS
        log_p[lang] = lambda f, c=counts, t=total: np.log((c[f] + 0.05) / t)
    for w in ("the", "unit", "zzz"):
        raw = np.array([sum(log_p[lang](f) for f in features(w)) / np.sqrt(len(features(w))) for lang in model.languages])
        assert np.allclose(model.word_scores([w])[0], np.maximum(raw - raw.max(), language.FLOOR), atol=1e-3)
