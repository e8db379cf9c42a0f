"""The training-data pipeline over documents: language, near copies, repeats, benchmark words, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which run() writes as Parquet and reads again as the next stage's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citytables.llm.common import free_names, new_path, rested, table
from citytables.llm.decontam import decontaminate
from citytables.llm.language import identify, train
from citytables.llm.neardup import keep_one
from citytables.llm.packing import packed_documents
from citytables.llm.substring import dedup_texts

#: A document goes if less than this share of its letters can be told to be in its main language.
LEAST_LANGUAGE_SCORE = 0.4


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = LEAST_LANGUAGE_SCORE) -> DataFrame:
    """Documents whose text has a language; those without a letter, or with less than least_score of it, go.

    Without labels to learn from no language can be told, and all documents with a letter stay.
    """
    rested(spark)
    model = train(docs.select("doc_id", "text", "lang"))
    lang, score, letters = free_names(docs.columns, "lang_pred", "score", "letters")
    kept = identify(docs, model, carry=docs.columns, names=[lang, score, letters])
    if model is None:
        return kept.where(F.col(letters) > 0).select(*docs.columns)
    return kept.where((F.col(lang) != "und") & (F.col(score) >= least_score)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    rested(spark)
    return keep_one(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word passages that an earlier document (or place) has."""
    rested(spark)
    return _counted(dedup_texts(docs, size=20))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows."""
    rested(spark)
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 ids."""
    rested(spark)
    return packed_documents(docs, end_id=0, capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Models, sketches and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
