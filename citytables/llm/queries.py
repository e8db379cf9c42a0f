"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citytables.llm.common import table
from citytables.llm.decontam import contamination
from citytables.llm.html import extract
from citytables.llm.language import identify, train
from citytables.llm.licenses import license_scan
from citytables.llm.neardup import near_duplicates
from citytables.llm.packing import packed_documents
from citytables.llm.sharding import kd_shards
from citytables.llm.substring import dedup_digest
from citytables.llm.tokenfile import read_token_files, token_file_path, write_token_files
from citytables.llm.topk import exact_topk


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy short notices of every document."""
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written as frequency-ranked variable-length codes and read back."""
    path = token_file_path(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, end_id=2)
    return read_token_files(spark, path, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labels of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page, by the site style trees of the hosts."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every vector whose id is divisible by 100."""
    return exact_topk(table(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0, k=10)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left after the repeats of 20-word windows are removed."""
    return dedup_digest(table(spark, sf_dir, "documents"), size=20)


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of nearly equal bytes, by a k-d tree over its metadata."""
    placed = kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on 3-word shingles at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids cut and packed into sequences of at most 1024."""
    packed = packed_documents(table(spark, sf_dir, "documents"), end_id=0, capacity=1024)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_token_files": op2_token_files,
        "op3_language_id": op3_language_id,
        "op4_html_extraction": op4_html_extraction,
        "op5_decontamination": op5_decontamination,
        "op6_exact_topk": op6_exact_topk,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_kd_sharding": op8_kd_sharding,
        "op9_minhash_neardup": op9_minhash_neardup,
        "op10_ffd_packing": op10_ffd_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": OP6_SQL}


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
