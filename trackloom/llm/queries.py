"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op3_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op4_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import pack_conversations, read_back, with_forged

    return read_back(pack_conversations(with_forged(table(spark, sf_dir, "conversations"))))


def op5_progressive_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import load, store

    # the tensors are made and given out with every row; the contract's columns are those below
    return load(store(table(spark, sf_dir, "documents")), tensors=True).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import token_digest

    return token_digest(table(spark, sf_dir, "documents"))


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents"), digest=True)


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_histogram

    out = shard_by_histogram(table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_from_tables, held_out, score_documents

    docs = table(spark, sf_dir, "documents")
    model = fit_from_tables(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_mix_sources, op3_anisotropic_search, op4_chat_prefix_tree, op5_progressive_media, op6_simhash_pigeonring, op7_sentencepiece, op8_repeated_phrases, op9_histogram_shards, op10_toxicity_kernel)}
#: None of the ten can be stated in SQL that runs over whole tables; tests/llm/test_op_queries.py holds each against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
