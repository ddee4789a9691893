"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, tokens. Each stage works on all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet to a shared
folder and reads it again as the next one's docs. The stages before the mix
return the columns of documents; the mix adds PLACE, which the last stage returns too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import common, mixing, secrets, sentencepiece_bpe, simhash, toxicity


#: A document's place in the mix: the columns that the mixing stage adds and the last one returns.
PLACE = ("slot", "at_byte")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on labelled documents of docs outside the held-out fold.

    Null and empty texts are scored like others; whole texts are; repeated rows stay or go together; an empty table, or one without labels of both kinds, loses nothing."""
    return toxicity.drop_toxic(docs, toxicity.fit_from_tables(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share at least 0.8 of their five-word shingles, directly or through others, the smallest doc_id stays.

    Null texts count as empty ones and all of these as equal; of repeated rows one stays; null doc_ids come last; texts are compared whole; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become marks; every document stays, repeated ones too, and n_chars follows the text. A null text stays null; an empty table stays empty."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated ones too, and gets its place in the mix: slot and at_byte. A null source is a source of its own; an empty table stays empty."""
    kept = [c for c in docs.columns if c not in PLACE]
    placed = mixing.mix_sources(docs, keep=("doc_id", "source", *[c for c in kept if c not in ("doc_id", "source")]))
    return placed.repartitionByRange("slot", "at_byte", "doc_id").sortWithinPartitions("slot", "at_byte", "doc_id").select(*kept, *PLACE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its place in the mix, the number of tokens and digests of the ids and of the text they decode to. The mix is read in the order (slot, at_byte, doc_id).

    A null text has no tokens; a row for each document, repeated ones too; an empty table gives an empty result."""
    return sentencepiece_bpe.token_digest(docs, keep=("doc_id", "source", *PLACE))


STAGES = [("toxicity", toxic), ("near-duplicates", near_duplicates), ("secrets", redact), ("mixing", mix), ("tokens", tokens)]

#: Two stages can't be stated in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next stage's one is written, what it needed on the way when its own is."""
    docs = common.table(spark, sf_dir, "documents")
    top = f"{common.shared_dir(spark)}/trackloom-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with common.scratch(spark):
            made = stage(spark, docs, sf_dir)
            with common.shuffles_removed(spark):
                made.write.parquet(f"{top}/{k}")
        if k:
            common.delete(spark, f"{top}/{k - 1}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
