"""From raw documents to an encoded training mix: five stages, each written as a table and read again.

1. toxicity: documents that the calibrated trees call toxic go.
2. language_id: documents without a letter go, and those whose letters fit their best language worse than its own texts do.
3. near_dedup: one document of each group of SimHash near-duplicates stays, that of the smallest id.
4. mixing: each document is repeated as often as the mix to target weights takes it; those it does not take go.
5. bpe: every document left is encoded; its ids, their number and digests are returned.

Results: a null text is empty: it is not toxic, has no language and goes in stage 2.  Rows with a null id pass like
others.  Columns beyond those of ``documents`` are dropped at the start.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewatch.llm import bpe, langid, mixing, simhash, toxicity
from rolewatch.llm.common import read, stored
from rolewatch.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).where(F.col("predicted") == 0).select(*COLUMNS)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = stored(langid.identify(docs, langid.learn_from_documents(docs), fit="fit"))
    least = langid.least_fits_of(langid.given_to_learn(found))
    return found.where(langid.of_a_language(F.col("lang_pred"), F.col("fit"), F.col("letters"), least)).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(docs.select("doc_id", "source", "text"), ids="ids", decoded="decoded")
    return encoded.select(
        "doc_id",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_unknown_language),
    ("near_dedup", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trees, calibration, fingerprints and merges are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet below the shared checkpoint folder and reads it again.

    A run has a folder ``corpus-<id>`` of its own there, with a table per stage; the language stage leaves a folder ``stored-<id>``.  The result reads the last of them; once the result has been
    used, the folder may be removed.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
