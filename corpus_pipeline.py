"""The corpus pipeline: raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
in the shared folder and reread as the next one's ``docs``.  All but the last return the
columns of their ``docs``, further columns included.

    language_id    rejects documents whose language can't be told: those without a letter, and
                   those whose most frequent language has less than two fifths of the letters
    exact_dedup    of equal texts the row of the smallest id stays
    jaccard_join   of near duplicates (0.8 on shingles of five words) one document stays
    mixing         sources are brought to their target weights: a document stays as often
                   as the mix takes it - not at all, once or twice
    word_bpe       token ids, and digests of ids and decoded text

Null texts have no letter and go in the first stage; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoflow.llm import exact_dedup, jaccard_join, language_id, mixing, word_bpe
from tomoflow.llm.common import column, remainder, stash

TOKENIZER = "word_bpe_49k.json"


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(remainder(column(docs, "doc_id", "long"), 4) != 2))
    return language_id.known_language(docs, model)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_class(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = word_bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", told_language),
    ("exact_dedup", first_copies),
    ("jaccard_join", one_of_near_duplicates),
    ("mixing", mixed_sources),
    ("word_bpe", encoded),
]

#: Language models, sampled paths and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
