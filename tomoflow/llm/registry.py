"""The thin queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoflow.llm import (
    collocations,
    exact_dedup,
    fill_in_middle,
    jaccard_join,
    language_id,
    lm_scoring,
    mixing,
    simhash,
    token_files,
    top_k,
    toxicity,
    url_filter,
    word_bpe,
)
from tomoflow.llm.common import SPACE, load, remainder, scratch_path


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard_join.jaccard_classes(load(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "n_links", "n_shingles")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    field = toxicity.train(docs.where(~held_out), load(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, field)
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "spans")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(load(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = language_id.identify_documents(docs, language_id.train(docs.where(~held_out)), spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return word_bpe.digests(word_bpe.encode_documents(load(spark, sf_dir, "documents"), path))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    token_files.write_token_files(load(spark, sf_dir, "documents"), path, ranks, public_tokenizers.PATTERN)
    return token_files.read_documents(spark, path)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(load(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_top_k": op2_top_k,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_source_mixing": op5_source_mixing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language_id": op7_language_id,
    "op8_word_bpe": op8_word_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_files": op10_token_files,
    "op11_simhash": op11_simhash,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op2_top_k": top_k.oracle_sql(),
    "op3_url_filter": url_filter.oracle_sql(),
    "op5_source_mixing": mixing.oracle_sql(),
    "op9_exact_dedup": f"""
WITH shas AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM shas WINDOW same AS (PARTITION BY text_sha256)""",
    "op12_fill_in_middle": fill_in_middle.oracle_sql(),
    "op13_collocations": collocations.oracle_sql(),
}
