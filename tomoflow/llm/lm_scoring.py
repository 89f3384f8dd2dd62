"""Scores of whole texts: context-tree weighting beside an additive unigram base.

The base counts every training token (words in lower case A-Z, and one end a text).
Its word counts grow with the corpus, so only the ``head_words`` most frequent words (a
bound) go to the workers; a text's other words are joined to the counts by word.
The texts' own rows take part in that join under keys of their own, which match nothing
and spread evenly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoflow.llm import context_tree
from tomoflow.llm.common import small_batches, stash, working

HEAD_WORDS = 200_000
END = b""  # no word is empty: the key of the end token
ROWS = "row long, doc_id long, held_out boolean, n_tokens long, known long, part double, word binary, times long"


KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64()]


def _rows(*columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in ROWS.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def count_words(texts: DataFrame) -> DataFrame:
    """word, c: how often training texts have it; the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(decompress(text.as_py()).split())
                held[END] += 1
            if len(held) > 300_000:
                yield rows()
                held.clear()
        if held:
            yield rows()

    rows = texts.where(F.coalesce(~F.col("held_out"), F.lit(False))).select("text")
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, depth: int = context_tree.DEPTH
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    small_batches(spark)
    texts, grams = context_tree.cut_in_chunks(docs, held_out, id_col, text_col, depth)
    scores = stash(context_tree.score_chunks(texts, grams, depth), "scores")
    counts = stash(count_words(texts), "words")
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    head = counts.orderBy(F.col("c").desc(), "word").limit(head_words).toArrow()
    known = dict(zip(head.column("word").to_pylist(), np.log10(head.column("c").to_numpy() + 0.1).tolist(), strict=True))
    shared = spark.sparkContext.broadcast(known)
    per_token = float(np.log10(n + 0.1 * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("lm_scoring"):
            head_logs = shared.value
            for batch in batches:
                rows, ids, held = (batch.column(i).to_pylist() for i in range(3))
                codes = batch.column(3)
                at = 0
                while at < len(codes):
                    stop, total = at, 0
                    tails: tuple[list, list, list] = ([], [], [])  # rows, words, times of words that aren't frequent
                    parts, known_tokens, lengths = [], [], []
                    while stop < len(codes) and total < context_tree.CHUNK_BYTES:
                        code = decompress(codes[stop].as_py())
                        words = code.split()
                        total += len(code) + 1
                        tokens = Counter(words)
                        tokens[END] += 1
                        part, n_known, before = 0.0, 0, len(tails[1])
                        for word, times in tokens.items():
                            log = head_logs.get(word)
                            if log is None:
                                tails[1].append(word)
                                tails[2].append(times)
                            else:
                                part += times * log
                                n_known += times
                        tails[0].extend([rows[stop]] * (len(tails[1]) - before))
                        lengths.append(len(words) + 1)
                        known_tokens.append(n_known)
                        parts.append(part - per_token * lengths[-1])
                        stop += 1
                    few = slice(at, stop)
                    keys = [b"\0" + str(r).encode() for r in rows[few]]  # no word: a key of its own
                    yield _rows(rows[few], ids[few], held[few], lengths, known_tokens, parts, keys, np.zeros(len(keys), np.int64))
                    n = len(tails[0])
                    if n:
                        none = np.zeros(n, np.int64)
                        yield _rows(tails[0], pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), none, none, none.astype(float), tails[1], tails[2])
                    at = stop

    parts = texts.select("row", "doc_id", "held_out", "text").mapInArrow(run, ROWS)
    other = parts.join(counts.select(F.col("word").alias("c_word"), "c"), F.col("word") == F.col("c_word"), "left")
    log = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).otherwise(0.0)
    met = F.when((F.col("times") > 0) & F.col("c").isNotNull(), F.col("times")).otherwise(0)
    return (
        other.unionByName(scores, allowMissingColumns=True)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("known") + met).alias("n_known"),
            F.sum(F.col("part") + log).alias("base_score"),
            F.sum("score").alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )
