"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a stretch of letters.  The script of its first letter narrows the languages
to those that write it in training texts.  Each remaining language scores the word by
the log probabilities of its letter triples, edges of the word included.  Viterbi then
labels the words of a text so that the scores less ``switch_penalty`` for each change
of language are highest; runs of one label are the spans.  The text's language is the
one with the most letters in its spans, and its score that share of the letters.

Model: counts of triples, hashed to ``bins`` bins, a language, from at most
``docs_per_lang`` distinct training texts of each language, chosen by a hash of the text
(a bounded sample; whole texts, equal ones once).  It has bins x languages numbers, bins shrinking so that
it stays within ``model_cells`` - a proven bound for the copy each worker gets.

Texts are handled as arrays: all texts of a chunk advance together through Viterbi,
one word at a time.

Defined results
  * null text, or text without a letter: ``und``, score 0, no span.
  * a script no learned language uses: all languages score alike; ties go to the
    language that comes first by code points.
  * nothing to learn from: ``und`` for every text.
  * a null id is kept; rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomoflow.llm.common import column, small_batches, working
from tomoflow.llm.signs import LAST, Block, arrow_chunks, chunks

UNKNOWN = "und"
DOCS_PER_LANG = 2000
BINS = 1 << 16
MODEL_CELLS = 1 << 24
SWITCH_PENALTY = 6.0
FLOOR = -12.0
#: Share of a text's letters that its language has to have where only texts of a known language stay.
LEAST_SHARE = 0.4
CHUNK_CHARS = 750_000

# The first and last code points of the scripts that are told apart
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7A3),
]
NAMES = sorted({name for name, _, _ in SCRIPTS})
OTHER = len(NAMES)


def script_table() -> np.ndarray:
    table = np.full(LAST, OTHER, np.uint8)
    for name, first, last in SCRIPTS:
        table[first : last + 1] = NAMES.index(name)
    return table


def triples(block: Block, bins: int) -> np.ndarray:
    """The bin of the letter triple around each place of the block."""
    c = block.codes
    mixed = c * np.uint32(0x9E3779B1)
    mixed[1:] ^= c[:-1] * np.uint32(0x85EBCA77)
    mixed[:-1] ^= c[1:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(8)) % np.uint32(bins)


class Model:
    """Log probabilities (bins x languages) and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, script_counts: np.ndarray):
        self.langs, self.bins = langs, counts.shape[0]
        total = counts.sum(axis=0)
        self.logp = np.log((counts + 0.1) / (total + 0.1 * self.bins)).astype(np.float32)
        share = script_counts / np.maximum(1, script_counts.sum(axis=0))
        allowed = share >= 0.01
        allowed[~allowed.any(axis=1)] = True
        self.barred = np.where(allowed, 0, -1e6).astype(np.float32)
        # scripts no language uses say nothing
        self.silent = script_counts.sum(axis=1) == 0

    def word_scores(self, block: Block, scripts: np.ndarray) -> np.ndarray:
        """Words x languages, 0 for the best language, no less than FLOOR a word if its script is allowed."""
        letters = np.flatnonzero(block.codes)
        per_letter = self.logp[triples(block, self.bins)[letters]]
        starts = np.searchsorted(letters, block.begin)
        scores = np.add.reduceat(per_letter, starts, axis=0)
        script = scripts[block.raw[block.begin]]
        scores[self.silent[script]] = 0
        scores += self.barred[script]
        scores -= scores.max(axis=1, keepdims=True)
        return np.where(scores < -1e5, scores, np.maximum(scores, FLOOR))


def label_words(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi over all texts at once: the language of each word."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begins, lengths = first[:-1][order], n[order]
    steps = int(lengths[0]) if len(lengths) else 0
    labels = np.zeros(len(scores), np.int32)
    if not steps:
        return labels
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps + 1), side="right")
    came_from = np.zeros(len(scores), np.int32)  # the best language of the word before
    switched = np.zeros(scores.shape, bool)  # whether that one led to a language
    final = np.zeros(len(lengths), np.int32)
    value = scores[begins[: active[0]]]
    for t in range(steps):
        if t:
            value, at = value[: active[t]], begins[: active[t]] + t
            top = value.argmax(axis=1)
            jump = np.take_along_axis(value, top[:, None], axis=1) - penalty
            came_from[at] = top
            switched[at] = jump > value
            value = np.maximum(value, jump) + scores[at]
        ended = slice(active[t + 1], active[t])
        final[ended] = value[ended].argmax(axis=1)
    current = final.copy()
    for t in range(steps - 1, -1, -1):
        rows = slice(0, active[t])
        at = begins[rows] + t
        labels[at] = current[rows]
        moved = switched[at, current[rows]]
        current[rows] = np.where(moved, came_from[at], current[rows])
    return labels


def identify(texts: list[str], model: Model, scripts: np.ndarray, penalty: float = SWITCH_PENALTY):
    """Languages, scores and spans (start, end, language) of the texts."""
    block = Block(texts)
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    spans: list[list[dict]] = [[] for _ in texts]
    if not len(block.begin) or not model.langs:
        return langs, scores, spans
    labels = label_words(model.word_scores(block, scripts), block.first, penalty)
    letters = np.zeros((len(texts), len(model.langs)))
    np.add.at(letters, (block.doc, labels), block.end - block.begin)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    has = total > 0
    scores[has] = letters[has, best[has]] / total[has]
    for i in np.flatnonzero(has):
        langs[i] = model.langs[best[i]]
    change = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(block.doc, prepend=-1) != 0))
    last = np.append(change[1:], len(labels)) - 1
    for a, b in zip(change.tolist(), last.tolist(), strict=True):
        doc = int(block.doc[a])
        shift = int(block.offset[doc])
        spans[doc].append({"start": int(block.begin[a]) - shift, "end": int(block.end[b]) - shift, "lang": model.langs[labels[a]]})
    return langs, scores, spans


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, bins: int = BINS) -> Model:
    """A model of the languages of ``docs`` (training rows only), from a bounded sample."""
    rows = docs.select(
        column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").alias("text"), column(docs, lang_col, "string").alias("lang")
    ).where("lang is not null and text is not null")
    digest = F.xxhash64(F.lit("language-id"), "text")
    distinct = rows.select("lang", digest.alias("digest")).distinct()
    counts = {r["lang"]: r["count"] for r in distinct.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1, 0)), np.zeros((OTHER + 1, 0)))
    while bins * len(langs) > MODEL_CELLS and bins > 1024:
        bins //= 2
    limits = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(1_000_000 * min(1.0, 1.5 * docs_per_lang / counts[lang])) + 1))])
    few = rows.select("lang", "text", digest.alias("digest")).where(F.pmod("digest", F.lit(1_000_000)) < limits[F.col("lang")])
    few = few.dropDuplicates(["lang", "digest"])
    # about 1.5 times the bound are left; the bound itself
    sample = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("digest", F.lit(1_000_000)), "digest"))).where(F.col("place") <= docs_per_lang)
    sample = sample.select("lang", "text")

    def count(key, group: pd.DataFrame) -> pd.DataFrame:
        with working("language_id"):
            scripts = script_table()
            total, by_script = np.zeros(bins, np.int64), np.zeros(OTHER + 1, np.int64)
            texts = group["text"].tolist()
            for part in chunks(texts, CHUNK_CHARS):
                block = Block(texts[part])
                letters = np.flatnonzero(block.codes)
                total += np.bincount(triples(block, bins)[letters], minlength=bins)
                by_script += np.bincount(scripts[block.raw[letters]], minlength=OTHER + 1)
            return pd.DataFrame({"lang": [key[0]], "counts": [total.tobytes()], "scripts": [by_script.tobytes()]})

    learned = sample.groupBy("lang").applyInPandas(count, "lang string, counts binary, scripts binary").collect()
    learned = sorted(learned, key=lambda r: r["lang"])
    stacked = [np.stack([np.frombuffer(r[name], np.int64) for r in learned], axis=1) for name in ("counts", "scripts")]
    return Model([r["lang"] for r in learned], *stacked)


def identify_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per document: doc_id, lang_pred, score and, if wanted, spans."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: int, end: int, lang: string>>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("language_id"):
            own, scripts = shared.value, script_table()
            for batch in batches:
                ids = batch.column(0)
                for part, texts in arrow_chunks(batch.column(1), CHUNK_CHARS):
                    langs, scores, found = identify(texts, own, scripts)
                    columns = [ids.slice(part.start, part.stop - part.start), pa.array(langs), pa.array(scores, pa.float64())]
                    names = ["doc_id", "lang_pred", "score"]
                    if spans:
                        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                        columns, names = [*columns, pa.array(found, kind)], [*names, "spans"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").alias("text"))
    return rows.mapInArrow(run, schema)


def known_language(docs: DataFrame, model: Model, text_col: str = "text", least_share: float = LEAST_SHARE, langs: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns.

    A text's language has ``least_share`` or more of its letters in its Viterbi spans, and is one of
    ``langs``, if these are given.  Others go: texts without letters, and mixtures in which no
    language leads.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = None if langs is None else set(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("language_id"):
            own, scripts = shared.value, script_table()
            for batch in batches:
                for part, texts in arrow_chunks(batch.column(1), CHUNK_CHARS):
                    found, shares, _ = identify(texts, own, scripts)
                    told = pa.array([lang != UNKNOWN and share >= least_share and (wanted is None or lang in wanted) for lang, share in zip(found, shares, strict=True)], pa.bool_())
                    kept = batch.column(0).slice(part.start, part.stop - part.start).filter(told)
                    yield pa.RecordBatch.from_arrays([kept], ["doc"])

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, column(docs, text_col, "string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"]])).select("doc.*")
