"""Toxicity: a linear-chain conditional random field that tags toxic spans.

Tokens are words (stretches of letters); a chain is a sentence, cut after ``CHAIN``
words.  A token's features are its word and its beginnings of three to six letters,
hashed to ``BUCKETS`` weights; there are two tags, clean and toxic.  Forward and
backward passes give each token's marginal probability of being toxic, for all chains
of a chunk at once.  A document's score is a logistic function of the sum and the two
highest of its marginals, and its spans are the tokens of 0.5 or more, neighbours of
one chain merged.

Training uses a bounded sample: at most ``sample_docs`` distinct texts of labelled
documents, chosen by a hash of the text (whole texts), in one task.  Labels are those of
documents, so tokens are labelled from them: a token of a toxic document is toxic if
one of its features is ``LOG_ODDS`` more likely in toxic documents than in others and
is so more often than chance gives any of as many features (``unlikely``: the same rule for
samples of every size), where near copies of one text (two of four least shingle hashes
alike) count once and so don't make its rare words toxic.  The field is
fitted to these tokens by gradient ascent on its likelihood, over the toxic documents and
as many others; the logistic function is fitted to the labels of the whole sample.

Defined results
  * null text is empty; a text without words has no spans and gets the score of no
    evidence, which is low.
  * no labels to learn from: score 0 for all; labels of one kind only: their share.
  * several labels of one document, or of equal texts: toxic if any says so; null labels
    are left out.
  * a null id is kept and is never a training row's.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoflow.llm.common import column, small_batches, working
from tomoflow.llm.signs import Block, arrow_chunks, chunks

SAMPLE_DOCS = 8000
BUCKETS = 1 << 18
BEGINNINGS = (3, 4, 5, 6)
LOG_ODDS = 3.0
CHAIN = 128
ROUNDS = 30
CHUNK_CHARS = 1_500_000
STOPS = np.array([ord(c) for c in ".!?\n"], np.uint32)


def token_features(block: Block) -> np.ndarray:
    """Tokens x features: buckets, or BUCKETS where a word is too short."""
    codes = np.append(block.codes, np.zeros(max(BEGINNINGS), np.uint32)).astype(np.uint64)
    length = block.end - block.begin
    out = np.full((len(length), len(BEGINNINGS) + 1), BUCKETS, np.int32)
    factor, state = np.uint64(0x9E3779B97F4A7C15), np.full(len(length), 0xCBF29CE484222325, np.uint64)
    for k in range(1, int(length.max(initial=0)) + 1):
        here = np.flatnonzero(length >= k) if k > 1 else np.arange(len(length))
        mixed = (state[here] ^ codes[block.begin[here] + k - 1]) * factor
        state[here] = mixed ^ (mixed >> np.uint64(29))
        if k in BEGINNINGS:
            salted = (state[here] + np.uint64(k)) * factor
            out[here, BEGINNINGS.index(k)] = (salted >> np.uint64(46)).astype(np.int32)
    out[:, -1] = (((state + np.uint64(1000)) * factor) >> np.uint64(46)).astype(np.int32)
    return out


def chains(block: Block) -> np.ndarray:
    """Numbers of the tokens that begin a chain."""
    n = len(block.begin)
    if not n:
        return np.empty(0, np.int64)
    stops = np.concatenate([[0], np.cumsum(np.isin(block.raw, STOPS))])
    new = np.ones(n, bool)
    new[1:] = (np.diff(block.doc) != 0) | (stops[block.begin[1:]] > stops[block.end[:-1]])
    begins = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    return np.flatnonzero(place % CHAIN == 0)


class Field:
    """Weights of the field and of the documents' logistic function."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS + 1, np.float32)
        self.bias = -3.0
        self.links = np.zeros((2, 2))  # from tag, to tag
        self.start = np.zeros(2)
        self.logistic = np.array([0.0, 0.0, 0.0, -3.0])
        self.constant: float | None = None

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1) + self.bias

    def marginals(self, emission: np.ndarray, begins: np.ndarray, expected: bool = False):
        """Probability of the toxic tag for each token; with ``expected`` also the expected links and starts."""
        n = len(emission)
        lengths = np.diff(np.append(begins, n))
        order = np.argsort(-lengths, kind="stable")
        first, lengths = begins[order], lengths[order]
        steps = int(lengths[0]) if len(lengths) else 0
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # chains longer than t
        links, start = np.exp(self.links), np.exp(self.start)
        odds = np.exp(np.clip(emission, -30, 30))
        forward, backward = np.zeros((n, 2)), np.ones((n, 2))
        state = np.empty((0, 2))
        for t in range(steps):
            at = first[: active[t]] + t
            state = np.tile(start, (active[t], 1)) if t == 0 else state[: active[t]] @ links
            state[:, 1] *= odds[at]
            state /= state.sum(axis=1, keepdims=True)
            forward[at] = state
        pair = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            at = first[: active[t]] + t
            message = backward[at].copy()
            message[:, 1] *= odds[at]
            back = message @ links.T
            if expected:
                joint = forward[at - 1][:, :, None] * links[None] * message[:, None, :]
                pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            backward[at - 1] = back / back.sum(axis=1, keepdims=True)
        both = forward * backward
        toxic = both[:, 1] / both.sum(axis=1)
        return (toxic, pair) if expected else toxic

    def evidence(self, toxic: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Documents x (log of the expected number of toxic tokens, two highest marginals, 1)."""
        out = np.zeros((docs, 4))
        out[:, 3] = 1
        out[:, 0] = np.log1p(np.bincount(doc, weights=toxic, minlength=docs))
        order = np.lexsort((-toxic, doc))
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)  # within the document
        for rank in (0, 1):
            at = order[place == rank]
            out[doc[at], 1 + rank] = toxic[at]
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, Block, np.ndarray, np.ndarray]:
        """Scores of the texts; their block, the tokens' marginals and the chains."""
        block = Block(texts)
        begins = chains(block)
        toxic = self.marginals(self.emission(token_features(block)), begins) if len(begins) else np.empty(0)
        if self.constant is not None:
            return np.full(len(texts), self.constant), block, toxic, begins
        scores = 1 / (1 + np.exp(-self.evidence(toxic, block.doc, len(texts)) @ self.logistic))
        return scores, block, toxic, begins


def families(block: Block, docs: int, words: int = 3) -> np.ndarray:
    """A number for each document, the same for near copies: two of four least shingle hashes are alike."""
    code = token_features(block)[:, -1].astype(np.uint64)
    n = max(0, len(code) - words + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(words):
        mixed = (mixed ^ code[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    inside = block.doc[:n] == block.doc[words - 1 : words - 1 + n] if n else np.empty(0, bool)
    doc, mixed = block.doc[:n][inside], mixed[inside]
    least = np.tile(np.arange(docs, dtype=np.uint64), (4, 1))  # short texts: families of their own
    for k in range(4):
        own = np.full(docs, np.iinfo(np.uint64).max, np.uint64)
        salted = (mixed ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        np.minimum.at(own, doc, salted ^ (salted >> np.uint64(31)))
        has = own < np.iinfo(np.uint64).max
        least[k, has] = own[has]
    label = np.arange(docs)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)):
        met: dict[tuple, int] = {}
        for i, key in enumerate(zip(least[a].tolist(), least[b].tolist(), strict=True)):
            label[root(i)] = root(met.setdefault(key, i))
    return np.array([root(i) for i in range(docs)])


def _fit_links(field: Field, features: np.ndarray, begins: np.ndarray, tags: np.ndarray) -> None:
    """Adaptive gradient ascent on the likelihood of the tags."""
    starts = np.zeros(len(tags), bool)
    starts[begins] = True
    inner = np.flatnonzero(~starts)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (tags[inner - 1], tags[inner]), 1)
    seen_starts = np.bincount(tags[begins], minlength=2).astype(float)
    total_w, total_l, total_s, total_b = np.full(BUCKETS + 1, 1e-3), np.full((2, 2), 1e-3), np.full(2, 1e-3), 1e-3
    for _ in range(ROUNDS):
        toxic, pairs = field.marginals(field.emission(features), begins, expected=True)
        gap = tags - toxic
        g = np.bincount(features.ravel(), weights=np.repeat(gap, features.shape[1]), minlength=BUCKETS + 1)
        g -= 0.1 * field.weights
        g[BUCKETS] = 0
        total_w += g * g
        field.weights += (0.5 * g / np.sqrt(total_w)).astype(np.float32)
        g_b = gap.sum()
        total_b += g_b * g_b
        field.bias += 0.5 * g_b / np.sqrt(total_b)
        g_l = seen_pairs - pairs
        total_l += g_l * g_l
        field.links += 0.2 * g_l / np.sqrt(total_l)
        share = np.array([1 - toxic[begins], toxic[begins]]).sum(axis=1)
        g_s = seen_starts - share
        total_s += g_s * g_s
        field.start += 0.2 * g_s / np.sqrt(total_s)


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.array([0.0, 0.0, 0.0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.01 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(4)
        w = w + np.clip(np.linalg.solve(curve, slope), -4, 4)
    return w


def unlikely(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Features that toxic documents have more often than chance gives any of so many features.

    Were a feature of ``n = toxic + clean`` documents unrelated to toxicity, each of these were
    toxic with probability ``share``; at least so many of them are with a chance of at most
    exp(-n KL).  That has to be below one in the number of features that are frequent enough to
    pass at all (n log(1 / share) is the most that any can reach), whatever the sample's size.
    """
    n = toxic + clean
    part = toxic / np.maximum(1, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = n * (np.where(toxic > 0, part * np.log(part / share), 0) + np.where(clean > 0, (1 - part) * np.log((1 - part) / (1 - share)), 0))
    most = np.sort(n[n > 0] * np.log(1 / share))[::-1]
    able = np.flatnonzero(most >= np.log(np.arange(1, len(most) + 1)))
    return (part > share) & (surprise >= np.log(able[-1] + 1 if len(able) else 1)) & (surprise > 0)


def fit(texts: list[str], toxic_docs: np.ndarray) -> Field:
    """A field learned from documents and their labels."""
    field = Field()
    if not len(texts):
        field.constant = 0.0
        return field
    if toxic_docs.all() or not toxic_docs.any():
        field.constant = float(toxic_docs.mean())
        return field
    # documents of each kind that a feature occurs in, and toxic documents that aren't near copies
    in_docs = np.zeros((2, BUCKETS + 1))
    rows = np.flatnonzero(toxic_docs)
    block = Block([texts[i] for i in rows])
    family = families(block, len(rows))
    pairs = np.unique(family[block.doc].astype(np.int64)[:, None] * (BUCKETS + 1) + token_features(block))
    apart = np.bincount(pairs % (BUCKETS + 1), minlength=BUCKETS + 1)
    for part in chunks(texts, CHUNK_CHARS):
        block = Block(texts[part])
        features = token_features(block)
        pairs = np.unique(block.doc.astype(np.int64)[:, None] * (BUCKETS + 1) + features)
        doc, feature = np.divmod(pairs, BUCKETS + 1)
        for kind in (0, 1):
            in_docs[kind] += np.bincount(feature[toxic_docs[part][doc] == kind], minlength=BUCKETS + 1)
    of_kind = np.array([(~toxic_docs).sum(), toxic_docs.sum()])
    log_odds = np.log((in_docs[1] + 0.5) / (of_kind[1] + 1)) - np.log((in_docs[0] + 0.5) / (of_kind[0] + 1))
    strong = (log_odds >= LOG_ODDS) & unlikely(apart, in_docs[0], len(np.unique(family)) / (len(np.unique(family)) + of_kind[0]))
    strong[BUCKETS] = False
    # the toxic documents and as many others
    others = np.flatnonzero(~toxic_docs)
    picked = np.sort(np.concatenate([np.flatnonzero(toxic_docs), others[:: max(1, len(others) // max(1, of_kind[1]))]]))
    block = Block([texts[i] for i in picked])
    features, begins = token_features(block), chains(block)
    if len(features):
        tags = (strong[features].any(axis=1) & toxic_docs[picked][block.doc]).astype(np.int64)
        _fit_links(field, features, begins, tags)
    evidence = []
    for part in chunks(texts, CHUNK_CHARS):
        block = Block(texts[part])
        begins = chains(block)
        toxic = field.marginals(field.emission(token_features(block)), begins) if len(begins) else np.empty(0)
        evidence.append(field.evidence(toxic, block.doc, part.stop - part.start))
    field.logistic = _fit_logistic(np.concatenate(evidence), toxic_docs.astype(float))
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field fitted to a bounded sample of ``labels``' documents."""
    known = labels.select(column(labels, id_col, "long").alias("l_id"), column(labels, label_col, "int").alias("toxic")).dropna()
    known = known.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(column(docs, id_col, "long").alias("doc_id"), F.coalesce(column(docs, text_col, "string"), F.lit("")).alias("text"))
    # equal texts once; at most sample_docs digests are broadcast
    digest = F.xxhash64("text")
    labelled = rows.select("doc_id", digest.alias("c_digest")).join(known, F.col("doc_id") == F.col("l_id"))
    chosen = labelled.groupBy("c_digest").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("toxicity"), "c_digest"), "c_digest").limit(sample_docs)
    sample = rows.withColumn("digest", digest).join(F.broadcast(chosen), F.col("digest") == F.col("c_digest"))
    sample = sample.select("digest", "text", "toxic").dropDuplicates(["digest"]).withColumn("one", F.lit(0))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("digest")
        field = fit(group["text"].tolist(), group["toxic"].to_numpy() > 0)
        return pd.DataFrame({"field": [pickle.dumps(field)]})

    learned = sample.groupBy("one").applyInPandas(learn, "field binary").first()
    return pickle.loads(learned["field"]) if learned else fit([], np.empty(0, bool))


def _spans(block: Block, toxic: np.ndarray, begins: np.ndarray, docs: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(docs)]
    chain = np.searchsorted(begins, np.arange(len(toxic)), side="right")
    hits = np.flatnonzero(toxic >= 0.5)
    before = -2
    for i in hits.tolist():
        doc = int(block.doc[i])
        shift = int(block.offset[doc])
        if i == before + 1 and chain[i] == chain[before]:
            out[doc][-1]["end"] = int(block.end[i]) - shift
        else:
            out[doc].append({"start": int(block.begin[i]) - shift, "end": int(block.end[i]) - shift})
        before = i
    return out


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, spans (offending offsets in characters)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("toxicity"):
            own = shared.value
            for batch in batches:
                ids = batch.column(0)
                for part, texts in arrow_chunks(batch.column(1), CHUNK_CHARS):
                    scores, block, toxic, begins = own.score(texts)
                    spans = _spans(block, toxic, begins, part.stop - part.start)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(part.start, part.stop - part.start), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                        ["doc_id", "score", "spans"],
                    )

    rows = docs.select(column(docs, id_col, "long").alias("doc_id"), F.coalesce(column(docs, text_col, "string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start: int, end: int>>")
