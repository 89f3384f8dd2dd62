"""Rules that hold alike at every size: work of a task, significance of features, depth of contexts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomoflow.llm import lm_scoring, top_k, toxicity


def blocks(vectors, first_row, cutoff=None):
    """The rows of one block, as pairs have them."""
    n, cut = len(vectors), vectors.shape[1] // 4
    cells = vectors.astype("<i8")
    rows = np.arange(first_row, first_row + n, dtype="<i8")
    cutoffs = np.full(n, -top_k.LONG - 1 if cutoff is None else cutoff, "<i8")
    return {"rows": rows.tobytes(), "ids": rows.tobytes(), "cutoffs": cutoffs.tobytes(), "head": cells[:, :cut].tobytes(), "tail": np.ascontiguousarray(cells[:, cut:]).tobytes()}


def pairs_of(query_blocks, candidate_blocks):
    for q in query_blocks:
        for c in candidate_blocks:
            yield pa.RecordBatch.from_pylist([{k: v for k, v in q.items() if k != "ids"} | {f"c_{k}": v for k, v in c.items() if k != "cutoffs"}])


def test_a_task_holds_the_entries_of_one_query_block(monkeypatch):
    """However many query blocks a task meets, sorting a pair of blocks costs the same."""
    sorted_rows = []
    inner = top_k.best_entries
    monkeypatch.setattr(top_k, "best_entries", lambda row, *rest: sorted_rows.append(len(row)) or inner(row, *rest))
    rng = np.random.default_rng(1)
    queries = [blocks(rng.integers(-9, 9, (64, 8)), 64 * i) for i in range(60)]
    candidates = [blocks(rng.integers(-9, 9, (50, 8)), 10_000 + 50 * i) for i in range(3)]
    held = {}

    class Pairs:
        def mapInArrow(self, run, schema):
            for batch in run(pairs_of(queries, candidates)):
                for r in batch.to_pylist():
                    held.setdefault(r["query_row"], []).append(r["vec_id"])

    top_k.first_entries(Pairs(), 5)
    assert len(held) == 60 * 64 and all(len(v) == 5 for v in held.values())
    assert max(sorted_rows) <= 2 * 5 * 64 and len(sorted_rows) == 60 * 3
    top_k.sufficient_entries(Pairs(), 5, 4)
    assert all(len(v) == 10 for v in held.values())


def test_the_cutoff_saves_work():
    """Candidates that can't reach any cutoff go after the first slice, and none that can."""
    rng = np.random.default_rng(2)
    q, c = rng.integers(-50, 50, (40, 16)), rng.integers(-50, 50, (500, 16))
    c[::5] *= 6
    scores = q @ c.T
    cut = np.sort(scores, axis=1)[:, -10].astype(float)[:, None]
    stay = top_k.may_reach(q, c, cut, 4)
    assert stay[(scores >= cut).any(axis=0)].all() and 90 <= stay.sum() < 200
    assert top_k.may_reach(q, c, np.full((40, 1), -np.inf), 4).all()


def test_many_queries_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = rng.integers(-30, 30, (700, 6))
    rows = [(i, [float(x) / 1024 for x in v]) for i, v in enumerate(data)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k.top_k(table, F.col("vec_id") % 2 == 0, k=4, block_rows=32).collect()}
    scores = data @ data.T
    for i in range(0, 700, 2):
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-scores[i, j], j))[:4]
        assert [got[i, r] for r in range(1, 5)] == [(j, scores[i, j]) for j in order]


def labelled(n_toxic, n_clean, seed=1):
    """Texts of invented words; toxic ones hold some of ten words that no other has."""
    rng = random.Random(0)
    stems = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400)]
    rng = random.Random(seed)
    bad = ["zyvor", "quxel", "wytch", "xanop", "vezzu", "yukke", "zorri", "quavv", "wexxi", "yzzle"]
    rows = []
    for i in range(n_toxic + n_clean):
        words = [rng.choice(stems) for _ in range(rng.randrange(20, 120))]
        if i < n_toxic:
            for w in rng.sample(bad, 4):
                words.insert(rng.randrange(len(words)), w)
        rows.append(" ".join(words))
    return rows, np.arange(n_toxic + n_clean) < n_toxic


@pytest.mark.parametrize(("n_toxic", "n_clean"), [(10, 60), (40, 300), (150, 1200)])
def test_toxic_words_are_learnt_at_every_size(n_toxic, n_clean):
    """One rule: small samples and large ones find nine in ten of new toxic texts, and hardly any other."""
    field = toxicity.fit(*labelled(n_toxic, n_clean))
    texts, toxic = labelled(60, 300, seed=7)
    scores = field.score(texts)[0]
    assert (scores[toxic] >= 0.3).mean() >= 0.9
    assert (scores[~toxic] >= 0.3).mean() <= 0.03


def test_labels_by_chance_teach_nothing():
    """Labels that have nothing to do with the texts: next to no feature passes."""
    texts, _ = labelled(0, 400)
    rng = np.random.default_rng(4)
    n = rng.integers(1, 200, 3000).astype(float)
    toxic = rng.binomial(n.astype(int), 0.2).astype(float)
    assert toxicity.unlikely(toxic, n - toxic, 0.2).sum() <= 3
    assert toxicity.unlikely(np.array([0.0, 30.0]), np.array([5.0, 0.0]), 0.2).tolist() == [False, True]
    assert not toxicity.unlikely(np.zeros(4), np.zeros(4), 0.5).any()
    field = toxicity.fit(texts, rng.random(400) < 0.2)
    assert (field.score(texts)[0] >= 0.5).mean() < 0.05


@pytest.mark.parametrize("depth", [0, 8, 12])
def test_depths_that_a_key_cannot_hold_are_refused(spark, depth):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    with pytest.raises(ValueError, match="1 to 7"):
        lm_scoring.score_documents(docs, F.lit(False), depth=depth)
