"""The queries over the smallest driver tables, and the corpus pipeline stage by stage."""

import os
import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tomoflow.llm import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SMALL).toPandas()[list(want.columns)]

    def cell(x):
        """Nulls as None, and whole numbers as such: pandas has columns of numbers with nulls in several kinds."""
        if pd.isna(x):
            return None
        return int(x) if isinstance(x, float) and x.is_integer() else x

    rows = [sorted(str(tuple(cell(x) for x in r)) for r in t.astype(object).itertuples(index=False, name=None)) for t in (got, want)]
    assert rows[0] == rows[1]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        rows = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(rows) <= ids
        if name != "mixing":
            assert len(rows) == len(set(rows))
        ids = set(rows)
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(rows)


def test_stages_on_a_table_with_odd_rows(spark):
    """Each stage against brute force: nulls, empty and long texts, repeated rows, clashing columns."""
    from test_small_tables import ROWS, shingles, table, words
    from tomoflow.llm.common import stash

    docs = table(spark, ROWS).repartition(3)
    columns = docs.columns
    stages = [stage for _, stage in corpus_pipeline.STAGES]

    def after(k):
        nonlocal docs
        docs = stash(stages[k](spark, docs, SMALL))
        assert docs.columns == columns
        return sorted(str((r.doc_id, r.text)) for r in docs.collect())

    lettered = [r for r in ROWS if any(c.isalpha() for c in r[1] or "")]
    assert after(0) == sorted(str((r[0], r[1])) for r in lettered)
    first = {}
    for r in sorted(lettered, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(" ".join(words(r[1])), r)
    assert after(1) == sorted(str((r[0], r[1])) for r in first.values())
    kept = []
    for r in sorted(first.values(), key=lambda r: (r[0] is None, r[0] or 0)):
        a = shingles(r[1])
        if not any(len(a & shingles(k[1])) >= 0.8 * len(a | shingles(k[1])) for k in kept):
            kept.append(r)
    assert after(2) == sorted(str((r[0], r[1])) for r in kept)
    mixed = after(3)
    assert set(mixed) <= {str((r[0], r[1])) for r in kept} and max(map(mixed.count, mixed)) <= 2
    rows = stages[4](spark, docs, SMALL).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert all(r.n_tokens == len(r.ids) > 0 for r in rows)


def test_stages_on_an_empty_table(spark):
    from test_small_tables import table
    from tomoflow.llm.common import stash

    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stash(stage(spark, docs, SMALL), name)
        assert out.count() == 0
        if name != "word_bpe":
            assert out.columns == docs.columns
            docs = out


def test_language_stage_goes_by_its_spans(spark):
    """Mixtures in which no language leads go; what one language leads stays."""
    from tomoflow.llm import language_id

    rng = random.Random(1)
    letters = {"a": "abcd", "b": "efgh", "c": "ijkl", "d": "mnop"}

    def words(lang, n):
        return [("".join(rng.choice(letters[lang]) for _ in range(6))) for _ in range(n)]

    def text(**parts):
        return " ".join(w for lang, n in parts.items() for w in words(lang, n))

    train = [(i, text(**{lang: 60}), lang) for i, lang in enumerate(letters) for _ in range(5)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    kept = {1: text(a=40), 2: text(a=30, b=30), 3: text(b=45, a=30, c=25), 4: text(d=1)}
    gone = {5: text(a=25, b=25, c=25, d=25), 6: text(a=35, b=33, c=32), 7: "12 !?", 8: None}
    docs = spark.createDataFrame([(i, t, "x") for i, t in {**kept, **gone}.items()], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.known_language(docs, model).collect()} == set(kept)
    assert {r.doc_id for r in language_id.known_language(docs, model, langs=["b", "d"]).collect()} == {3, 4}
    assert {r.doc_id for r in language_id.known_language(docs, model, least_share=0.2).collect()} == {*kept, 5, 6}
    assert {r.doc_id for r in language_id.known_language(docs, model, least_share=0.6).collect()} == {1, 4}
