"""Every query over the smallest tables against its SQL, and the entry point."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tomoflow import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return out


def plain(rows):
    """Rows in one order; whole numbers and floats alike, decimals stay what they are."""
    return sorted((tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in rows), key=lambda r: str(tuple(round(v, 4) if isinstance(v, float) else v for v in r)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SMALL)
    rows = got.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a, b = plain([tuple(r[c] for c in columns) for r in rows]), plain(want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-4) for p, q in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["sweep_stacked", "save_and_reload"])
def test_every_pixel_is_there(spark, con, name):
    pixels = con.execute(catalog.ORACLES["save_and_reload"].replace("SELECT angle, det_y, det_x, v FROM vox", "SELECT count(*) FROM vox")).fetchone()[0]
    got = catalog.QUERIES[name](spark, SMALL)
    assert got.select("angle", "det_y", "det_x").distinct().count() == pixels


@pytest.mark.parametrize("name", ["fbp_reconstruction", "fista_reconstruction"])
def test_reconstructions_have_the_detector_width(spark, name):
    rows = catalog.QUERIES[name](spark, SMALL)
    assert {r.n for r in rows.select("n").distinct().collect()} == {64}


def test_stretch_equals_its_sql_to_the_last_bit(spark, tmp_path):
    """Frames whose brightest pixels are 254 or 255 by the limits' last bit, one-valued frames with unlike limits, frames without values."""
    frames = [np.random.default_rng(seed).normal(size=640).astype(np.float32).tolist() for seed in (478, 2567)]
    frames += [[0.09067010879516602] * 43, [-0.197042778134346] * 45, [None] * 640, [None] * 63 + frames[0][63:]]
    rows = [(a * 10 + y, frame[64 * y : 64 * y + 64]) for a, frame in enumerate(frames) for y in range(10)]
    rows += [(vec_id, frames[0][:64]) for vec_id in range(60, 80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["percentile_stretch"](spark, str(tmp_path)).select("angle", "det_y", "det_x", F.coalesce("v", F.lit(-1))).collect())
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = own.execute(f"SELECT angle, det_y, det_x, coalesce(v, -1) FROM ({catalog.ORACLES['percentile_stretch']})").fetchall()
    assert got == sorted(want) and len(got) == sum(map(len, frames)) + 640
