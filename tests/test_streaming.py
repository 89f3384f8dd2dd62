"""Sinograms that complete while lines arrive, against the same work on the whole scan."""

import glob
import shutil

import numpy as np
import pytest

from tomoflow.operators import frames
from tomoflow.streaming.sinograms import arrived, completed_sinograms

DATA = np.random.default_rng(8).normal(size=(11, 3, 6)).astype(np.float32)


def arrays(df):
    out = {}
    for r in df.collect():
        assert (r.angle, r.det_y) not in out
        out[r.angle, r.det_y] = r.line
    return out


@pytest.fixture
def parts(spark, tmp_path):
    """Six files of lines in no order, one line twice."""
    rows = [(a, y, [float(v) for v in DATA[a, y]]) for a in range(11) for y in range(3)]
    rows.append(rows[4])
    np.random.default_rng(2).shuffle(rows)
    for i in range(6):
        spark.createDataFrame(rows[i::6], "angle int, det_y int, line array<float>").coalesce(1).write.parquet(str(tmp_path / f"made/{i}"))
    (tmp_path / "in").mkdir()
    return [glob.glob(f"{tmp_path}/made/{i}/*.parquet")[0] for i in range(6)]


def stream(spark, folder):
    return spark.readStream.schema("angle int, det_y int, line array<float>").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_arrival_in_any_order_gives_the_batch_result(spark, tmp_path, parts):
    for p in parts:
        shutil.copy(p, tmp_path / "in")
    done = completed_sinograms(stream(spark, tmp_path / "in"), 11, frames.sort_stripes)
    got = arrays(arrived(done, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    for y in range(3):
        want = frames.sort_stripes(DATA[:, y].astype(float))
        assert all(got[a, y] == want[a].tolist() for a in range(11))
    assert len(got) == 33


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path, parts):
    done = completed_sinograms(stream(spark, tmp_path / "in"), 11)
    for p in parts[:4]:
        shutil.copy(p, tmp_path / "in")
    before = arrays(arrived(done, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    assert len(before) < 33
    for p in parts[4:]:
        shutil.copy(p, tmp_path / "in")
    again = completed_sinograms(stream(spark, tmp_path / "in"), 11)
    got = arrays(arrived(again, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    assert {k: np.float32(v).tolist() for k, v in got.items()} == {(a, y): DATA[a, y].tolist() for a in range(11) for y in range(3)}
    assert arrays(arrived(again, str(tmp_path / "out"), str(tmp_path / "checkpoint"))) == got  # nothing new, nothing twice


def test_angles_beyond_the_scan_are_refused(spark, tmp_path, parts):
    shutil.copy(parts[0], tmp_path / "in")
    with pytest.raises(Exception, match="of a scan of 2 angles"):
        arrived(completed_sinograms(stream(spark, tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
