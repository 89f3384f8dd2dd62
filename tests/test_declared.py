"""Scans as loader steps declare them: image keys, angles, calibration frames of other files."""

import argparse
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoflow import cli
from tomoflow.sources import declared
from tomoflow.sources.scan import DARK, FLAT, PROJECTION, hdf5_columns

KEYS = [FLAT, PROJECTION, PROJECTION, DARK, PROJECTION, FLAT, PROJECTION, DARK]
DEGREES = [0.0, 10.0, 25.0, 0.0, 47.5, 0.0, 90.0, 0.0]
DATA = np.random.default_rng(3).uniform(1, 2, size=(len(KEYS), 6, 7)).astype(np.float32)


def write(spark, path, data=DATA, **more):
    rows = [(a, y, *(v[a] for v in more.values()), [float(x) for x in data[a, y]]) for a in range(len(data)) for y in range(data.shape[1])]
    kinds = "".join(f", {name} {'int' if name == 'keys' else 'double'}" for name in more)
    spark.createDataFrame(rows, f"angle int, det_y int{kinds}, values array<float>").repartition(3).write.parquet(str(path))
    return str(path)


@pytest.fixture
def path(spark, tmp_path):
    return write(spark, tmp_path / "lines.parquet", keys=KEYS, degrees=DEGREES)


GIVEN = {"data_path": "values", "image_key_path": "keys", "rotation_angles": {"data_path": "degrees"}}


def frames(df):
    return sorted((r.det_y, [round(float(v), 5) for v in r.line]) for r in df.collect())


def expected(places, rows=range(6), columns=slice(None)):
    return sorted((y, [round(float(v), 5) for v in DATA[a, y, columns]]) for a in places for y in rows)


def test_declared_keys_and_angles(spark, path):
    scan = declared.load(spark, path, GIVEN)
    assert scan.shape == (4, 6, 7)
    assert {(r.angle, r.det_y): r.line for r in scan.lines.collect()} == {
        (i, y): DATA[a, y].tolist() for i, a in enumerate([1, 2, 4, 6]) for y in range(6)
    }
    assert [(r.angle, round(r.theta, 9)) for r in scan.angles.orderBy("angle").collect()] == [
        (i, round(math.radians(d), 9)) for i, d in enumerate([10.0, 25.0, 47.5, 90.0])
    ]
    assert frames(scan.darks) == expected([3, 7]) and frames(scan.flats) == expected([0, 5])


def test_preview_and_subset_of_declared_angles(spark, path):
    preview = {"angles": {"start": 2, "stop": 5}, "detector_y": {"start": 1, "stop": 3}, "detector_x": {"start": 2}}
    scan = declared.load(spark, path, GIVEN | {"preview": preview})
    assert scan.shape == (2, 2, 5) and frames(scan.lines) == expected([2, 4], (1, 2), slice(2, None))
    assert frames(scan.darks) == expected([3, 7], (1, 2), slice(2, None))
    scan = declared.load(spark, path, GIVEN | {"preview": preview}, subset={"start": 4, "stop": None})
    assert [round(math.degrees(r.theta), 6) for r in scan.angles.orderBy("angle").collect()] == [47.5, 90.0]


def test_other_files_and_ignored_frames(spark, path, tmp_path):
    other = write(spark, tmp_path / "darks.parquet", DATA[:2])
    keyed = write(spark, tmp_path / "flats.parquet", keys=KEYS)
    given = GIVEN | {"darks": {"file": other, "data_path": "values"}, "flats": {"file": keyed, "data_path": "values", "image_key_path": "keys"}}
    scan = declared.load(spark, path, given)
    assert frames(scan.darks) == expected([0, 1]) and frames(scan.flats) == expected([0, 5])
    scan = declared.load(spark, path, GIVEN | {"darks": "ignore"})
    assert frames(scan.darks) == [(y, [0.0] * 7) for y in range(6)] and frames(scan.flats) == expected([0, 5])


def test_a_kind_that_the_scan_lacks_is_made_up(spark, tmp_path):
    path = write(spark, tmp_path / "l.parquet", keys=[FLAT, *[PROJECTION] * 7], degrees=DEGREES)
    scan = declared.load(spark, path, GIVEN)
    assert frames(scan.darks) == [(y, [0.0] * 7) for y in range(6)] and frames(scan.flats) == expected([0])


def test_nothing_is_made_up(spark, path):
    without_key = {k: v for k, v in GIVEN.items() if k != "image_key_path"}
    for given, said in (
        (GIVEN | {"image_key_path": "absent"}, "absent"),
        (GIVEN | {"rotation_angles": {"data_path": "theta"}}, "theta"),
        ({k: v for k, v in GIVEN.items() if k != "rotation_angles"}, "rotation angles"),
        ({k: v for k, v in GIVEN.items() if k != "data_path"}, "data_path"),
        (without_key, "image_key_path"),
    ):
        with pytest.raises(ValueError, match=said):
            declared.load(spark, path, given)
    scan = declared.load(spark, path, without_key | {"darks": "ignore", "flats": "ignore"})
    assert scan.shape == (8, 6, 7) and scan.lines.count() == 48


def test_auto_and_one_key(spark, path, tmp_path):
    table = spark.read.parquet(path)
    named = table.select("angle", "det_y", F.col("values").alias("line"), F.col("keys").alias("image_key"), F.col("degrees").alias("rotation_angle"))
    named.write.parquet(str(tmp_path / "auto"))
    given = {"data_path": "auto", "image_key_path": "auto", "rotation_angles": "auto"}
    assert frames(declared.load(spark, str(tmp_path / "auto"), given).lines) == expected([1, 2, 4, 6])
    table.selectExpr("angle * 6 + det_y AS place", "values", "keys", "degrees").write.parquet(str(tmp_path / "one"))
    scan = declared.load(spark, str(tmp_path / "one"), GIVEN | {"key": "place"}, rows=6)
    assert scan.shape == (4, 6, 7) and frames(scan.lines) == expected([1, 2, 4, 6])


PIPELINE = """
- method: standard_tomo
  module_path: tomoflow.loaders
  parameters:
    data_path: values
    image_key_path: keys
    rotation_angles: {data_path: degrees}
- method: normalize
  module_path: tomoflow.prep.normalize
  parameters: {cutoff: 10.0, minus_log: false, nonnegativity: false, remove_nans: false}
"""


def options(**more):
    given = {"lists_are_sweeps": False, "save_all": False, "snapshots": False, "sweep_bits": 8, "subset_start": None, "subset_stop": None, "rows": 6, "monitor": [], "intermediate_format": "parquet", "frames_per_chunk": 0, "compress_intermediate": 0}
    return argparse.Namespace(**(given | more))


def test_run_of_the_command_line(spark, path, tmp_path):
    scan = cli.run(spark, path, PIPELINE, str(tmp_path / "out"), options(snapshots=True))
    dark, flat = DATA[[3, 7]].mean(0), DATA[[0, 5]].mean(0)
    want = np.clip((DATA[[1, 2, 4, 6]] - dark) / (flat - dark), -10.0, 10.0)
    got = {(r.angle, r.det_y): r.line for r in scan.lines.collect()}
    assert len(got) == 24
    for (angle, y), line in got.items():
        assert np.allclose(line, want[angle, y], rtol=1e-3, atol=1e-3)
    assert [p.name for p in (tmp_path / "out" / "snapshots").iterdir()] == ["0_normalize"]
    with pytest.raises(NotImplementedError):
        cli.run(spark, path, PIPELINE.replace("method: standard_tomo", "method: other_loader"), str(tmp_path / "o"), options())


@pytest.mark.parametrize("frames", [0, 3])
def test_steps_saved_as_volumes(spark, path, tmp_path, frames):
    """What a run saves as HDF5 is a scan that the loader opens again."""
    scan = cli.run(spark, path, PIPELINE, str(tmp_path / "out"), options(save_all=True, intermediate_format="hdf5", frames_per_chunk=frames, compress_intermediate=4))
    (file,) = [p for p in (tmp_path / "out").iterdir() if "normalize" in p.name]
    assert file.suffix == ".h5"
    given = {"data_path": "/data", "rotation_angles": {"data_path": "/angles"}, "darks": "ignore", "flats": "ignore"}
    again = declared.load(spark, str(file), given)
    assert again.shape == scan.shape == (4, 6, 7)
    lines = [{(r.angle, r.det_y): np.float32(r.line).tolist() for r in s.lines.collect()} for s in (scan, again)]
    assert lines[0] == lines[1] and len(lines[0]) == 24
    assert [round(math.degrees(r.theta), 6) for r in again.angles.orderBy("angle").collect()] == [10.0, 25.0, 47.5, 90.0]


def test_check_with_data(spark, path, tmp_path, capsys):
    file = tmp_path / "p.yaml"
    file.write_text(PIPELINE)
    assert cli.main(["check", str(file), path]) == 0
    file.write_text(PIPELINE.replace("keys", "no_keys"))
    assert cli.main(["check", str(file), path]) == 1 and "no_keys" in capsys.readouterr().out


AUTO_PIPELINE = PIPELINE.replace("data_path: values", "data_path: auto").replace("image_key_path: keys", "image_key_path: auto").replace("{data_path: degrees}", "auto")


def test_check_with_auto_and_other_files(spark, path, tmp_path, capsys):
    """The all-auto form, and calibration frames of other files, are held against what is there."""
    file = tmp_path / "p.yaml"
    file.write_text(AUTO_PIPELINE)
    assert cli.main(["check", str(file), path]) == 1 and "'auto'" in capsys.readouterr().out
    named = str(tmp_path / "named")
    spark.read.parquet(path).selectExpr("angle", "det_y", "values AS line", "keys AS image_key", "degrees AS rotation_angle").write.parquet(named)
    assert cli.main(["check", str(file), named]) == 0

    def with_darks(frames):
        file.write_text(PIPELINE.replace("    rotation_angles", f"    darks: {frames}\n    rotation_angles"))
        done = cli.main(["check", str(file), path])
        return done, capsys.readouterr().out

    assert with_darks(f"{{file: {path}, data_path: values, image_key_path: keys}}") == (0, "")
    done, said = with_darks(f"{{file: {path}, data_path: nothing}}")
    assert done == 1 and "'nothing'" in said
    done, said = with_darks(f"{{file: {path}-absent, data_path: values}}")
    assert done == 1 and "can't be read" in said
    assert with_darks("ignore") == (0, "")
    file.write_text(PIPELINE.replace("{data_path: degrees}", "{user_defined: {start_angle: 0, stop_angle: 180, angles_total: 4}}"))
    assert cli.main(["check", str(file), path]) == 0


CHECKED = PIPELINE + """
- method: minus_log
  module_path: tomoflow.prep
  parameters: {}
- method: calculate_stats
  module_path: tomoflow.stats
  parameters: {}
  id: stats
  side_outputs: {glob_stats: glob_stats}
"""


def test_zeros_are_reported_and_nothing_stays_persisted(spark, path, tmp_path, caplog):
    """A scan whose values are mostly those of its darks: zeros after the correction."""
    dark = DATA.copy()
    dark[[1, 2, 4]] = dark[[3, 7]].mean(0)
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    zeros = write(spark, tmp_path / "zeros.parquet", dark, keys=KEYS, degrees=DEGREES)
    with caplog.at_level("WARNING", "tomoflow"):
        cli.run(spark, zeros, CHECKED, str(tmp_path / "a"), options(monitor=["summary"]))
    assert any("zeros after normalize" in m and "%" in m for m in caplog.messages)
    caplog.clear()
    with caplog.at_level("WARNING", "tomoflow"):
        cli.run(spark, path, CHECKED, str(tmp_path / "b"), options())
    assert not any("zeros" in m for m in caplog.messages)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held


def test_zeros_are_counted_on_demand_only(spark, path):
    from tomoflow.plans.parse import parse
    from tomoflow.plans.rules import rewrite
    from tomoflow.run import Settings, run_pipeline, warn_of_zeros

    scan = declared.load(spark, path, GIVEN)
    plain = run_pipeline(rewrite(parse(CHECKED)), scan, Settings(persist=False))
    assert warn_of_zeros(plain) == {}
    asked = run_pipeline(rewrite(parse(CHECKED)), scan, Settings(persist=False, count_zeros=True))
    asked.lines.collect()
    assert set(warn_of_zeros(asked)) == {"zeros after normalize", "zeros after minus_log"}


def test_paths_of_hdf5_members():
    assert hdf5_columns({"e": {"data": None, "g": {"key": None}}}) == ["/e/data", "e/data", "/e/g/key", "e/g/key"]
