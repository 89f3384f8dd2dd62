"""Operators against NumPy, on small arrays, whatever the partitioning."""

from fractions import Fraction
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoflow.functions.columns import part_bound
from tomoflow.methods import spec
from tomoflow.monitor import make_monitors, overhead, summarise
from tomoflow.operators import aggregate, centre, elementwise, frames, gridding, halo, neighbourhood, percentiles, reorient, sweep, wavelets
from tomoflow.plans.parse import parse
from tomoflow.plans.preview import Frames, UserAngles, parse_preview
from tomoflow.plans.rules import rewrite
from tomoflow.run import Settings, run_pipeline, run_sweep
from tomoflow.sources import images, sinks
from tomoflow.sources.scan import CubeTable, Scan, crop, lines_of, nexus_paths, open_scan, renumbered, voxels

RNG = np.random.default_rng(11)


def lines(spark, data, key=None):
    key = np.zeros(len(data), int) if key is None else key
    rows = [(a, y, int(key[a]), [float(v) for v in data[a, y]]) for a in range(data.shape[0]) for y in range(data.shape[1])]
    return spark.createDataFrame(rows, "angle int, det_y int, image_key int, line array<float>").repartition(3)


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.angle, r.det_y] = r.line
    return out


def pixels_array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.angle, r.det_y, r.det_x] = r.v
    return out


@pytest.fixture(scope="module")
def data():
    return RNG.normal(size=(7, 4, 6)).astype(np.float32)


def test_voxels_and_back(spark, data):
    df = lines(spark, data)
    assert np.allclose(array(lines_of(voxels(df)), data.shape), data)


def test_crop_and_renumber(spark, data):
    p = parse_preview({"angles": {"start": 1, "stop": 5}, "detector_y": {"start": 2}, "detector_x": {"start": 1, "stop": 4}}, data.shape)
    got = crop(lines(spark, data), p)
    rows = {(r.angle, r.det_y): r.line for r in got.collect()}
    assert set(rows) == {(a, y) for a in range(1, 5) for y in (2, 3)}
    assert np.allclose(rows[3, 2], data[3, 2, 1:4])
    odd = renumbered(lines(spark, data).where("angle % 2 = 1"))
    assert {r.angle for r in odd.collect()} == {0, 1, 2}


def test_preview_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.lit(2.0)).alias("v")).write.parquet(str(tmp_path / "t"))
    table = CubeTable(spark.read.parquet(str(tmp_path / "t")), "k", "v", 10)
    assert table.shape == (100, 10, 2)
    p = parse_preview({"angles": {"start": 3, "stop": 5}}, table.shape)
    plan = table.lines(p)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k,30), LessThanOrEqual(k,49)]" in plan


@pytest.mark.parametrize("interleaved", [False, True])
def test_open_scan(spark, data, interleaved):
    key = np.array([0, 1, 0, 2, 0, 0, 2]) if interleaved else np.array([0, 0, 0, 0, 1, 2, 2])
    df, here = lines(spark, data, key), Frames("", "d", "k")
    scan = open_scan(df, data.shape, parse_preview(None, data.shape), UserAngles(0, 180, 7), here, here)
    assert {r.angle for r in scan.lines.collect()} == set(np.flatnonzero(key == 0))
    assert scan.darks.count() == 4 * (key == 2).sum() and scan.flats.count() == 4 * (key == 1).sum()
    theta = [r.theta for r in scan.angles.orderBy("angle").collect()]
    assert np.allclose(theta, np.linspace(0, np.pi, 7))
    none = open_scan(df, data.shape, parse_preview(None, data.shape))
    assert none.darks.first().line == [0.0] * 6 and none.flats.first().line == [1.0] * 6
    other = {"f": lines(spark, data)}
    apart = open_scan(df, data.shape, parse_preview(None, data.shape), None, Frames("f", "d"), here, other)
    assert apart.darks.count() == 28 and apart.flats.count() == 4 * (key == 1).sum()


def test_correction(spark, data):
    dark, flat = RNG.normal(size=(2, 4, 6)), 3 + RNG.normal(size=(3, 4, 6))
    table = lambda x: spark.createDataFrame([(y, [float(v) for v in f[y]]) for f in x for y in range(4)], "det_y int, line array<double>")
    got = pixels_array(elementwise.corrected(voxels(lines(spark, data)), table(dark), table(flat), 1e9), data.shape)
    assert np.allclose(got, (data - dark.mean(0)) / (flat.mean(0) - dark.mean(0)), atol=1e-5)


def test_stats_count_bad_values_as_zero(spark, data):
    bad = data.copy()
    bad[0, 0, :3] = np.nan, np.inf, -np.inf
    r = aggregate.global_stats(voxels(lines(spark, bad))).first()
    clean = np.nan_to_num(bad, nan=0, posinf=0, neginf=0)
    assert np.allclose([r["min"], r["max"], r["mean"], r["n"]], [clean.min(), clean.max(), clean.mean(), clean.size])
    assert aggregate.bad_values(voxels(lines(spark, bad))).first()["not_finite"] == 3


def test_stats_of_nothing(spark, data):
    r = aggregate.global_stats(voxels(lines(spark, data).where("false"))).first()
    assert r["n"] == 0 and r["min"] is None


@pytest.mark.parametrize("factor", [1, 2, 3, 7, 9])
def test_average_frames_with_remainder(spark, data, factor):
    got = pixels_array(aggregate.averaged_frames(voxels(lines(spark, data)), factor), (-(-7 // factor), 4, 6))
    want = [data[i : i + factor].mean(0) for i in range(0, 7, factor)]
    assert np.allclose(got, want, atol=1e-6)


def test_row_average(spark, data):
    got = aggregate.averaged_rows(voxels(lines(spark, data)), 1, 1, 4)
    assert np.allclose(pixels_array(got.withColumn("det_y", F.lit(0)), (7, 1, 6))[:, 0], data[:, 0:3].mean(1), atol=1e-6)
    with pytest.raises(ValueError):
        aggregate.averaged_rows(voxels(lines(spark, data)), 1, 2, 4)


@pytest.mark.parametrize("axis", halo.AXES)
@pytest.mark.parametrize(("before", "after"), [(0, 0), (2, 1), (0, 9)])
def test_padding(spark, data, axis, before, after):
    place = halo.AXES.index(axis)
    n = data.shape[place]
    got = halo.padded(voxels(lines(spark, data)), before, after, n, axis)
    widths = [(0, 0)] * 3
    widths[place] = (before, after)
    want = np.pad(data, widths, mode="edge")
    shifted = got.withColumn(axis, F.col(axis) + before)
    assert np.allclose(pixels_array(shifted, want.shape), want)
    assert got.where("core").count() == data.size


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10])
def test_blocks_equal_the_whole(spark, data, size):
    """A filter over blocks with their halo gives what it gives over all at once."""
    from pyspark.sql import Window

    w = Window.partitionBy("block", "det_y", "det_x").orderBy("angle").rowsBetween(-2, 2)
    dealt = halo.blocks(voxels(lines(spark, data)), size, 2, 2, 7).withColumn("v", F.sum("v").over(w))
    got = pixels_array(dealt.where("core"), data.shape)
    wide = np.pad(data.astype(float), ((2, 2), (0, 0), (0, 0)), mode="edge")
    assert np.allclose(got, sum(wide[i : i + 7] for i in range(5)), atol=1e-5)


def around(data, reach):
    """All shifts of the data within reach on each axis, edges repeated."""
    wide = np.pad(data.astype(float), [(r, r) for r in reach], mode="edge")
    n, m, k = data.shape
    return np.stack([wide[i : i + n, j : j + m, x : x + k] for i in range(2 * reach[0] + 1) for j in range(2 * reach[1] + 1) for x in range(2 * reach[2] + 1)])


@pytest.mark.parametrize("size", [(2, 3), (3, 1), (7, 4), (50, 50)])
@pytest.mark.parametrize("reach", [(1, 0, 0), (2, 0, 0), (0, 1, 2), (1, 1, 1), (4, 3, 0)])
def test_neighbourhoods_by_blocks(spark, data, reach, size):
    stack = around(data, reach)
    for function, want in ((neighbourhood.median_of_box, np.median(stack, axis=0)), (neighbourhood.mean_of_box, stack.mean(0)), (neighbourhood.sum_of_box, stack.sum(0))):
        got = neighbourhood.each_block(lines(spark, data), partial(function, reach=reach), reach, size)
        assert np.allclose(array(got, data.shape), want, atol=1e-9)


def test_halo_of_two_lengths(spark, data):
    """A function that looks back only."""
    got = neighbourhood.each_block(lines(spark, data), lambda box: box[:-2] + box[2:], (2, 0, 0), (3, 2), after=(0, 0, 0))
    wide = np.pad(data.astype(float), ((2, 0), (0, 0), (0, 0)), mode="edge")
    assert np.allclose(array(got, data.shape), wide[:-2] + wide[2:])


def test_filters_on_scans(spark, data):
    stack = around(data, (1, 1, 1))
    for name, want in (("median_filter3d", np.median(stack, axis=0)), ("mean_filter3d", stack.mean(0))):
        scan = Scan(lines(spark, data).drop("image_key"), None, None, None, data.shape)
        assert np.allclose(array(spec(name).apply(scan, "projection", kernel_size=3).lines, data.shape), want, atol=1e-9)
    assert np.allclose(array(neighbourhood.box_sum(lines(spark, data), (1, 1, 1)), data.shape), stack.sum(0))
    missing = lines(spark, data).where("angle <> 3 OR det_y <> 2")
    with pytest.raises(Exception, match="lines, not"):
        neighbourhood.median_filter(missing, (1, 1, 1)).collect()
    assert neighbourhood.median_filter(missing.where("false"), (1, 1, 1)).count() == 0


def test_neighbourhoods_plan_one_exchange_of_lines(spark, data):
    plan = neighbourhood.median_filter(lines(spark, data), (1, 1, 1), 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "posexplode" not in plan and "Window" not in plan
    stripes = frames.each_frame(lines(spark, data), frames.sort_stripes, "sinogram")._jdf.queryExecution().executedPlan().toString()
    assert stripes.count("hashpartitioning") == 1 and "posexplode" not in stripes and "Window" not in stripes


def test_blocks_have_a_bounded_size():
    for width in (1, 64, 2560, 10**7):
        for reach in ((1, 0, 0), (1, 1, 1), (5, 5, 5)):
            a, y = neighbourhood.block_shape(width, reach)
            assert a * y * width * 8 <= max(2 * neighbourhood.BLOCK_BYTES, 8 * width * max(128, (4 * max(reach)) ** 2))


def test_outliers(spark, data):
    one = np.ones((2, 2, 6), np.float32)
    one[0, 0, 3] = 9
    assert (array(halo.remove_outlier_lines(lines(spark, one).drop("image_key"), 0.5), one.shape) == 1).all()
    for reach in (1, 2, 4):
        median = np.median(around(data, (0, 0, reach)), axis=0)
        got = array(halo.remove_outlier_lines(lines(spark, data), 0.3, reach), data.shape)
        assert np.allclose(got, np.where(np.abs(data - median) > 0.3, median, data), atol=1e-7)
    uneven = spark.createDataFrame([(0, 0, [1.0, 9.0, 1.0]), (0, 1, []), (0, 2, [5.0]), (0, 3, [2.0, 2.0, 7.0])], "angle int, det_y int, line array<float>").coalesce(1)
    got = {r.det_y: r.line for r in halo.remove_outlier_lines(uneven, 0.5).collect()}
    assert got == {0: [1.0, 1.0, 1.0], 1: [], 2: [5.0], 3: [2.0, 2.0, 7.0]}


def test_both_orientations(spark, data):
    df = lines(spark, data)
    for pattern, other in (("sinogram", 1), ("projection", 0)):
        for r in reorient.frames(df, pattern).collect():
            assert np.allclose(r.frame, np.take(data, r[0], axis=other))
    assert reorient.by_sinogram(df, 4).rdd.getNumPartitions() == 4
    swapped = array(reorient.swapped(df).select("angle", "det_y", "line"), (4, 7, 6))
    assert np.allclose(swapped, data.transpose(1, 0, 2))


def test_regrouping_plans_one_exchange(spark, data):
    plan = reorient.frames(reorient.by_sinogram(lines(spark, data))).explain
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        plan("simple")
    assert out.getvalue().count("hashpartitioning(det_y") == 1


def test_fold(spark, data):
    got = array(reorient.folded(lines(spark, data), 3, 6), (3, 4, 6))
    assert np.allclose(got, (data[:3] + data[3:6, :, ::-1]) / 2, atol=1e-6)
    wide = array(reorient.folded(lines(spark, data), 3, 6, 2), (3, 4, 10))
    assert np.allclose(wide[:, :, 6:], data[:3, :, 2:], atol=1e-6) and np.allclose(wide[:, :, :4], data[3:6, :, ::-1][:, :, :4], atol=1e-6)


@pytest.mark.parametrize(("n", "parts"), [(10, 4), (1, 3), (7, 7), (128, 5)])
def test_part_bounds_round_halves_to_even(spark, n, parts):
    rows = reorient.chunk_table(spark, n, parts).orderBy("part").collect()
    assert [(r.start, r.stop) for r in rows] == [(round(n / parts * i), round(n / parts * (i + 1))) for i in range(parts)]
    assert part_bound is not None


def test_stripes(spark, data):
    got = array(frames.each_frame(lines(spark, data), frames.sort_stripes, "sinogram"), data.shape)
    for y in range(4):
        sino = data[:, y].astype(float)
        order = np.argsort(sino, axis=0, kind="stable")
        ranked = np.pad(np.take_along_axis(sino, order, axis=0), ((0, 0), (1, 1)), mode="edge")
        ranked = np.median(np.stack([ranked[:, i : i + 6] for i in range(3)]), axis=0)
        want = np.empty_like(sino)
        np.put_along_axis(want, order, ranked, axis=0)
        assert np.allclose(got[:, y], want, atol=1e-6)


def test_sweep(spark, data):
    values = sweep.sweep_values(spark, (1.0, 2.0))
    done = sweep.swept(voxels(lines(spark, data)), values, lambda p: p.withColumn("v", F.col("v") * F.col("value")).drop("value"))
    got = pixels_array(sweep.middle_rows(done, 4), (7, 2, 6))
    assert np.allclose(got[:, 1], 2 * data[:, 2], atol=1e-6)


# frames and centres


def disc(n=64, angles=90, shift=0.0):
    """Projections of a disc of value 1 and radius n / 4, with the axis ``shift`` off the middle."""
    theta = np.linspace(0, np.pi, angles, endpoint=False)
    x = np.arange(n) - (n - 1) / 2 - shift
    line = 2 * np.sqrt(np.maximum(0, (n / 4) ** 2 - x**2))
    return np.tile(line, (angles, 1)), theta


def test_fbp_of_a_disc():
    sino, theta = disc()
    image = frames.fbp(sino, theta)
    inner = image[24:40, 24:40]
    assert abs(inner.mean() - 1) < 0.02 and abs(image[:8].mean()) < 0.03
    moved, _ = disc(shift=3)
    assert np.abs(frames.fbp(moved, theta, center=31.5 + 3) - image).max() < 0.3
    masked = frames.fbp(sino, theta, recon_mask_radius=0.5)
    assert masked[0, 0] == 0
    with pytest.raises(ValueError):
        frames.fbp(sino, theta[:-1])


def test_fista_of_a_disc():
    sino, theta = disc(32, 40)
    image = frames.fista(sino, theta, 40)
    assert abs(image[12:20, 12:20].mean() - 1) < 0.1


def test_denoising_lowers_noise():
    noisy = np.zeros((32, 32)) + RNG.normal(scale=0.1, size=(32, 32))
    assert frames.denoise_tv(noisy, 0.2).std() < 0.5 * noisy.std()


def test_paganin_and_stripes():
    assert np.allclose(frames.paganin(np.full((8, 10), 0.5)), -np.log(0.5), atol=1e-6)
    smooth = np.tile(np.linspace(0, 1, 32), (64, 1))
    striped = smooth.copy()
    striped[:, 11] += 0.7
    for f in (frames.remove_stripe_fw, frames.remove_all_stripe):
        assert np.abs(f(striped) - smooth)[:, 11].mean() < np.abs(striped - smooth)[:, 11].mean() * 0.7
    assert np.allclose(wavelets.joined(*wavelets.split(smooth, 1), 1), smooth)
    assert frames.stripes_mask(striped)[:, 11].all()


def test_undistort_without_distortion():
    frame = RNG.normal(size=(9, 11))
    assert np.allclose(frames.undistort(frame, 5.0, 4.0, [1.0]), frame)


@pytest.mark.parametrize("shift", [-3.0, 0.0, 2.5])
def test_centres(shift):
    n, theta = 96, np.linspace(0, np.pi, 120, endpoint=False)
    image = np.zeros((n, n))
    image[40:60, 30:45] = 1
    image[55:70, 50:58] = 2
    sino = frames.project(image, theta, n)
    columns = np.arange(n)
    moved = np.stack([np.interp(columns - shift, columns, r) for r in sino])
    middle = (n - 1) / 2
    first, last = np.tile(moved[0], (8, 1)), np.tile(np.interp(columns - shift, columns, sino[0, ::-1]), (8, 1))
    assert abs(centre.by_phase_correlation(first, last) - (middle + shift)) < 1.0
    assert abs(centre.by_symmetry(moved, -6, 6, 0.5) - (middle + shift)) <= 1.0
    candidates = [middle + o for o in (-6, -3, 0, 2.5, 6)]
    assert centre.best_sharpness(moved, theta, candidates) == middle + shift


def test_overlap():
    wide = RNG.normal(size=(10, 60)).cumsum(axis=1)
    first, opposite = wide[:, 20:60], wide[:, :40][:, ::-1]
    cor, overlap, side, _ = centre.by_overlap(first, opposite)
    assert (overlap, side) == (20, "left") and cor == 9.5
    assert centre.by_overlap(wide[:, :40], wide[:, 20:60][:, ::-1])[1:3] == (20, "right")


def test_each_frame(spark, data):
    got = array(frames.each_frame(lines(spark, data), lambda f, k: f * k, "sinogram", k=2.0), data.shape)
    assert np.allclose(got, 2 * data)
    fewer = frames.each_frame(lines(spark, data), lambda f: f[:2], "projection")
    assert fewer.count() == 14


# runs, sinks, monitors

PIPELINE = """
- {method: standard_tomo, module_path: tomoflow.loaders, parameters: {}}
- {method: normalize, module_path: m.normalize, parameters: {cutoff: 100.0}}
- {method: calculate_stats, module_path: m, parameters: {}, id: s, side_outputs: {glob_stats: stats}}
- {method: rescale_to_int, module_path: m, parameters: {bits: 8, glob_stats: "${{s.side_outputs.stats}}"}}
- {method: save_to_images, module_path: m.images, parameters: {subfolder_name: pictures, axis: 0}}
"""


def scan_of(spark, data):
    return open_scan(lines(spark, data), data.shape, parse_preview(None, data.shape), UserAngles(0, 180, len(data)))


def test_run(spark, data, tmp_path):
    monitors = make_monitors(["bench", "summary"])
    done = run_pipeline(rewrite(parse(PIPELINE), save_all=True), scan_of(spark, data), Settings(str(tmp_path), snapshots=True, monitors=monitors))
    want = np.floor(255 * ((data - data.min()) / (data.max() - data.min())).astype(float))
    assert np.abs(array(done.lines, data.shape) - want).max() <= 1
    assert done.side_outputs["stats"][3] == data.size
    assert spark.read.parquet(str(tmp_path / "pictures")).count() == 7
    saved = [p for p in tmp_path.iterdir() if "normalize" in p.name]
    assert saved and sinks.load_scan(spark, str(saved[0]), done.darks, done.flats).shape == data.shape
    table, summary = monitors.write(spark, str(tmp_path / "monitor"))
    assert table.where("name = 'normalize'").count() == 1 and summary.count() == table.select("name").distinct().count()


@pytest.mark.parametrize("method", ["remove_outlier", "paganin_filter", "average_projection_frames", "sino_360_to_180", "data_resampler", "FBP", "recon", "FISTA3d_tomobar", "find_center_pc", "find_center_360", "find_center", "median_filter3d", "data_reducer", "remove_stripe_fw"])
def test_every_kind_of_method_runs(spark, data, method):
    text = f"- {{method: l, module_path: x.loaders, parameters: {{}}}}\n- {{method: {method}, module_path: m, parameters: {{}}}}\n"
    done = run_pipeline(parse(text), scan_of(spark, data), Settings(persist=False))
    rows = done.lines.collect()
    assert len({r.angle for r in rows}) == done.shape[0] and {len(r.line) for r in rows} == {done.shape[2]}


def test_own_functions(spark, data):
    """Any function of a frame: registered, or by its module path."""
    from tomoflow.methods import Method, register

    register(Method("scaled_by_angle", "sinogram", frame=lambda frame, theta, factor=1.0: frame * theta[:, None] * factor, parameters={"factor": 1.0}))
    head = "- {method: l, module_path: x.loaders, parameters: {}}\n"
    done = run_pipeline(parse(head + "- {method: scaled_by_angle, module_path: m, parameters: {factor: 2.0}}\n"), scan_of(spark, data))
    theta = np.linspace(0, np.pi, 7)
    assert np.allclose(array(done.lines, data.shape), 2 * data * theta[:, None, None], atol=1e-5)
    done = run_pipeline(parse(head + "- {method: flip, module_path: numpy, parameters: {axis: auto}}\n"), scan_of(spark, data))
    assert np.allclose(array(done.lines, data.shape), data[:, ::-1])
    with_flats = Method("minus_flat", "projection", frame=lambda frame, flats: frame - flats)
    register(with_flats)
    done = run_pipeline(parse(head + "- {method: minus_flat, module_path: m, parameters: {}}\n"), scan_of(spark, data))
    assert np.allclose(array(done.lines, data.shape), data - 1)


def test_coordinates_of_the_whole_detector(spark):
    wide = RNG.normal(size=(2, 4, 12)).astype(np.float32)
    head = "- {method: l, module_path: x.loaders, parameters: {}}\n"
    text = head + "- {method: seam_blend_stitched_data, module_path: m, parameters: {seam_index: 6}}\n"
    text = text.replace("- {method: seam", "- {method: normalize, module_path: m, parameters: {cutoff: 1000.0}}\n- {method: seam")
    cropped = parse_preview({"detector_x": {"start": 2}}, wide.shape)
    whole = array(run_pipeline(parse(text), open_scan(lines(spark, wide), wide.shape, parse_preview(None, wide.shape))).lines, wide.shape)
    part = array(run_pipeline(parse(text), open_scan(lines(spark, wide), wide.shape, cropped)).lines, (2, 4, 10))
    assert np.allclose(whole[:, :, 2:], part, atol=1e-5) and not np.allclose(whole, wide)


def test_logs(tmp_path):
    from tomoflow import log

    logger = log.setup(tmp_path)
    logger.debug("small")
    logger.info("large")
    for handler in logger.handlers:
        handler.flush()
    assert "small" not in (tmp_path / "user.log").read_text() and "small" in (tmp_path / "debug.log").read_text()
    log.setup()


def test_sweep_run(spark, data):
    text = "- {method: l, module_path: x.loaders, parameters: {}}\n- {method: minus_log, module_path: m, parameters: {floor: !Sweep [0.1, 0.5, 1.0]}}\n"
    done = run_sweep(rewrite(parse(text)), scan_of(spark, data), Settings())
    got = array(done.lines, (7, 3, 6))
    for i, floor in enumerate((0.1, 0.5, 1.0)):
        assert np.allclose(got[:, i], -np.log(np.maximum(data[:, 2], floor)), atol=1e-5)
    with pytest.raises(ValueError):
        run_pipeline(parse(text), scan_of(spark, data))


def test_wrong_parameters_and_order(spark, data):
    scan = scan_of(spark, data)
    for text in ("{method: minus_log, module_path: m, parameters: {other: 1}}", "{method: nothing, module_path: m, parameters: {}}", "{method: seam_blend_stitched_data, module_path: m, parameters: {seam_index: 2}}"):
        with pytest.raises(ValueError):
            run_pipeline(parse(f"- {{method: l, module_path: x.loaders, parameters: {{}}}}\n- {text}\n"), scan)


def test_images():
    image = np.arange(6).reshape(2, 3)
    assert images.pgm(image) == b"P5\n3 2\n255\n" + bytes(range(6))
    assert images.png(image, 16)[:8] == b"\x89PNG\r\n\x1a\n"
    assert sinks.result_name("t", "p", "m", "gridrec") == "t-p-m-gridrec"


def test_saved_scan_is_read_back(spark, data, tmp_path):
    scan = scan_of(spark, data)
    sinks.save_scan(scan, str(tmp_path / "s"))
    back = sinks.load_scan(spark, str(tmp_path / "s"), scan.darks, scan.flats)
    assert isinstance(back, Scan) and back.shape == data.shape and np.allclose(array(back.lines, data.shape), data)


def test_monitors(spark):
    with pytest.raises(ValueError):
        make_monitors(["other"])
    rows = spark.createDataFrame([("method", "a", 1.0), ("method", "a", 2.0), ("source", "b", 3.0)], "type string, name string, cpu_s double")
    assert {r.name: (r.calls, r.seconds, r.percent) for r in summarise(rows, 10).collect()} == {"a": (2, 3.0, 30.0), "b": (1, 3.0, 30.0)}
    assert overhead(rows, 10) == 4.0


def test_nexus_discovery_is_depth_first():
    from tomoflow.sources.scan import entry_paths

    assert entry_paths({"e": {"t": {"definition": None}}})["data_path"] == "/e/t/data/data"
    with pytest.raises(ValueError):
        entry_paths({"e": None})
    assert nexus_paths({"a": {"x": 1, "b": {"definition": 1}}, "c": {"definition": 1}}) == "/a/b"
    assert nexus_paths({"a": {"x": 1}}) is None


def test_command_line(tmp_path, capsys):
    from tomoflow.cli import main

    path = tmp_path / "p.yaml"
    path.write_text(PIPELINE)
    assert main(["check", str(path)]) == 0
    path.write_text(PIPELINE.replace("normalize", "normalise", 1))
    assert main(["check", str(path)]) == 1 and "method_exists" in capsys.readouterr().out
    path.write_text(PIPELINE)
    assert main(["memory-check", str(path), "--shape", "100", "80", "60", "--parts", "2", "--limit", "1k"]) == 1


# filter banks, gridding, stripes in three dimensions


@pytest.mark.parametrize("order", range(1, 11))
def test_filter_banks_reconstruct(order):
    taps = wavelets.scaling_filter(order)
    assert len(taps) == 2 * order and abs(taps.sum() - np.sqrt(2)) < 1e-12
    for shift in range(order):  # orthonormal with its even shifts
        assert abs(taps[2 * shift :] @ taps[: len(taps) - 2 * shift] - (shift == 0)) < 1e-12
    high = taps[::-1] * (-1) ** np.arange(len(taps))
    for power in range(order):  # as many vanishing moments
        assert abs((high * (np.arange(len(taps)) / len(taps)) ** power).sum()) < 1e-9
    for n in (1, 2, 37, 64):
        x = np.random.default_rng(n).normal(size=(n, 3))
        for level in (1, 2, 4):
            assert np.abs(wavelets.recompose(*wavelets.decompose(x, order, level), n, order) - x).max() < 1e-10


def test_known_filters():
    root = np.sqrt(3)
    assert np.allclose(wavelets.scaling_filter(2), np.array([1 + root, 3 + root, 3 - root, 1 - root]) / (4 * np.sqrt(2)))
    assert wavelets.order_of("haar") == 1 and wavelets.order_of("db7") == 7
    for name in ("db11", "db0", "sym4", "db"):
        with pytest.raises(ValueError):
            wavelets.order_of(name)


@pytest.mark.parametrize("wname", ["haar", "db2", "db5", "db10"])
def test_stripes_by_wavelets(wname):
    sino = np.outer(np.sin(np.arange(90) / 4), np.cos(np.arange(64) / 9))
    striped = sino.copy()
    striped[:, 20] += 4
    fixed = frames.remove_stripe_fw(striped, level=4, sigma=2.0, wname=wname)
    assert fixed.shape == sino.shape
    assert np.abs((fixed - sino)[:, 20]).mean() < 0.35 * 4
    smooth = np.outer(np.sin(np.arange(90) / 3), np.ones(64))  # nothing along the columns: stays
    assert np.allclose(frames.remove_stripe_fw(smooth, wname=wname), smooth, atol=1e-9)


def ellipses(n, angles, shapes, center):
    """Exact projections of ellipses (x, y, half axes, value), and their image."""
    theta, s, sino = np.linspace(0, np.pi, angles, endpoint=False), np.arange(n) - center, np.zeros((angles, n))
    grid, image = np.arange(n) - (n - 1) / 2, np.zeros((n, n))
    for x, y, a, b, value in shapes:
        for i, t in enumerate(theta):
            r2 = (a * np.cos(t)) ** 2 + (b * np.sin(t)) ** 2
            d = s - (x * np.cos(t) + y * np.sin(t))
            sino[i] += value * 2 * a * b * np.sqrt(np.maximum(0, r2 - d * d)) / r2
        image[((grid[None, :] - x) / a) ** 2 + ((grid[:, None] - y) / b) ** 2 <= 1] += value
    return sino, theta, image


@pytest.mark.parametrize("center", [31.5, 33.0])
@pytest.mark.parametrize("shapes", [[(0, 0, 20, 20, 1.0)], [(8, -5, 16, 9, 1.0), (-14, 10, 7, 12, 0.5)]])
def test_gridrec(shapes, center):
    """Within 0.025 (root mean square, values up to 1.5) of back projection, and as close to the image."""
    sino, theta, image = ellipses(64, 120, shapes, center)
    grid = np.arange(64) - 31.5
    inside = grid[None, :] ** 2 + grid[:, None] ** 2 <= 30**2

    def distance(a, b):
        return np.sqrt(((a - b)[inside] ** 2).mean())

    back, gridded = frames.fbp(sino, theta, center), gridding.gridrec(sino, theta, center)
    assert distance(back, gridded) < 0.025 and distance(gridded, image) < distance(back, image) + 0.005
    small = gridding.gridrec(sino, theta, center, recon_size=40, recon_mask_radius=0.5, filter_name="hann")
    assert small.shape == (40, 40) and small[0, 0] == 0 and small[20, 0] == 0


def test_gridding_equals_the_sum_it_stands_for():
    sino, theta, _ = ellipses(32, 25, [(3, -2, 8, 5, 1.0)], 15.5)
    k = np.fft.fftfreq(64, 1 / 64)
    spectra = np.fft.fft(sino, 64, axis=1) * frames.ramp(64) * np.exp(2j * np.pi * k * 15.5 / 64) * gridding.DAMPING["hann"](2 * np.abs(k) / 64)
    got = gridding.gridrec(sino, theta, filter_name="hann")
    for i, j in ((15, 15), (3, 20), (28, 9)):
        x, y = j - 15.5, i - 15.5
        turned = np.exp(2j * np.pi * k * (x * np.cos(theta) + y * np.sin(theta))[:, None] / 64)
        assert abs(got[i, j] - (np.pi / 25 / 64) * (spectra * turned).sum().real) < 1e-3
    assert gridding.kernel(np.array([0.0, 3.5])).tolist() == [1.0, 0.0]
    with pytest.raises(ValueError):
        gridding.gridrec(sino, theta[:-1])


def test_recon_by_name(spark):
    sino, theta, _ = ellipses(32, 40, [(0, 0, 9, 9, 1.0)], 15.5)
    rows = [(a, 0, [float(v) for v in sino[a]]) for a in range(40)]
    angles = spark.createDataFrame(list(enumerate(theta.tolist())), "angle int, theta double")
    scan = Scan(spark.createDataFrame(rows, "angle int, det_y int, line array<float>"), angles, None, None, (40, 1, 32))
    for name, function in (("gridrec", gridding.gridrec), ("fbp", frames.fbp)):
        done = spec("recon").apply(scan, "sinogram", algorithm=name)
        assert np.allclose(array(done.lines, (32, 1, 32))[:, 0], function(sino.astype(np.float32), theta), atol=1e-5)
    with pytest.raises(ValueError):
        spec("recon").apply(scan, "sinogram", algorithm="sirt")


def plain_stripes(data, difference, columns, length, threshold, depth, least_rows, width):
    """The mask's rules, pixel by pixel."""
    n, m, k = data.shape
    out, long, deep, mask = (np.zeros(data.shape, bool) for _ in range(4))
    for a, y, x in np.ndindex(data.shape):
        near = [data[a, y, min(max(x + o, 0), k - 1)] for o in range(-columns, columns + 1)]
        out[a, y, x] = abs(data[a, y, x] - np.median(near)) > difference
    for a, y, x in np.ndindex(data.shape):
        long[a, y, x] = sum(out[min(max(a + o, 0), n - 1), y, x] for o in range(-length, length + 1)) >= threshold * (2 * length + 1)
    for a, y, x in np.ndindex(data.shape):
        deep[a, y, x] = long[a, y, x] and sum(long[a, min(max(y + o, 0), m - 1), x] for o in range(-depth, depth + 1)) >= least_rows
    for a, y, x in np.ndindex(data.shape):
        mask[a, y, x] = deep[a, y, x] or (deep[a, y, max(0, x - width) : x].any() and deep[a, y, x + 1 : x + 1 + width].any())
    return mask


@pytest.mark.parametrize("rules", [(0.3, 1, 2, 0.6, 1, 2, 2), (0.5, 2, 1, 0.5, 2, 3, 1), (0.2, 1, 3, 0.7, 0, 1, 0)])
def test_stripes_in_three_dimensions(spark, rules):
    data = RNG.normal(scale=0.3, size=(13, 5, 12)).astype(np.float32)
    data[:, 1:4, 4] += 2
    data[:, 1:4, 6] += 2
    data[:, 0, 9] += 2
    want = plain_stripes(data.astype(float), *rules)
    got = array(neighbourhood.stripes_mask(lines(spark, data), *rules, width=12), data.shape)
    assert (got == want).all() and want.any() and not want.all()
    function = partial(neighbourhood.stripes_of_box, **dict(zip(("difference", "columns", "length", "threshold", "depth", "least_rows", "width"), rules, strict=True)))
    small = neighbourhood.each_block(lines(spark, data), function, (rules[2], rules[4], 0), (4, 2))
    assert (array(small, data.shape) == want).all()


def test_a_stripe_of_one_row_is_no_stripe(spark):
    data = np.ones((20, 6, 16), np.float32)
    data[:, 2, 5] = 5
    data[:, 1:5, 11] = 5
    scan = Scan(lines(spark, data).drop("image_key"), None, None, None, data.shape)
    got = array(spec("stripes_mask3d").apply(scan, "projection", length=4).lines, data.shape)
    assert not got[:, :, 5].any() and got[:, 1:5, 11].all() and got.sum() == 80


# percentiles


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("pattern", ["angle", "det_y"])
def test_percentiles_without_gathering(spark, kind, pattern):
    data = RNG.normal(size=(9, 6, 40)) * 10.0 ** RNG.integers(-6, 6, size=(9, 6, 40))
    data[2], data[3, :, ::2], data[4, 0, 0], data[5, 0, :3] = 7.5, 0.0, -np.inf, np.inf
    data = data.astype(np.float32 if kind == "float" else np.float64)
    table = lines(spark, data).withColumn("line", F.col("line").cast(f"array<{kind}>"))
    if kind == "double":
        rows = [(a, y, [float(v) for v in data[a, y]]) for a in range(9) for y in range(6)]
        table = spark.createDataFrame(rows, "angle int, det_y int, line array<double>").repartition(4)
    shares = (0.0, 0.01, 0.5, 0.77, 1.0)
    want = {(r[pattern], s): r[f"p{i}"] for i, s in enumerate(shares) for r in voxels(table).groupBy(pattern).agg(F.percentile("v", s).alias(f"p{i}")).collect()}
    got = {(r[pattern], s): v for r in percentiles.percentiles(table, pattern, shares).collect() for s, v in zip(shares, r.p, strict=True)}
    assert got == want


def test_percentiles_of_little(spark):
    table = spark.createDataFrame([(0, 0, [3.0]), (1, 0, [1.0, None, 2.0]), (2, 0, [])], "angle int, det_y int, line array<float>")
    got = {r.angle: r.p for r in percentiles.percentiles(table, "angle", (0.25, 1.0)).collect()}
    assert got == {0: [3.0, 3.0], 1: [1.25, 2.0]}
    assert percentiles.percentiles(table.where("false"), "angle", (0.5,)).count() == 0


def test_numbers_keep_the_order_of_values():
    for kind in (np.float32, np.float64):
        values = np.sort(np.concatenate([RNG.normal(size=99), [0.0, 1e-40, -1e-40, np.inf, -np.inf]]).astype(kind))
        numbers = percentiles.ordered(values)
        assert (np.diff(numbers.astype(object)) >= 0).all()
        assert np.array_equal(percentiles.restored(numbers, 8 * values.dtype.itemsize), values.astype(float))


def test_fused_percentiles(spark):
    """Only the second product and the sum are rounded."""
    rows = [(0, 0, [1.0, 3.0]), (1, 0, [-np.inf, 0.5, 4.0]), (2, 0, [0.1, 0.1, 0.1]), (3, 0, [0.7])]
    table = spark.createDataFrame(rows, "angle int, det_y int, line array<double>")
    got = {r.angle: r.p for r in percentiles.percentiles(table, "angle", (0.25, 1.0), fused=True).collect()}
    assert got == {0: [1.5, 3.0], 1: [-np.inf, 4.0], 2: [0.1, 0.1], 3: [0.7, 0.7]}
    own = np.random.default_rng(3)
    for place, low, high in zip(own.uniform(1, 640, 300).tolist(), own.normal(size=300).tolist(), own.normal(size=300).tolist(), strict=True):
        d = Fraction(place) % 1
        assert percentiles.fused_between(place, low, high) == float(Fraction(low) * (1 - d) + Fraction(high * float(d)))


def test_percentiles_move_counts_only(spark, data):
    """No exchange carries a line: lines meet two numbers a frame where they are."""
    plan = percentiles.percentiles(lines(spark, data), "angle", (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list(line" not in plan and "posexplode" not in plan
