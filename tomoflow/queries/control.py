"""Queries of the control plane and of whole-frame methods, which SQL can't express."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoflow.operators import centre, frames
from tomoflow.plans import check as checks
from tomoflow.plans.cost import peak_memory, shuffle_partitions, slices_per_batch, stage_memory
from tomoflow.plans.model import AXIS, Pipeline
from tomoflow.plans.parse import parse
from tomoflow.plans.preview import Frames, UserAngles, parse_preview
from tomoflow.plans.rules import rewrite
from tomoflow.plans.stages import plan_stages
from tomoflow.queries.cube import CUBE, NEAR_27, PROJECTION, cube
from tomoflow.run import Settings, run_pipeline, run_sweep
from tomoflow.sources.scan import Scan, open_scan, voxels
from tomoflow.sources.sinks import images

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EXAMPLE = """
- method: standard_tomo
  module_path: tomoflow.loaders
  parameters: {data_path: embedding, image_key_path: image_key, rotation_angles: {data_path: theta}}
- method: remove_outlier
  module_path: tomoflow.misc.corr
  parameters: {dif: 0.5, kernel_size: 3}
- method: normalize
  module_path: tomoflow.prep.normalize
  parameters: {cutoff: 10.0, minus_log: false}
- method: remove_stripe_based_sorting
  module_path: tomoflow.prep.stripe
  parameters: {size: 3}
- method: find_center_vo
  module_path: tomoflow.recon.rotation
  parameters: {average_radius: 0, smin: -5, smax: 5}
  id: centering
  side_outputs: {cor: centre_of_rotation}
- method: FBP
  module_path: tomoflow.recon.algorithm
  parameters: {center: "${{centering.side_outputs.centre_of_rotation}}", recon_mask_radius: 0.95}
- method: calculate_stats
  module_path: tomoflow.methods
  parameters: {}
  id: statistics
  side_outputs: {glob_stats: glob_stats}
- method: rescale_to_int
  module_path: tomoflow.misc.rescale
  parameters: {bits: 8, glob_stats: "${{statistics.side_outputs.glob_stats}}"}
"""

BROKEN = """
- method: normalize
  module_path: tomoflow.prep.normalize
  parameters: {cutof: 10.0}
- method: no_such_method
  module_path: tomoflow.prep
- method: FBP
  module_path: tomoflow.recon.algorithm
  parameters: {center: "${{nowhere.side_outputs.cor}}"}
  id: recon
"""

SWEEP = """
- method: standard_tomo
  module_path: tomoflow.loaders
  parameters: {data_path: embedding}
- method: normalize
  module_path: tomoflow.prep.normalize
  parameters: {cutoff: 10.0}
- method: median_filter
  module_path: tomoflow.misc.corr
  parameters: {size: !Sweep [1, 3, 5]}
"""


def query(function):
    QUERIES[function.__name__] = function
    return function


def scan_of(spark: SparkSession, sf_dir: str, preview: dict | None = None) -> Scan:
    table = cube(spark, sf_dir)
    n = int(np.ceil(0.8 * table.shape[0]))
    asked = {"angles": {"start": 0, "stop": n}} | (preview or {})
    here = Frames("", "data", "image_key")
    return open_scan(table.lines(), table.shape, parse_preview(asked, table.shape), UserAngles(0.0, 180.0, n), here, here)


# SQL: the pixels of the projections, and what ``numbers`` makes of pixels
VOX = f"WITH {CUBE.strip()}"
NUMBERS = " SELECT angle, det_y, count(v) AS n, round(sum(v::FLOAT::DOUBLE), 3) + 0.0 AS total, round(max(v::FLOAT::DOUBLE), 3) + 0.0 AS most FROM done GROUP BY ALL"


#: Whole pixels, as the single-precision numbers that frames have.
PIXELS = " SELECT angle, det_y, det_x, v::FLOAT::DOUBLE + 0.0 AS v FROM done"


def square(reach: int, own: str, along: str, last: str, name: str = "m") -> str:
    """Medians over the square around each pixel of a frame of (own index) lines ``along`` and det_x, edges repeated."""
    offsets = ", ".join(f"({o})" for o in range(-reach, reach + 1))
    return f""", e AS (SELECT max(angle) AS last FROM vox),
near AS (
  SELECT p.angle, p.det_y, p.det_x, p.v, q.v AS w FROM vox p, e, (VALUES {offsets}) a(o), (VALUES {offsets}) b(o)
  JOIN vox q ON q.{own} = p.{own} AND q.{along} = least(greatest(p.{along} + a.o, 0), {last}) AND q.det_x = least(greatest(p.det_x + b.o, 0), 63)),
{name} AS (SELECT angle, det_y, det_x, any_value(v) AS v, median(w) AS median FROM near GROUP BY ALL)"""


def numbers(lines: DataFrame) -> DataFrame:
    """Each line's extent, sum and greatest value: small enough to compare."""
    pixels = voxels(lines)
    rows = pixels.groupBy("angle", "det_y").agg(F.count("v").alias("n"), F.round(F.sum("v"), 3).alias("total"), F.round(F.max("v"), 3).alias("most"))
    return rows


def by_frame(name: str, function, pattern: str, result=numbers, **arguments) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return result(frames.each_frame(scan_of(spark, sf_dir).lines, function, pattern, **arguments))

    QUERIES[name] = run


by_frame("median_filter_2d", frames.median_2d, "projection", voxels, size=3)
by_frame("dezinging_2d", frames.dezing_2d, "projection", voxels, size=3, difference=0.5)
by_frame("paganin_filter", frames.paganin, "projection", ratio_delta_beta=100.0)
by_frame("remove_stripe_fw", frames.remove_stripe_fw, "sinogram", level=3)
by_frame("remove_all_stripe", frames.remove_all_stripe, "sinogram")
by_frame("stripes_mask", frames.stripes_mask, "sinogram", voxels)
by_frame("distortion_correction", frames.undistort, "projection", voxels, xcenter=32.0, ycenter=5.0, list_fact=[1.0, 1e-4])
by_frame("total_variation", frames.denoise_tv, "projection", regularisation=0.1)


def applied(name: str, method: str, result=numbers, **parameters) -> None:
    from tomoflow.methods import spec

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = spec(method)
        return result(one.apply(scan_of(spark, sf_dir), one.pattern, **parameters).lines)

    QUERIES[name] = run


applied("fbp_reconstruction", "FBP", center=31.5)
applied("fista_reconstruction", "FISTA3d_tomobar")
applied("median_filter_3d", "median_filter3d", voxels, kernel_size=3)


ORACLES["median_filter_2d"] = VOX + square(1, "angle", "det_y", "9") + ", done AS (SELECT angle, det_y, det_x, median AS v FROM m)" + PIXELS
ORACLES["dezinging_2d"] = VOX + square(1, "angle", "det_y", "9") + ", done AS (SELECT angle, det_y, det_x, CASE WHEN abs(v - median) > 0.5 THEN median ELSE v END AS v FROM m)" + PIXELS
ORACLES["median_filter_3d"] = VOX + NEAR_27 + ", done AS (SELECT angle, det_y, det_x, median AS v FROM m)" + PIXELS
ORACLES["stripes_mask"] = (
    VOX
    + square(2, "det_y", "angle", "last")
    + """, gaps AS (SELECT angle, det_y, det_x, abs(v - median) AS gap FROM m),
levels AS (SELECT det_y, median(gap) AS level FROM gaps GROUP BY det_y),
often AS (SELECT det_y, det_x, avg(CASE WHEN gap > 3 * level THEN 1.0 ELSE 0.0 END) > 0.7 AS stands_out FROM gaps JOIN levels USING (det_y) GROUP BY ALL),
done AS (SELECT angle, det_y, det_x, stands_out::INT AS v FROM gaps JOIN often USING (det_y, det_x))"""
    + PIXELS
)
ORACLES["distortion_correction"] = (
    VOX
    + """, places AS (
  SELECT angle, det_y, det_x, least(greatest((det_x - 32.0) * f + 32.0, 0), 63) AS px, least(greatest((det_y - 5.0) * f + 5.0, 0), 9) AS py
  FROM (SELECT *, 1.0 + 1e-4 * sqrt((det_x - 32.0) * (det_x - 32.0) + (det_y - 5.0) * (det_y - 5.0)) AS f FROM vox)),
corners AS (SELECT *, least(floor(px), 62)::INT AS x0, least(floor(py), 8)::INT AS y0 FROM places),
done AS (
  SELECT c.angle, c.det_y, c.det_x, sum(v.v * (CASE WHEN v.det_x = x0 THEN 1 - (px - x0) ELSE px - x0 END) * (CASE WHEN v.det_y = y0 THEN 1 - (py - y0) ELSE py - y0 END)) AS v
  FROM corners c JOIN vox v ON v.angle = c.angle AND v.det_x IN (x0, x0 + 1) AND v.det_y IN (y0, y0 + 1) GROUP BY c.angle, c.det_y, c.det_x)"""
    + PIXELS
)


@query
def find_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four searches for the centre of rotation, on one sinogram or two projections."""
    scan = scan_of(spark, sf_dir)
    sino = centre.sinogram(scan.lines, scan.shape[1])
    first, last = centre.projection(scan.lines, 0), centre.projection(scan.lines, scan.shape[0] - 1)
    half = len(sino) // 2
    cor_360, overlap, side, place = centre.by_overlap(sino[:half], sino[half : 2 * half])
    theta = np.linspace(0, np.pi, len(sino))
    rows = [
        ("vo", centre.by_symmetry(sino, -5, 5), None, None, None),
        ("pc", centre.by_phase_correlation(first, last), None, None, None),
        ("360", cor_360, overlap, side, place),
        ("entropy", centre.best_sharpness(sino, theta, [30.5, 31.5, 32.5]), None, None, None),
    ]
    return spark.createDataFrame(rows, "method string, cor double, overlap double, side string, overlap_position double")


@query
def pipeline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings for a good and a broken pipeline."""
    rows = [(name, f.rule, f.step, f.ok, f.message) for name, text in (("good", EXAMPLE), ("broken", BROKEN)) for f in checks.check(text)]
    return spark.createDataFrame(rows, "pipeline string, " + checks.SCHEMA)


ORACLES["pipeline_check"] = """
WITH rules(rule) AS (VALUES
  ('syntax'), ('duplicate_key'), ('keys'), ('loader_first'), ('method_exists'), ('parameter_known'), ('required_given'), ('names_text'), ('no_required_left'),
  ('no_images_after_sweep'), ('id_side_outputs'), ('id_unique'), ('reference_form'), ('reference_id'), ('reference_name'), ('one_sweep'), ('sweep_no_side_outputs'), ('seam_order')),
broken(rule, step, message) AS (VALUES
  ('keys', 1, 'key ''parameters'' is missing'), ('loader_first', 0, 'the first step has to be a loader'), ('method_exists', 1, 'unknown method ''no_such_method'''),
  ('id_side_outputs', 2, 'a step with an id declares side outputs'), ('reference_id', 2, 'no step ''nowhere'' before'))
SELECT 'good' AS pipeline, rule, -1 AS step, true AS ok, '' AS message FROM rules
UNION ALL
SELECT 'broken', rule, coalesce(step, -1), step IS NULL, coalesce(message, '') FROM rules LEFT JOIN broken USING (rule)"""


def staged(pipeline: Pipeline):
    return plan_stages(rewrite(pipeline))


@query
def plan_stages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten pipeline, step by step, with its stages."""
    _, stages = staged(parse(EXAMPLE))
    rows = [(i, s.pattern, s.padding[0], s.last, k, step.method) for i, s in enumerate(stages) for k, step in enumerate(s.steps)]
    return spark.createDataFrame(rows, "stage int, pattern string, padding int, last boolean, place int, method string")


ORACLES["plan_stages_table"] = """
WITH steps(stage, pattern, padding, last, place, method) AS (VALUES
  (0, 'projection', 0, false, 0, 'data_reducer'), (0, 'projection', 0, false, 1, 'remove_outlier'), (0, 'projection', 0, false, 2, 'data_checker'),
  (0, 'projection', 0, false, 3, 'normalize'), (0, 'projection', 0, false, 4, 'data_checker'),
  (1, 'sinogram', 0, false, 0, 'remove_stripe_based_sorting'), (1, 'sinogram', 0, false, 1, 'data_checker'), (1, 'sinogram', 0, false, 2, 'find_center_vo'),
  (2, 'sinogram', 0, false, 0, 'FBP'), (2, 'sinogram', 0, false, 1, 'save_intermediate_data'), (2, 'sinogram', 0, false, 2, 'data_checker'), (2, 'sinogram', 0, false, 3, 'calculate_stats'),
  (3, 'sinogram', 0, true, 0, 'rescale_to_int'))
SELECT * FROM steps"""


ORACLES["memory_estimate"] = """
WITH shares AS (SELECT unnest([1, 2, 4, 8]) AS parts),
stages(stage, n, y, x, out_n, along_angles, moves, factor) AS (VALUES
  (0, 1800, 2160, 2560, 1800, true, true, 2.0), (1, 1800, 2160, 2560, 1800, false, false, 2.0), (2, 1800, 2160, 2560, 2560, false, false, 6.0), (3, 2560, 2160, 2560, 2560, false, false, 2.0)),
bytes AS (
  SELECT parts, stage, 4::BIGINT * n * y * x // parts AS input_bytes, 4::BIGINT * out_n * y * x // parts AS output_bytes,
         CASE WHEN moves THEN 4::BIGINT * out_n * y * x ELSE 0 END AS moved_bytes, CASE WHEN along_angles THEN n ELSE y END AS length, 4::BIGINT * n * y * x // CASE WHEN along_angles THEN n ELSE y END AS frame, factor
  FROM shares, stages)
SELECT parts, stage, input_bytes, output_bytes, moved_bytes, ceil(moved_bytes / 134217728.0)::INT AS shuffle_partitions,
       max(input_bytes + output_bytes) OVER (PARTITION BY parts) AS peak_bytes, greatest(1, least(length, floor(8589934592 / (frame * (1 + factor)))))::INT AS batch
FROM bytes"""


@query
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each stage's share for one to eight shares of a scan of 1800 x 2160 x 2560, and the partitions its exchange wants."""
    _, stages = staged(parse(EXAMPLE))
    rows, shape = [], (1800, 2160, 2560)
    for parts in (1, 2, 4, 8):
        peak, now = peak_memory(stages, shape, parts), shape
        for i, stage in enumerate(stages):
            e = stage_memory(stages, i, now, parts)
            frame = 4 * int(np.prod(now)) // now[AXIS[stage.pattern]]
            rows.append((parts, i, e.input_bytes, e.output_bytes, e.moved_bytes, shuffle_partitions(e.moved_bytes), peak, slices_per_batch(stage, frame, 8 << 30, now[AXIS[stage.pattern]])))
            now = e.output_shape
    return spark.createDataFrame(rows, "parts int, stage int, input_bytes long, output_bytes long, moved_bytes long, shuffle_partitions int, peak_bytes long, batch int")


@query
def run_example_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example from correction to rescaled reconstruction, over the whole cube."""
    return numbers(run_pipeline(rewrite(parse(EXAMPLE)), scan_of(spark, sf_dir), Settings(persist=False)).lines)


@query
def run_example_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipeline = rewrite(parse(SWEEP))
    return numbers(run_sweep(pipeline, scan_of(spark, sf_dir, {"detector_y": {"start": 3, "stop": 8}})).lines)


@query
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections as encoded images: name and size of each."""
    lines = cube(spark, sf_dir).lines().where(F.col("image_key") == PROJECTION)
    made = images(lines.select("angle", "det_y", "line"), 0)
    return made.select("name", F.octet_length("content").alias("bytes"), F.crc32("content").alias("crc"))
