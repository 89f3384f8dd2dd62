"""Queries over the cube, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoflow.functions.columns import spaced
from tomoflow.operators import aggregate, elementwise, frames, halo, neighbourhood, percentiles, reorient, sweep
from tomoflow.plans.model import Preview
from tomoflow.plans.preview import Frames, StoredAngles, UserAngles, continuous_subset, parse_preview, sweep_preview
from tomoflow.sources.declared import declared_scan, lines_from
from tomoflow.sources.scan import DARK, FLAT, PROJECTION, CubeTable, crop, dummy_frames, frames_of, renumbered, user_angles, voxels

ROWS = 10

# Common tables of the SQL below: the cube's lines, and its pixels as doubles
CUBE = """
cube AS (SELECT (max(vec_id) // 10 + 1)::INT AS n FROM embeddings),
lines AS (
  SELECT (vec_id // 10)::INT AS angle, (vec_id % 10)::INT AS det_y, embedding AS line,
         CASE WHEN vec_id // 10 < 0.8 * n THEN 0 WHEN vec_id // 10 < 0.9 * n THEN 1 ELSE 2 END AS image_key
  FROM embeddings, cube),
pixels AS (
  SELECT angle, det_y, image_key, (generate_subscripts(line, 1) - 1)::INT AS det_x, unnest(line)::DOUBLE AS v FROM lines),
vox AS (SELECT angle, det_y, det_x, v FROM pixels WHERE image_key = 0)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class SampleCube(CubeTable):
    """The driver's vectors as a scan; its table has no image key, so these queries set one."""

    def default_image_key(self, angle: Column) -> Column:
        """The last fifth of the angles are calibration frames: flats, then darks."""
        n = self.shape[0]
        return F.when(angle < 0.8 * n, PROJECTION).when(angle < 0.9 * n, FLAT).otherwise(DARK)


def cube(spark: SparkSession, sf_dir: str) -> CubeTable:
    return SampleCube(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", ROWS)


def query(sql: str | None):
    """Register a query under its function's name, with its SQL (after the cube's tables)."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = f"WITH {CUBE.strip()}{sql}"
        return function

    return add


def projections(spark: SparkSession, sf_dir: str) -> tuple[CubeTable, DataFrame]:
    """The pixels of the projections: angle, det_y, det_x, v."""
    table = cube(spark, sf_dir)
    return table, voxels(table.lines().where(F.col("image_key") == PROJECTION))


def projection_lines(spark: SparkSession, sf_dir: str) -> tuple[CubeTable, DataFrame]:
    table = cube(spark, sf_dir)
    return table, table.lines().where(F.col("image_key") == PROJECTION).select("angle", "det_y", "line")


def corrected(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The corrected projections, line by line."""
    table, lines = projection_lines(spark, sf_dir)
    return elementwise.corrected_lines(lines, calibration(table, DARK), calibration(table, FLAT), frame_pixels=table.shape[1] * table.shape[2], **options)


def whole(table: CubeTable) -> Preview:
    return parse_preview(None, table.shape)


def calibration(table: CubeTable, key: int) -> DataFrame:
    return frames_of(table.lines(), key, whole(table))


def rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# sources, previews, selections


@query(", s AS (SELECT * FROM pixels WHERE angle >= 5 AND angle < 20 AND det_y >= 3 AND det_y < 6 AND det_x >= 2 AND det_x < 34) SELECT angle, det_y, image_key, det_x, v FROM s")
def crop_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cube(spark, sf_dir)
    asked = {"angles": {"start": 5, "stop": 20}, "detector_y": "mid", "detector_x": {"start": "begin", "start_offset": 2, "stop": "mid", "stop_offset": 3}}
    preview = parse_preview(asked, table.shape)
    rows = crop(table.lines(preview), preview)
    return voxels(rows, "image_key").withColumn("det_x", F.col("det_x") + preview.detector_x.start)


@query(", k AS (SELECT DISTINCT angle FROM lines WHERE image_key = 1), r AS (SELECT angle, (row_number() OVER (ORDER BY angle) - 1)::INT AS place FROM k) SELECT place AS angle, det_y, len(line)::INT AS width, round(line[1]::DOUBLE, 6) AS first_v FROM lines JOIN r USING (angle)")
def image_key_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = renumbered(cube(spark, sf_dir).lines().where(F.col("image_key") == FLAT))
    return lines.select("angle", "det_y", F.size("line").alias("width"), F.round(F.col("line")[0].cast("double"), 6).alias("first_v"))


@query(" SELECT angle, count(*) AS n_lines FROM lines WHERE angle >= 7 AND angle < 13 GROUP BY angle")
def continuous_scan_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cube(spark, sf_dir)
    preview = continuous_subset(whole(table), {"start": 7, "stop": 13})
    return crop(table.lines(preview), preview).groupBy("angle").agg(F.count(F.lit(1)).alias("n_lines"))


@query(" SELECT count(DISTINCT angle) AS n_angles, count(DISTINCT det_y) AS detector_y, max(len(line))::BIGINT AS detector_x FROM lines WHERE image_key = 0")
def cropped_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cube(spark, sf_dir).lines().where(F.col("image_key") == PROJECTION)
    return lines.agg(F.countDistinct("angle").alias("n_angles"), F.countDistinct("det_y").alias("detector_y"), F.max(F.size("line")).cast("long").alias("detector_x"))


@query(" SELECT i::INT AS angle, round(radians(i * 180.0 / (n - 1)), 9) AS theta FROM cube, range(n) t(i)")
def linspace_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cube(spark, sf_dir).shape[0]
    return rounded(user_angles(spark, UserAngles(0.0, 180.0, n)), "theta", digits=9)


@query(" SELECT det_y, i::INT AS place, round(5e-1 + i * 3e-1, 9) AS value FROM (SELECT det_y, max(angle) + 1 AS n FROM lines GROUP BY det_y), range(n) t(i)")
def arange_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced values, one for each angle of each row."""
    lengths = cube(spark, sf_dir).lines().groupBy("det_y").agg((F.max("angle") + 1).alias("n"))
    values = lengths.select("det_y", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: 0.5 + i * 0.3)).alias("place", "value"))
    return rounded(values, "value", digits=9)


@query(", a AS (SELECT DISTINCT angle FROM lines WHERE image_key = 0) SELECT angle, count(*) AS n_lines, round(radians(angle * 180.0 / (max(n) - 1)), 9) AS theta FROM lines JOIN a USING (angle), cube GROUP BY angle")
def angles_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cube(spark, sf_dir)
    lines = table.lines().where(F.col("image_key") == PROJECTION)
    counts = lines.groupBy("angle").agg(F.count(F.lit(1)).alias("n_lines"))
    return rounded(counts.join(table.angle_table(), "angle"), "theta", digits=9)


@query(" SELECT DISTINCT angle FROM lines WHERE angle NOT IN (SELECT angle FROM lines WHERE image_key <> 0)")
def frames_without_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cube(spark, sf_dir).lines()
    other = lines.where(F.col("image_key") != PROJECTION).select("angle").distinct()
    return lines.select("angle").distinct().join(other, "angle", "left_anti")


@query(" SELECT DISTINCT angle FROM lines WHERE image_key = 0 INTERSECT SELECT angle FROM lines WHERE angle >= 10 AND angle < 25")
def frames_in_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cube(spark, sf_dir)
    lines = table.lines()
    preview = parse_preview({"angles": {"start": 10, "stop": 25}}, table.shape)
    return lines.where(F.col("image_key") == PROJECTION).select("angle").intersect(crop(table.lines(preview), preview).select("angle"))


@query(" SELECT CASE image_key WHEN 1 THEN 'flat' ELSE 'dark' END AS kind, det_y, det_x, round(avg(v), 6) AS v FROM pixels WHERE image_key > 0 GROUP BY ALL")
def dark_flat_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cube(spark, sf_dir)
    means = [aggregate.calibration_mean(calibration(table, key)).withColumn("kind", F.lit(kind)) for kind, key in (("flat", FLAT), ("dark", DARK))]
    return rounded(means[0].unionByName(means[1]), "v", digits=6).select("kind", "det_y", "det_x", "v")


@query(" SELECT kind, y::INT AS det_y, v::DOUBLE AS first_v, 64 AS width FROM (VALUES ('dark', 0.0), ('flat', 1.0)) k(kind, v), range(10) t(y)")
def dummy_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, width = cube(spark, sf_dir).shape
    both = [dummy_frames(spark, value, rows, width).withColumn("kind", F.lit(kind)) for kind, value in (("dark", 0.0), ("flat", 1.0))]
    return both[0].union(both[1]).select("kind", "det_y", F.col("line")[0].alias("first_v"), F.size("line").alias("width"))


# corrections and values

CORRECTED = """, dark AS (SELECT det_y, det_x, avg(v) AS d FROM pixels WHERE image_key = 2 GROUP BY ALL),
flat AS (SELECT det_y, det_x, avg(v) AS f FROM pixels WHERE image_key = 1 GROUP BY ALL),
done AS (
  SELECT angle, det_y, det_x, least(greatest((v - d) / CASE WHEN abs(f - d) < 1e-6 THEN 1e-6 ELSE f - d END, -10.0), 10.0) AS v
  FROM vox JOIN dark USING (det_y, det_x) JOIN flat USING (det_y, det_x))"""


@query(CORRECTED + " SELECT angle, det_y, det_x, round(v, 5) AS v FROM done")
def flat_field_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voxels(corrected(spark, sf_dir)), "v")


@query(CORRECTED + " SELECT angle, round(avg(v), 5) AS mean_v, round(min(v), 5) AS min_v, round(max(v), 5) AS max_v FROM done GROUP BY angle")
def projection_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = corrected(spark, sf_dir).select("angle", F.aggregate("line", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("line").alias("n"), F.array_min("line").alias("low"), F.array_max("line").alias("high"))
    stats = parts.groupBy("angle").agg((F.sum("total") / F.sum("n")).alias("mean_v"), F.min("low").alias("min_v"), F.max("high").alias("max_v"))
    return rounded(stats, "mean_v", "min_v", "max_v")


@query(CORRECTED + " SELECT angle, det_y, det_x, round(-ln(greatest(v, 1e-6)), 5) AS v FROM done")
def dark_flat_minus_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voxels(corrected(spark, sf_dir, minus_log=True)), "v")


@query(" SELECT angle, det_y, det_x, round(-ln(greatest(v, 1e-6)), 5) AS v FROM vox")
def minus_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voxels(elementwise.minus_log_lines(projection_lines(spark, sf_dir)[1])), "v")


# every 17th column is made NaN, every 19th infinite
SPOILED = ", bad AS (SELECT angle, det_y, det_x, CASE WHEN det_x % 17 = 3 THEN 'NaN'::DOUBLE WHEN det_x % 19 = 5 THEN '-Infinity'::DOUBLE ELSE v END AS v FROM vox)"


def spoiled(pixels: DataFrame) -> DataFrame:
    bad = F.when(F.col("det_x") % 17 == 3, float("nan")).when(F.col("det_x") % 19 == 5, float("-inf"))
    return pixels.withColumn("v", bad.otherwise(F.col("v")))


@query(SPOILED + " SELECT angle, det_y, det_x, round(CASE WHEN isfinite(v) THEN v ELSE 0 END, 6) AS v FROM bad")
def nan_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.clean(spoiled(projections(spark, sf_dir)[1])), "v", digits=6)


@query(SPOILED + " SELECT angle, count(*) FILTER (NOT isfinite(v)) AS not_finite, count(*) FILTER (v = 0) AS zeros, count(*) AS n FROM bad GROUP BY angle")
def data_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.bad_values(spoiled(projections(spark, sf_dir)[1]), "angle")


CLEAN = SPOILED + ", clean AS (SELECT angle, det_y, det_x, CASE WHEN isfinite(v) THEN v ELSE 0 END AS v FROM bad)"


@query(CLEAN + ' SELECT round(min(v), 6) AS "min", round(max(v), 6) AS "max", round(avg(v), 6) AS mean, count(v) AS n FROM clean')
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.global_stats(spoiled(projections(spark, sf_dir)[1])), "min", "max", "mean", digits=6)


@query(CLEAN + ' SELECT det_y, round(min(v), 6) AS "min", round(max(v), 6) AS "max", round(avg(v), 6) AS mean, count(v) AS n FROM clean GROUP BY det_y')
def sinogram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.global_stats(spoiled(projections(spark, sf_dir)[1]), "det_y"), "min", "max", "mean", digits=6)


@query(", s AS (SELECT min(v) AS lo, max(v) AS hi FROM vox) SELECT angle, det_y, det_x, floor(255 * ((v - lo) / (hi - lo)))::INT AS v FROM vox, s")
def rescale_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(elementwise.rescaled_lines(projection_lines(spark, sf_dir)[1])).withColumn("v", F.col("v").cast("int"))


@query(", p AS (SELECT angle, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM vox GROUP BY angle) SELECT angle, det_y, det_x, floor(255 * (least(greatest(v, lo), hi) - lo) / (hi - lo))::INT AS v FROM vox JOIN p USING (angle)")
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(percentiles.stretched(projection_lines(spark, sf_dir)[1], "angle")).withColumn("v", F.col("v").cast("int"))


@query(", m AS (SELECT vox.* FROM vox, cube WHERE det_y = 5), p AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM m) SELECT angle, det_y, det_x, floor(255 * (least(greatest(v, lo), hi) - lo) / (hi - lo))::INT AS v FROM m, p")
def middle_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomoflow.sources.sinks import snapshot

    table = cube(spark, sf_dir)
    return snapshot(table.lines().where(F.col("image_key") == PROJECTION), table.shape, "sinogram")


# orientation


@query(" SELECT det_y, count(*) AS n_lines, round(sum(list_sum(line::DOUBLE[])), 4) AS total, round(max_by(line[3]::DOUBLE, angle), 6) AS probe FROM lines WHERE image_key = 0 GROUP BY det_y")
def reslice_sinogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cube(spark, sf_dir).lines().where(F.col("image_key") == PROJECTION)
    frames = reorient.frames(lines.select("angle", "det_y", F.col("line").cast("array<double>").alias("line")))
    flat = F.flatten("frame")
    total = F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)
    return frames.select("det_y", "n_lines", F.round(total, 4).alias("total"), F.round(F.element_at("frame", -1)[2], 6).alias("probe"))


@query(" SELECT det_y AS angle, angle AS det_y, round(line[1]::DOUBLE, 6) AS first_v FROM lines WHERE image_key = 0")
def axis_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = reorient.swapped(cube(spark, sf_dir).lines().where(F.col("image_key") == PROJECTION))
    return lines.select("angle", "det_y", F.round(F.col("line")[0].cast("double"), 6).alias("first_v"))


@query(" SELECT angle, det_x, round(avg(v), 6) AS v FROM vox WHERE det_y BETWEEN 2 AND 6 GROUP BY ALL")
def row_average_sinogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, pixels = projections(spark, sf_dir)
    rows = table.shape[1]
    return rounded(aggregate.averaged_rows(pixels, (rows - 1) // 2, 2, rows), "v", digits=6)


@query(" SELECT det_y, det_x, min_by(v, angle) AS first_v, max_by(v, angle) AS last_v FROM vox GROUP BY ALL")
def first_last_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.first_and_last(projections(spark, sf_dir)[1])


@query(" SELECT angle, det_x, v FROM vox WHERE det_y = 4")
def single_sinogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, pixels = projections(spark, sf_dir)
    return pixels.where(F.col("det_y") == (table.shape[1] - 1) // 2).select("angle", "det_x", "v")


@query(" SELECT (angle // 3)::INT AS angle, det_y, det_x, round(avg(v), 6) AS v FROM vox GROUP BY ALL")
def average_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.averaged_frames(projections(spark, sf_dir)[1], 3), "v", digits=6)


@query(" SELECT (i // 3)::INT AS angle, round(avg(radians(i * 180.0 / (n - 1))), 9) AS theta FROM cube, range(n) t(i) GROUP BY ALL")
def average_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.averaged_angles(cube(spark, sf_dir).angle_table(), 3), "theta", digits=9)


@query(", h AS (SELECT count(DISTINCT angle) // 2 AS h FROM vox) SELECT a.angle, a.det_y, a.det_x, round((a.v + b.v) / 2, 6) AS v FROM vox a JOIN h ON a.angle < h JOIN vox b ON b.angle = a.angle + h AND b.det_y = a.det_y AND b.det_x = 63 - a.det_x")
def fold_360_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, lines = projection_lines(spark, sf_dir)
    half = lines.agg(F.countDistinct("angle")).first()[0] // 2
    return rounded(voxels(reorient.folded(lines, half, table.shape[2])), "v", digits=6)


@query(""", h AS (SELECT count(DISTINCT angle) // 2 AS h FROM vox),
l AS (SELECT (angle - h)::INT AS angle, det_y, 63 - det_x AS det_x, v, CASE WHEN 63 - det_x >= 56 THEN 1 - (63 - det_x - 56 + 0.5) / 8 ELSE 1 END AS w FROM vox, h WHERE angle >= h AND angle < 2 * h),
r AS (SELECT angle, det_y, det_x + 56 AS det_x, v, CASE WHEN det_x < 8 THEN (det_x + 0.5) / 8 ELSE 1 END AS w FROM vox, h WHERE angle < h)
SELECT angle, det_y, det_x::INT AS det_x, round(sum(v * w) / sum(w), 5) AS v FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY ALL""")
def stitch_360_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, lines = projection_lines(spark, sf_dir)
    half = lines.agg(F.countDistinct("angle")).first()[0] // 2
    return rounded(voxels(reorient.folded(lines, half, table.shape[2], 8)), "v")


@query(" SELECT angle, (det_y // 2)::INT AS det_y, (det_x // 2)::INT AS det_x, round(avg(v), 6) AS v FROM vox GROUP BY ALL")
def data_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.binned(projections(spark, sf_dir)[1], 2), "v", digits=6)


@query(", e AS (SELECT angle, det_y, max(v) FILTER (det_x = 30) AS a, max(v) FILTER (det_x = 34) AS b FROM vox GROUP BY ALL) SELECT angle, det_y, det_x, round(CASE WHEN det_x BETWEEN 30 AND 34 THEN a + (b - a) * ((det_x - 30) / 4.0) ELSE v END, 6) AS v FROM vox JOIN e USING (angle, det_y)")
def seam_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voxels(reorient.seam_blended(projection_lines(spark, sf_dir)[1], 32, 2)), "v", digits=6)


# neighbourhoods



def around(spark: SparkSession, sf_dir: str, function: Callable, reach: tuple[int, int, int]) -> DataFrame:
    table, lines = projection_lines(spark, sf_dir)
    return voxels(function(lines, reach, table.shape[2]))


AROUND = ", around AS (SELECT *, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS b FROM vox WINDOW w AS (PARTITION BY det_y, det_x ORDER BY angle))"


@query(""", e AS (SELECT max(angle) AS last FROM vox)
SELECT angle, det_y, det_x, true AS core, v FROM vox
UNION ALL SELECT o::INT, det_y, det_x, false, v FROM vox, (VALUES (-1), (-2)) t(o) WHERE angle = 0
UNION ALL SELECT (last + o)::INT, det_y, det_x, false, v FROM vox, e, (VALUES (1), (2), (3)) t(o) WHERE angle = last""")
def halo_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = projection_lines(spark, sf_dir)[1]
    n = lines.agg(F.max("angle")).first()[0] + 1
    return voxels(halo.padded(lines, 2, 3, n), "core").select("angle", "det_y", "det_x", "core", "v")


@query(""", e AS (SELECT max(angle) + 1 AS n FROM vox),
b AS (SELECT i::INT AS block, (i * 7)::INT AS first, least(i * 7 + 7, n)::INT AS stop FROM e, range((n + 6) // 7) t(i)),
p AS (SELECT block, first, stop, a::INT AS angle, least(greatest(a, 0), n - 1)::INT AS read FROM b, e, range(-2, n + 2) t(a) WHERE a >= first - 2 AND a < CASE WHEN first + 7 + 2 > n + 2 THEN n + 2 ELSE first + 7 + 2 END)
SELECT block, p.angle >= first AND p.angle < stop AS core, count(*) AS n, round(sum(v), 4) AS total FROM p JOIN vox ON vox.angle = p.read GROUP BY ALL""")
def blocks_with_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = projection_lines(spark, sf_dir)[1]
    n = lines.agg(F.max("angle")).first()[0] + 1
    dealt = voxels(halo.blocks(lines, 7, 2, 2, n), "block", "core")
    return rounded(dealt.groupBy("block", "core").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total", digits=4)


@query(AROUND + " SELECT angle, det_y, det_x, round((v + a + b) / 3, 6) AS v FROM around")
def neighbourhood_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(around(spark, sf_dir, neighbourhood.mean_filter, (1, 0, 0)), "v", digits=6)


@query(AROUND + " SELECT angle, det_y, det_x, greatest(least(a, v), least(greatest(a, v), b)) AS v FROM around")
def median_radius1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return around(spark, sf_dir, neighbourhood.median_filter, (1, 0, 0))


@query(""", e AS (SELECT max(angle) AS last FROM vox),
near AS (SELECT x.angle, x.det_y, x.det_x, y.v FROM vox x, e, (VALUES (-2), (-1), (0), (1), (2)) t(o) JOIN vox y ON y.det_y = x.det_y AND y.det_x = x.det_x AND y.angle = least(greatest(x.angle + o, 0), last))
SELECT angle, det_y, det_x, median(v) AS v FROM near GROUP BY ALL""")
def median_radius2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return around(spark, sf_dir, neighbourhood.median_filter, (2, 0, 0))


@query(""", around AS (SELECT *, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS b FROM vox WINDOW w AS (PARTITION BY angle, det_y ORDER BY det_x)),
m AS (SELECT *, greatest(least(a, v), least(greatest(a, v), b)) AS median FROM around)
SELECT angle, det_y, det_x, CASE WHEN abs(v - median) > 0.5 THEN median ELSE v END AS v FROM m""")
def outlier_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(halo.remove_outlier_lines(projection_lines(spark, sf_dir)[1], 0.5))


NEAR_27 = """, e AS (SELECT max(angle) AS last FROM vox),
offsets AS (SELECT a.o AS oa, y.o AS oy, x.o AS ox FROM (VALUES (-1), (0), (1)) a(o), (VALUES (-1), (0), (1)) y(o), (VALUES (-1), (0), (1)) x(o)),
near AS (
  SELECT p.angle, p.det_y, p.det_x, p.v, q.v AS w FROM vox p, e, offsets
  JOIN vox q ON q.angle = least(greatest(p.angle + oa, 0), last) AND q.det_y = least(greatest(p.det_y + oy, 0), 9) AND q.det_x = least(greatest(p.det_x + ox, 0), 63)),
m AS (SELECT angle, det_y, det_x, any_value(v) AS v, median(w) AS median FROM near GROUP BY ALL)"""


@query(NEAR_27 + " SELECT angle, det_y, det_x, CASE WHEN abs(v - median) > 0.5 THEN median ELSE v END AS v FROM m")
def outlier_replace_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, lines = projection_lines(spark, sf_dir)
    return voxels(neighbourhood.remove_outliers(lines, 0.5, (1, 1, 1), table.shape[2]))


def _box(axis: str, others: str, before: str, name: str) -> str:
    return f", {name} AS (SELECT angle, det_y, det_x, v + coalesce(lag(v) OVER w, v) + coalesce(lead(v) OVER w, v) AS v FROM {before} WINDOW w AS (PARTITION BY {others} ORDER BY {axis}))"


@query(_box("angle", "det_y, det_x", "vox", "b1") + _box("det_y", "angle, det_x", "b1", "b2") + _box("det_x", "angle, det_y", "b2", "b3") + " SELECT angle, det_y, det_x, round(v, 5) AS v FROM b3")
def neighbourhood_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(around(spark, sf_dir, neighbourhood.box_sum, (1, 1, 1)), "v")


@query(""", e AS (SELECT max(angle) AS last FROM vox),
near AS (
  SELECT p.angle, p.det_y, p.det_x, p.v, q.v AS w FROM vox p, (VALUES (-1), (0), (1)) t(o)
  JOIN vox q ON q.angle = p.angle AND q.det_y = p.det_y AND q.det_x = least(greatest(p.det_x + o, 0), 63)),
outs AS (SELECT angle, det_y, det_x, (abs(any_value(v) - median(w)) > 0.02)::INT AS o FROM near GROUP BY ALL),
longs AS (
  SELECT p.angle, p.det_y, p.det_x, (sum(q.o) >= 0.6 * 5)::INT AS o FROM outs p, e, (VALUES (-2), (-1), (0), (1), (2)) t(d)
  JOIN outs q ON q.angle = least(greatest(p.angle + d, 0), last) AND q.det_y = p.det_y AND q.det_x = p.det_x GROUP BY ALL),
deeps AS (
  SELECT p.angle, p.det_y, p.det_x, (any_value(p.o) = 1 AND sum(q.o) >= 2)::INT AS o FROM longs p, (VALUES (-1), (0), (1)) t(d)
  JOIN longs q ON q.angle = p.angle AND q.det_y = least(greatest(p.det_y + d, 0), 9) AND q.det_x = p.det_x GROUP BY ALL)
SELECT angle, det_y, det_x, CASE WHEN o = 1 OR coalesce(max(o) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) = 1
    AND max(o) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) = 1, false) THEN 1.0 ELSE 0.0 END::DOUBLE AS v
FROM deeps WINDOW w AS (PARTITION BY angle, det_y ORDER BY det_x)""")
def stripes_mask_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripes by rules along columns, angles and rows."""
    table, lines = projection_lines(spark, sf_dir)
    return voxels(neighbourhood.stripes_mask(lines, 0.02, columns=1, length=2, threshold=0.6, width=table.shape[2]))


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY det_y, det_x ORDER BY v, angle) AS place FROM vox),
n AS (SELECT *, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS b FROM r WINDOW w AS (PARTITION BY det_y, place ORDER BY det_x))
SELECT angle, det_y, det_x, greatest(least(a, v), least(greatest(a, v), b)) AS v FROM n""")
def stripe_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(frames.each_frame(projection_lines(spark, sf_dir)[1], frames.sort_stripes, "sinogram"))


@query(" SELECT x.angle, x.det_y, count(*) AS neighbours, round(sum(y.line[1]::DOUBLE), 6) AS total FROM lines x JOIN lines y ON x.det_y = y.det_y AND abs(x.angle - y.angle) <= 2 WHERE x.image_key = 0 AND y.image_key = 0 GROUP BY ALL")
def range_join_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within two angles of each other: an equi-join on the row and a bin of angles."""
    lines = cube(spark, sf_dir).lines().where(F.col("image_key") == PROJECTION).select("angle", "det_y", F.col("line")[0].cast("double").alias("v"))
    reach, size = 2, 8
    here = lines.withColumn("bin", F.floor(F.col("angle") / size))
    there = lines.select(
        F.col("angle").alias("angle_2"), F.col("det_y"), F.col("v").alias("w"), F.explode(F.sequence(F.floor((F.col("angle") - reach) / size), F.floor((F.col("angle") + reach) / size))).alias("bin")
    )
    near = here.join(there, ["det_y", "bin"]).where(F.abs(F.col("angle") - F.col("angle_2")) <= reach)
    return rounded(near.groupBy("angle", "det_y").agg(F.count(F.lit(1)).alias("neighbours"), F.sum("w").alias("total")), "total", digits=6)


# planning tables


@query(" SELECT i::INT AS part, round_even(n / 7.0 * i, 0)::INT AS start, round_even(n / 7.0 * (i + 1), 0)::INT AS stop FROM cube, range(7) t(i)")
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorient.chunk_table(spark, cube(spark, sf_dir).shape[0], 7)


@query(" SELECT i::INT AS block, (i * 16)::INT AS start, least(i * 16 + 16, n)::INT AS stop, i = (n + 15) // 16 - 1 AS last FROM cube, range((n + 15) // 16) t(i)")
def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorient.block_table(spark, cube(spark, sf_dir).shape[0], 16)


@query(", p AS (SELECT (vec_id // 64)::INT AS part, count(*) AS length FROM embeddings GROUP BY ALL) SELECT part, length, coalesce(sum(length) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (sum(length) OVER ())::BIGINT AS total FROM p")
def extents_and_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cube(spark, sf_dir).table
    parts = table.groupBy(F.expr("vec_id div 64").cast("int").alias("part")).agg(F.count(F.lit(1)).alias("length"))
    return aggregate.extents(parts, "part", "length")


@query(", p AS (SELECT (vec_id // 64)::INT AS part, count(*) * 256 AS bytes FROM embeddings GROUP BY ALL) SELECT bool_or(bytes >= 16384) AS to_disk, min(bytes)::BIGINT AS least_bytes, max(bytes)::BIGINT AS most_bytes FROM p")
def spill_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cube(spark, sf_dir).table
    parts = table.groupBy(F.expr("vec_id div 64").alias("part")).agg((F.count(F.lit(1)) * 256).alias("bytes"))
    return parts.agg(F.bool_or(F.col("bytes") >= 16384).alias("to_disk"), F.min("bytes").alias("least_bytes"), F.max("bytes").alias("most_bytes"))


# sweeps


@query(", s AS (SELECT * FROM (VALUES (0, 0.5), (1, 1.0), (2, 2.0), (3, 4.0)) t(sweep_idx, value)) SELECT angle, sweep_idx::INT AS det_y, det_x, round(least(greatest(v * value, -1.0), 1.0), 6) AS v FROM vox, s WHERE det_y = 5")
def sweep_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cube(spark, sf_dir)
    preview = sweep_preview(whole(table), table.shape[1])
    pixels = voxels(crop(table.lines(preview).where(F.col("image_key") == PROJECTION), preview))
    clipped = F.least(F.greatest(F.col("v") * F.col("value"), F.lit(-1.0)), F.lit(1.0))
    results = sweep.swept(pixels, sweep.sweep_values(spark, (0.5, 1.0, 2.0, 4.0)), lambda p: p.withColumn("v", clipped).drop("value"))
    middle = sweep.middle_rows(results, 2 * preview.detector_y.start + len(preview.detector_y))
    return rounded(middle.select("angle", "det_y", "det_x", "v"), "v", digits=6)


@query(" SELECT angle, det_y, det_x, 0 AS sweep_idx, round(v * 0.5, 6) AS v FROM vox UNION ALL SELECT angle, det_y, det_x, 1, round(v * 3, 6) FROM vox")
def sweep_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = projections(spark, sf_dir)[1]
    runs = [pixels.withColumn("v", F.col("v") * value) for value in (0.5, 3.0)]
    return rounded(sweep.stacked(runs).select("angle", "det_y", "det_x", "sweep_idx", "v"), "v", digits=6)


@query(" SELECT angle, det_y, i::INT AS place, round(line[1]::DOUBLE + i * (line[64]::DOUBLE - line[1]::DOUBLE) / 4, 6) AS value FROM lines, range(5) t(i)")
def linspace_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spaced values from the first value of each line to its last."""
    lines = cube(spark, sf_dir).lines().select("angle", "det_y", F.col("line").cast("array<double>").alias("line"))
    values = lines.select("angle", "det_y", F.posexplode(spaced(F.col("line")[0], F.element_at("line", -1), 5)).alias("place", "value"))
    return rounded(values, "value", digits=6)


@query(" SELECT angle, det_y, det_x, v FROM vox")
def save_and_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intermediate result written with its angles and extents, and read back."""
    from tomoflow.sources.scan import open_scan
    from tomoflow.sources.sinks import load_scan, save_scan

    table = cube(spark, sf_dir)
    lines = table.lines().where(F.col("image_key") == PROJECTION)
    n = lines.agg(F.max("angle")).first()[0] + 1
    preview = parse_preview({"angles": {"start": 0, "stop": n}}, table.shape)
    scan = open_scan(table.lines(preview), table.shape, preview, UserAngles(0.0, 180.0, n))
    path = scratch(spark, "saved")
    save_scan(scan, path)
    return voxels(load_scan(spark, path, scan.darks, scan.flats).lines)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share; what is written there goes when the process ends."""
    import atexit
    import contextlib
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(drop)
    return path


# A scan whose calibration frames lie between its projections, with an angle of its own for each frame
STORED = """, k AS (SELECT (vec_id // 10)::INT AS a, (vec_id % 10)::INT AS det_y, embedding AS line FROM embeddings)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    angle = F.expr(f"vec_id div {ROWS}").cast("int")
    return table.select(
        angle.alias("angle"),
        (F.col("vec_id") % ROWS).cast("int").alias("det_y"),
        F.when(angle % 5 == 2, DARK).when(angle % 5 == 4, FLAT).otherwise(PROJECTION).alias("image_key"),
        (angle * 0.25 + 1.0).alias("rotation_angle"),
        F.col("embedding").alias("line"),
    )


def first_mean(frames: DataFrame, name: str) -> DataFrame:
    return frames.groupBy("det_y").agg(F.round(F.avg(F.col("line")[0].cast("double")), 6).alias(name))


@query(f"""{STORED},
p AS (SELECT a, (row_number() OVER (ORDER BY a) - 1)::INT AS angle FROM (SELECT DISTINCT a FROM k WHERE a % 5 NOT IN (2, 4))),
d AS (SELECT det_y, round(avg(line[1]::DOUBLE), 6) AS dark FROM k WHERE a % 5 = 2 GROUP BY det_y),
f AS (SELECT det_y, round(avg(line[1]::DOUBLE), 6) AS flat FROM k WHERE a % 5 = 4 GROUP BY det_y)
SELECT angle, det_y, round(radians(0.25 * a + 1.0), 9) AS theta, round(line[1]::DOUBLE, 6) AS v, dark, flat
FROM k JOIN p USING (a) JOIN d USING (det_y) JOIN f USING (det_y)""")
def stored_angles_interleaved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_from(stored(spark, sf_dir), "line", "image_key", "rotation_angle")
    scan = declared_scan(lines, {"data_path": "line"}, StoredAngles("rotation_angle"), "image_key")
    rows = scan.lines.select("angle", "det_y", F.round(F.col("line")[0].cast("double"), 6).alias("v"))
    angles = scan.angles.withColumn("theta", F.round("theta", 9))
    return rows.join(angles, "angle").join(first_mean(scan.darks, "dark"), "det_y").join(first_mean(scan.flats, "flat"), "det_y")


@query(f"""{STORED},
p AS (SELECT a, (row_number() OVER (ORDER BY a) - 1)::INT AS angle FROM (SELECT DISTINCT a FROM k WHERE a % 5 NOT IN (2, 4) AND a >= 3)),
d AS (SELECT det_y, round(avg(line[3]::DOUBLE), 6) AS dark FROM k WHERE a % 3 = 0 GROUP BY det_y)
SELECT angle, det_y, round(radians(0.25 * a + 1.0), 9) AS theta, round(line[3]::DOUBLE, 6) AS v, dark, 1.0::DOUBLE AS flat
FROM k JOIN p USING (a) JOIN d USING (det_y) WHERE det_y >= 1""")
def calibration_of_other_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(spark, sf_dir)
    given = {
        "data_path": "line",
        "darks": {"file": "darks", "data_path": "line"},
        "flats": "ignore",
        "preview": {"angles": {"start": 3}, "detector_y": {"start": 1}, "detector_x": {"start": 2}},
    }
    others = {Frames("darks", "line"): lines_from(table.where(F.col("angle") % 3 == 0), "line")}
    lines = lines_from(table, "line", "image_key", "rotation_angle")
    scan = declared_scan(lines, given, StoredAngles("rotation_angle"), "image_key", others)
    rows = scan.lines.select("angle", "det_y", F.round(F.col("line")[0].cast("double"), 6).alias("v"))
    flats = first_mean(scan.flats.withColumn("det_y", F.col("det_y") + scan.origin[1]), "flat")
    angles = scan.angles.withColumn("theta", F.round("theta", 9))
    return rows.join(angles, "angle").join(first_mean(scan.darks, "dark"), "det_y").join(flats, "det_y")
