"""Queries over the cube as an HDF5 volume - written by tasks, one index, read by chunks - and as a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoflow.queries.cube import STORED, cube, first_mean, projection_lines, query, rounded, scratch, stored
from tomoflow.operators import frames
from tomoflow.sources import declared
from tomoflow.sources.scan import ENTRY_PATHS, voxels
from tomoflow.sources.volumes import read_volume, save_volume
from tomoflow.streaming.sinograms import arrived, completed_sinograms


@query(" SELECT angle, det_y, det_x, v FROM vox")
def hdf5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projections as a chunked, deflated volume, and back."""
    table, lines = projection_lines(spark, sf_dir)
    n = lines.agg(F.max("angle")).first()[0] + 1
    path = f"{scratch(spark, 'volume')}.h5"
    save_volume(lines, (n, *table.shape[1:]), path, chunk=(8, 4, table.shape[2]), level=4)
    return voxels(read_volume(spark, path, "/data"))


@query(f"""{STORED},
p AS (SELECT a, (row_number() OVER (ORDER BY a) - 1)::INT AS angle FROM (SELECT DISTINCT a FROM k WHERE a % 5 NOT IN (2, 4) AND a >= 6 AND a < 37)),
d AS (SELECT det_y, round(avg(line[5]::DOUBLE), 6) AS dark FROM k WHERE a % 5 = 2 GROUP BY det_y),
f AS (SELECT det_y, round(avg(line[5]::DOUBLE), 6) AS flat FROM k WHERE a % 5 = 4 GROUP BY det_y)
SELECT angle, det_y, round(radians(0.25 * a + 1.0), 9) AS theta, round(line[5]::DOUBLE, 6) AS v, dark, flat
FROM k JOIN p USING (a) JOIN d USING (det_y) JOIN f USING (det_y) WHERE det_y >= 2 AND det_y < 7""")
def hdf5_declared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan file with keys and angles, opened by a loader that leaves all paths to ``auto``, with a preview."""
    shape = cube(spark, sf_dir).shape
    lines = stored(spark, sf_dir).withColumnRenamed("rotation_angle", "degrees")
    path = f"{scratch(spark, 'scan')}.nxs"
    places = {name: f"/entry/{below}" for name, below in ENTRY_PATHS.items()}
    save_volume(
        lines, shape, path, places["data_path"], level=1, angles_path=places["rotation_angles"], image_key_path=places["image_key_path"], texts={"/entry/definition": "NXtomo"}
    )
    given = {"data_path": "auto", "image_key_path": "auto", "rotation_angles": "auto"}
    preview = {"angles": {"start": 6, "stop": 37}, "detector_y": {"start": 2, "stop": 7}, "detector_x": {"start": 4}}
    scan = declared.load(spark, path, given | {"preview": preview})
    rows = scan.lines.select("angle", "det_y", F.round(F.col("line")[0].cast("double"), 6).alias("v"))
    angles = rounded(scan.angles, "theta", digits=9)
    return rows.join(angles, "angle").join(first_mean(scan.darks, "dark"), "det_y").join(first_mean(scan.flats, "flat"), "det_y")


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY det_y, det_x ORDER BY v, angle) AS place FROM vox),
n AS (SELECT *, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS b FROM r WINDOW w AS (PARTITION BY det_y, place ORDER BY det_x))
SELECT angle, det_y, det_x, greatest(least(a, v), least(greatest(a, v), b)) AS v FROM n""")
def streaming_sinograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripes removed from sinograms as they complete, while lines arrive file by file in no order."""
    _, lines = projection_lines(spark, sf_dir)
    n = lines.agg(F.max("angle")).first()[0] + 1
    folder = scratch(spark, "arriving")
    lines.repartition(3, F.xxhash64("angle", "det_y")).write.parquet(folder)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    done = completed_sinograms(stream, n, frames.sort_stripes)
    return voxels(arrived(done, scratch(spark, "sinograms"), scratch(spark, "sinograms-state")))
