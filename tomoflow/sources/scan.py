"""A scan as DataFrames of detector lines.

    lines    angle int, det_y int, line array<float>          -- det_x is the place in the array
    angles   angle int, theta double                          -- radians
    darks    det_y int, line array<double>                    -- one line a row and frame
    flats

A projection is all lines of an angle, a sinogram all lines of a detector row, so that
changing from one to the other changes the key of the next exchange and nothing else.
Previews are predicates on ``angle`` and ``det_y`` and a slice of the line.  Where the
stored key is one number for both, ranges are given on the stored column, so that they
reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomoflow.functions.columns import linspace
from tomoflow.plans.model import Preview
from tomoflow.plans.preview import Frames, UserAngles, calibration_plan
from tomoflow.sources.hdf5 import Hdf5File
from tomoflow.sources.volumes import Volume

#: Image keys of the frames of a scan. Fixed values.
PROJECTION, FLAT, DARK = 0, 1, 2


@dataclass(frozen=True)
class Scan:
    lines: DataFrame
    angles: DataFrame
    darks: DataFrame
    flats: DataFrame
    shape: tuple[int, int, int]
    side_outputs: dict[str, Any] = field(default_factory=dict)
    #: where the preview begins on the detector: column, row
    origin: tuple[int, int] = (0, 0)

    def with_lines(self, lines: DataFrame, shape: tuple[int, int, int] | None = None) -> Scan:
        return replace(self, lines=lines, shape=shape or self.shape)

    def publish(self, **values) -> Scan:
        return replace(self, side_outputs=self.side_outputs | values)


def voxels(lines: DataFrame, *keep: str) -> DataFrame:
    """One row per pixel: angle, det_y, det_x, v."""
    return lines.select("angle", "det_y", *keep, F.posexplode("line").alias("det_x", "v")).withColumn("v", F.col("v").cast("double"))


def lines_of(pixels: DataFrame) -> DataFrame:
    """Back from pixels to lines."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("det_x", "v"))), lambda p: p["v"])
    return pixels.groupBy("angle", "det_y").agg(line.alias("line"))


def crop(lines: DataFrame, preview: Preview) -> DataFrame:
    """Rows and columns of the preview; indices stay those of the whole scan."""
    a, y, x = preview.angles, preview.detector_y, preview.detector_x
    return lines.where(F.col("angle").between(a.start, a.stop - 1) & F.col("det_y").between(y.start, y.stop - 1)).withColumn(
        "line", F.slice("line", x.start + 1, len(x))
    )


def renumbered(lines: DataFrame) -> DataFrame:
    """Angles numbered from 0 in their order, gaps closed (a table of angles is broadcast by size)."""
    order = lines.select("angle").distinct().withColumn("place", (F.row_number().over(Window.orderBy("angle")) - 1).cast("int"))
    return lines.join(order, "angle").withColumn("angle", F.col("place")).drop("place")


def dummy_frames(spark: SparkSession, value: float, rows: int, width: int) -> DataFrame:
    """One calibration frame of a constant."""
    return spark.range(rows).select(F.col("id").cast("int").alias("det_y"), F.array_repeat(F.lit(float(value)), width).alias("line"))


def user_angles(spark: SparkSession, given: UserAngles) -> DataFrame:
    """Evenly spaced angles, in radians."""
    values = spark.range(1).select(F.posexplode(linspace(given.start, given.stop, given.n)).alias("angle", "degrees"))
    return values.select("angle", F.radians("degrees").alias("theta"))


def lines_of_key(lines: DataFrame | Volume, key: int, preview: Preview, angles: bool = True) -> DataFrame:
    """The lines of one image key; of a volume only those of the preview, by what is read of the file."""
    if isinstance(lines, Volume):
        return lines.lines(key, preview.angles if angles else None, preview.detector_y)
    return lines.where(F.col("image_key") == key)


def frames_of(lines: DataFrame | Volume, key: int, preview: Preview) -> DataFrame:
    """Calibration frames: cropped in rows and columns, never in angles."""
    y, x = preview.detector_y, preview.detector_x
    chosen = lines_of_key(lines, key, preview, angles=False).where(F.col("det_y").between(y.start, y.stop - 1))
    return chosen.select("det_y", F.slice("line", x.start + 1, len(x)).cast("array<double>").alias("line"))


def open_scan(
    lines: DataFrame | Volume,
    shape: tuple[int, int, int],
    preview: Preview,
    angles: DataFrame | UserAngles | None = None,
    darks: Frames | None = None,
    flats: Frames | None = None,
    others: dict[str | Frames, DataFrame | Volume] | None = None,
) -> Scan:
    """The scan of a preview.  ``lines`` has an ``image_key``; frames other than projections never are data.

    ``darks`` and ``flats`` say where calibration frames lie (``file`` "" is the scan
    itself, the lines of others are found in ``others``, by file or by place); None ignores them.
    """
    spark, others = lines.spark if isinstance(lines, Volume) else lines.sparkSession, others or {}
    data = crop(lines_of_key(lines, PROJECTION, preview), preview).select("angle", "det_y", "line")
    rows = preview.shape[1:]
    if isinstance(angles, UserAngles):
        angle_table = user_angles(spark, angles)
    elif angles is not None:
        angle_table = angles.select("angle", F.radians("degrees").alias("theta"))
    else:
        angle_table = user_angles(spark, UserAngles(0.0, 180.0, shape[0]))

    def read(where: Frames | None, how: str, key: int, value: float) -> DataFrame:
        if how == "dummy" or where is None:
            return dummy_frames(spark, value, *rows)
        table = (others[where] if where in others else others[where.file]) if where.file else lines
        if where.file and where.image_key is None and how == "separate":
            table = (table.lines() if isinstance(table, Volume) else table).withColumn("image_key", F.lit(key))
        return frames_of(table, key, preview)

    plan = calibration_plan(darks, flats)
    origin = (preview.detector_x.start, preview.detector_y.start)
    return Scan(data, angle_table, read(darks, plan[0], DARK, 0.0), read(flats, plan[1], FLAT, 1.0), preview.shape, origin=origin)


class CubeTable:
    """Lines kept as (key, array) rows, with key = angle * rows + det_y."""

    def __init__(self, table: DataFrame, key: str, line: str, rows: int):
        self.table, self.key, self.line, self.rows = table, key, line, rows
        last = table.agg(F.max(key)).first()[0]
        self.shape = (last // rows + 1, rows, table.select(F.size(line)).first()[0]) if last is not None else (0, rows, 0)

    def lines(self, preview: Preview | None = None, image_key: Column | None = None) -> DataFrame:
        """angle, det_y, image_key, line.  A preview's angles are a range of the stored key."""
        table = self.table
        if preview is not None:
            a = preview.angles
            table = table.where(F.col(self.key).between(a.start * self.rows, a.stop * self.rows - 1))
        a = F.expr(f"{self.key} div {self.rows}").cast("int")
        key = image_key if image_key is not None else self.default_image_key(a)
        return table.select(a.alias("angle"), (F.col(self.key) % self.rows).cast("int").alias("det_y"), key.alias("image_key"), F.col(self.line).alias("line"))

    def default_image_key(self, angle: Column) -> Column:
        """What frames are where the table doesn't say: projections."""
        return F.lit(PROJECTION)

    def angle_table(self) -> DataFrame:
        n = self.shape[0]
        return user_angles(self.table.sparkSession, UserAngles(0.0, 180.0, n))


def hdf5_members(path: str) -> dict[str, Any]:
    """Names of an HDF5 file: groups are mappings, data sets None."""
    return Hdf5File(path).members()


def hdf5_columns(members: dict[str, Any], prefix: str = "") -> list[str]:
    """The paths of all data sets, with and without the leading slash."""
    out: list[str] = []
    for name, below in members.items():
        path = f"{prefix}/{name}"
        out += hdf5_columns(below, path) if isinstance(below, dict) else [path, path[1:]]
    return out


#: Where a scan's parts lie below its entry. Fixed values.
ENTRY_PATHS = {"data_path": "data/data", "rotation_angles": "data/rotation_angle", "image_key_path": "instrument/detector/image_key"}


def entry_paths(members: dict[str, Any]) -> dict[str, str]:
    """The paths that ``auto`` stands for."""
    entry = nexus_paths(members)
    if entry is None:
        raise ValueError("the input has no group with a definition, so 'auto' finds nothing")
    return {name: f"{entry}/{below}" for name, below in ENTRY_PATHS.items()}


def nexus_paths(members: dict[str, Any]) -> str | None:
    """The first group that has a data set called ``definition``; of groups within one another the outermost."""
    marked = [path.removesuffix("/definition") for path in hdf5_columns(members) if path.startswith("/") and path.endswith("/definition")]
    around = [path for path in marked if f"{marked[0]}/".startswith(f"{path}/")]
    return min(around, key=len, default=None)
