"""Scans as a pipeline's loader step declares them.

The step names where lines, image keys and rotation angles lie: columns of a table of
detector lines, or paths of an HDF5 file.  What it names has to be there; nothing is made
up in its place.

    data_path           column of the lines; "auto": line
    image_key_path      column of the image keys (0 projection, 1 flat, 2 dark), if any;
                        "auto": image_key.  Without it every line is a projection's
    rotation_angles     {data_path: column of degrees}, {user_defined: ...}, or "auto":
                        column rotation_angle
    darks, flats        {file, data_path, image_key_path} of another table, or "ignore"
    key                 for tables with one key, angle * rows + det_y

Projections are numbered from 0 in the order of their angles, wherever calibration frames
lie between them, and have the stored angle of their own place.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as WindowSpec
from pyspark.sql import functions as F

from tomoflow.plans.model import Preview
from tomoflow.plans.preview import (
    Frames,
    StoredAngles,
    UserAngles,
    calibration_plan,
    continuous_subset,
    parse_angles,
    parse_frames,
    parse_preview,
    sweep_preview,
)
from tomoflow.sources.scan import DARK, FLAT, PROJECTION, Scan, entry_paths, hdf5_columns, hdf5_members, open_scan
from tomoflow.sources.volumes import Volume

#: Columns that "auto" stands for in a table of lines.
AUTO = {"data_path": "line", "image_key_path": "image_key", "rotation_angles": "rotation_angle"}
HDF5_ENDINGS = (".nxs", ".h5", ".hdf", ".hdf5")


def is_hdf5(path: str) -> bool:
    return path.lower().endswith(HDF5_ENDINGS)


def declared_paths(given: dict[str, Any], auto: dict[str, str]) -> tuple[str, str | None, UserAngles | StoredAngles]:
    """data_path, image_key_path and angles, with "auto" replaced."""

    def path(name: str, value):
        return auto[name] if value == "auto" else value

    if given.get("data_path") is None:
        raise ValueError("the loader needs data_path")
    asked = given.get("rotation_angles") or {}
    angles = StoredAngles(auto["rotation_angles"]) if asked == "auto" else parse_angles(asked)
    return path("data_path", given["data_path"]), path("image_key_path", given.get("image_key_path")), angles


def lines_from(table: DataFrame, line: str, image_key: str | None = None, degrees: str | None = None, key: str | None = None, rows: int = 0) -> DataFrame:
    """angle, det_y, image_key, line, degrees: the declared columns of a table of lines."""
    wanted = [c for c in (*((key,) if key else ("angle", "det_y")), line, image_key, degrees) if c is not None]
    absent = [c for c in wanted if c not in table.columns]
    if absent:
        raise ValueError(f"the input has no {', '.join(absent)}; it has {', '.join(table.columns)}")

    def own(name: str) -> Column:
        return F.col(f"`{name}`")

    angle, det_y = (F.floor(own(key) / rows), own(key) % rows) if key else (own("angle"), own("det_y"))
    return table.select(
        angle.cast("int").alias("angle"),
        det_y.cast("int").alias("det_y"),
        (own(image_key).cast("int") if image_key else F.lit(PROJECTION)).alias("image_key"),
        own(line).alias("line"),
        (own(degrees).cast("double") if degrees else F.lit(None).cast("double")).alias("degrees"),
    )


def open_lines(spark: SparkSession, path: str, line: str, image_key: str | None, degrees: str | None, key: str | None = None, rows: int = 0) -> DataFrame | Volume:
    if is_hdf5(path):
        return Volume(spark, path, line, image_key, degrees)
    return lines_from(spark.read.parquet(path), line, image_key, degrees, key, rows)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """What a loader's paths may name."""
    return hdf5_columns(hdf5_members(path)) if is_hdf5(path) else spark.read.parquet(path).columns


def contents(spark: SparkSession, path: str) -> list[str]:
    """What paths of a loader may name in a file, with "auto" where that finds something."""
    held = columns_of(spark, path)
    try:
        auto = entry_paths(hdf5_members(path)) if is_hdf5(path) else AUTO
    except ValueError:
        auto = {}
    return [*held, *(["auto"] if set(auto.values()) & set(held) else [])]


def calibration_lines(spark: SparkSession, frames: Frames | None) -> dict[Frames, DataFrame | Volume]:
    """The lines of frames that lie in another file."""
    if frames is None or not frames.file:
        return {}
    return {frames: open_lines(spark, frames.file, frames.path, frames.image_key, None)}


def extent(lines: DataFrame | Volume) -> tuple[tuple[int, int, int], bool, bool]:
    """Shape, and whether there are darks and flats; line arrays are read of one row only, of a volume none."""
    if isinstance(lines, Volume):
        keys = {key for _, key, _ in lines.frames()}
        return lines.shape, DARK in keys, FLAT in keys
    key = F.col("image_key")
    row = lines.agg(F.max("angle"), F.max("det_y"), F.count_if(key == DARK), F.count_if(key == FLAT)).first()
    if row[0] is None:
        raise ValueError("the input has no lines")
    width = lines.select(F.size("line")).first()[0]
    return (row[0] + 1, row[1] + 1, width), row[2] > 0, row[3] > 0


def projection_angles(scan: Scan, lines: DataFrame | Volume, preview: Preview) -> DataFrame:
    """angle, degrees of the projections of a scan, one row each."""
    if isinstance(lines, Volume):
        a = preview.angles
        rows = [(i, degrees) for i, key, degrees in lines.frames() if key == PROJECTION and a.start <= i < a.stop]
        return lines.spark.createDataFrame(rows, "angle int, degrees double")
    own = lines.where(F.col("image_key") == PROJECTION).groupBy("angle").agg(F.min("degrees").alias("degrees"))
    return scan.lines.select("angle").distinct().join(own, "angle")


def numbered(scan: Scan, lines: DataFrame | Volume, angles: UserAngles | StoredAngles, preview: Preview) -> Scan:
    """The scan with its projections numbered from 0 without gaps, and their angles.

    The table of places has one row an angle, which is what Spark may broadcast.
    """
    kept = projection_angles(scan, lines, preview)
    if isinstance(angles, StoredAngles) and kept.where("degrees IS NULL OR isnan(degrees)").limit(1).count():
        raise ValueError("projections without a stored angle")
    places = kept.withColumn("place", (F.row_number().over(WindowSpec.orderBy("angle")) - 1).cast("int"))
    n = places.count()
    if isinstance(angles, StoredAngles):
        scan = replace(scan, angles=places.select(F.col("place").alias("angle"), F.radians("degrees").alias("theta")))
    moved = scan.lines.join(places.select("angle", "place"), "angle").select(F.col("place").alias("angle"), "det_y", "line")
    return scan.with_lines(moved, (n, *scan.shape[1:]))


def declared_scan(
    lines: DataFrame | Volume,
    given: dict[str, Any],
    angles: UserAngles | StoredAngles,
    image_key: str | None = None,
    others: dict[Frames, DataFrame | Volume] | None = None,
    subset: dict[str, int | None] | None = None,
    sweep: bool = False,
) -> Scan:
    """The scan of a loader's parameters over its ``lines`` (see ``lines_from``).

    ``subset`` replaces the range of angles; its bounds may be None.
    """
    shape, with_darks, with_flats = extent(lines)
    preview = parse_preview(given.get("preview"), shape)
    subset = subset or given.get("continuous_scan_subset")
    if subset is not None:
        stop = subset["stop"]
        preview = continuous_subset(preview, {"start": subset["start"] or 0, "stop": shape[0] if stop is None else stop})
    if sweep:
        preview = sweep_preview(preview, shape[1])
    here = Frames("", given["data_path"], image_key)
    darks, flats = (parse_frames(given.get(name), here) for name in ("darks", "flats"))
    for name, frames in (("darks", darks), ("flats", flats)):
        if frames is not None and not frames.file and image_key is None:
            raise ValueError(f"without image_key_path, {name} need a file of their own, or 'ignore'")
    if calibration_plan(darks, flats)[0] == "together":
        if darks.file and darks.image_key is None:
            raise ValueError("darks and flats in one file need image_key_path")
        if not darks.file:  # a kind that the scan lacks is made up: 0 or 1 everywhere
            darks, flats = darks if with_darks else None, flats if with_flats else None
    scan = open_scan(lines, shape, preview, angles if isinstance(angles, UserAngles) else None, darks, flats, others)
    return numbered(scan, lines, angles, preview)


def load(spark: SparkSession, path: str, given: dict[str, Any], rows: int = 0, subset: dict[str, int | None] | None = None, sweep: bool = False) -> Scan:
    """The scan that a loader step declares over the file or table at ``path``."""
    asks = "auto" in [v for v in map(given.get, AUTO) if isinstance(v, str)]
    line, image_key, angles = declared_paths(given, entry_paths(hdf5_members(path)) if asks and is_hdf5(path) else AUTO)
    given = given | {"data_path": line}
    degrees = angles.path if isinstance(angles, StoredAngles) else None
    lines = open_lines(spark, path, line, image_key, degrees, given.get("key"), rows)
    here = Frames("", line, image_key)
    others: dict[Frames, DataFrame | Volume] = {}
    for name in ("darks", "flats"):
        others |= calibration_lines(spark, parse_frames(given.get(name), here))
    return declared_scan(lines, given, angles, image_key, others, subset, sweep)
