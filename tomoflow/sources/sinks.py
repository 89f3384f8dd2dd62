"""Where results go: tables, images, nothing."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoflow.operators.percentiles import stretched
from tomoflow.sources.images import WRITERS
from tomoflow.sources.scan import Scan, voxels
from tomoflow.sources.volumes import chunk_for, save_volume


def result_name(task: str, package: str, method: str, algorithm: str | None = None) -> str:
    return "-".join([task, package, method, *([algorithm] if algorithm else [])])


def save_scan(scan: Scan, path: str, files: int | None = None) -> None:
    """Lines, angles and extents as tables under ``path``; lines are dealt by angle."""
    lines = scan.lines.repartition(*([files] if files else []), "angle").sortWithinPartitions("angle", "det_y")
    lines.write.mode("overwrite").parquet(f"{path}/lines")
    scan.angles.write.mode("overwrite").parquet(f"{path}/angles")
    spark = scan.lines.sparkSession
    spark.createDataFrame([scan.shape], "n_angles int, detector_y int, detector_x int").write.mode("overwrite").parquet(f"{path}/shape")


def save_hdf5(scan: Scan, path: str, pattern: str = "projection", frames_per_chunk: int = 0, level: int = 0) -> None:
    """The volume ``/data`` with its ``/angles`` (degrees) and the place of its preview on the detector, in one file.

    A chunk holds ``frames_per_chunk`` whole frames of the pattern, or about 4 MB.  Results with
    other frames than the scan has angles, such as slices, have no angles.
    """
    n, rows, width = scan.shape
    chunk = chunk_for(scan.shape, pattern)
    if frames_per_chunk:
        chunk = (n, frames_per_chunk, width) if pattern == "sinogram" else (frames_per_chunk, rows, width)
    lines, own = scan.lines, scan.angles.where(F.col("angle") < n) if scan.angles is not None else None
    more: dict = {"numbers": {"/data_dims/detector_x_y": list(scan.origin)}}
    if own is not None and own.count() == n:
        lines = lines.join(own.select("angle", F.degrees("theta").alias("degrees")), "angle", "left")
        more["angles_path"] = "/angles"
    save_volume(lines, scan.shape, path, "/data", chunk, level, **more)


def load_scan(spark: SparkSession, path: str, darks: DataFrame, flats: DataFrame) -> Scan:
    shape = tuple(spark.read.parquet(f"{path}/shape").first())
    return Scan(spark.read.parquet(f"{path}/lines"), spark.read.parquet(f"{path}/angles"), darks, flats, shape)


def discard(df: DataFrame) -> None:
    """Run everything, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def images(lines: DataFrame, axis: int, bits: int = 8, file_format: str = "pgm", low: float | None = None, high: float | None = None, offset: int = 0, quality: int = 95) -> DataFrame:
    """name, content: one encoded image a frame (axis 0: projections, 1: sinograms)."""
    if file_format not in WRITERS:
        raise ValueError(f"images are written as {', '.join(WRITERS)}, not {file_format!r}")
    own, other = ("det_y", "angle") if axis == 1 else ("angle", "det_y")
    limits = None
    if low is None or high is None:
        limits = lines.select(F.min(F.array_min("line")).alias("low"), F.max(F.array_max("line")).alias("high"))
        lines = lines.crossJoin(F.broadcast(limits))
    else:
        lines = lines.withColumns({"low": F.lit(float(low)), "high": F.lit(float(high))})

    def encode(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(other)
        frame = np.stack(group["line"].to_numpy()).astype(float)
        lo, hi = float(group["low"].iloc[0]), float(group["high"].iloc[0])
        span = (np.clip(frame, lo, hi) - lo) / (hi - lo) if hi > lo else np.zeros(frame.shape)
        content = WRITERS[file_format](np.floor(span * ((1 << bits) - 1)), bits, quality)
        return pd.DataFrame({"name": [f"{int(key[0]) + offset:05d}.{file_format}"], "content": [content]})

    return lines.groupBy(own).applyInPandas(encode, "name string, content binary")


def save_images(lines: DataFrame, path: str, **options) -> None:
    """The images as a table of names and contents (any store Spark writes to holds it)."""
    images(lines, **options).write.mode("overwrite").parquet(path)


def snapshot(lines: DataFrame, shape: tuple[int, int, int], pattern: str) -> DataFrame:
    """The middle frame, clipped to its 1st and 99th percentile, as bytes."""
    key, n = ("det_y", shape[1]) if pattern == "sinogram" else ("angle", shape[0])
    return voxels(stretched(lines.where(F.col(key) == n // 2), key)).withColumn("v", F.col("v").cast("int"))


def pipeline_copy(text: str, version: str) -> str:
    """The pipeline as it was run, with a header."""
    return f"# tomoflow {version}\n{text}"


def describe(scan: Scan) -> str:
    return json.dumps({"shape": scan.shape, "side_outputs": {k: str(v) for k, v in scan.side_outputs.items()}})
