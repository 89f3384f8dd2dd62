"""Aggregations: partial in every task, then one exchange of the partial results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomoflow.functions.columns import finite_or_zero, is_finite


def calibration_mean(frames: DataFrame) -> DataFrame:
    """Mean of each detector pixel over the frames: det_y, det_x, v."""
    pixels = frames.select("det_y", F.posexplode("line").alias("det_x", "v"))
    return pixels.groupBy("det_y", "det_x").agg(F.avg(F.col("v").cast("double")).alias("v"))


def global_stats(pixels: DataFrame, *keys: str) -> DataFrame:
    """min, max, mean and n, over all values or by keys; NaN and infinities count as 0."""
    v = finite_or_zero(F.col("v"))
    return pixels.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count(v).alias("n"))


def bad_values(pixels: DataFrame, *keys: str) -> DataFrame:
    """How many values aren't finite, and how many are 0."""
    return pixels.groupBy(*keys).agg(
        F.count_if(~is_finite(F.col("v"))).alias("not_finite"), F.count_if(F.col("v") == 0).alias("zeros"), F.count(F.lit(1)).alias("n")
    )


def averaged_frames(pixels: DataFrame, factor: int) -> DataFrame:
    """Means of ``factor`` consecutive angles; the remainder is a group of its own."""
    group = F.floor(F.col("angle") / factor).cast("int")
    return pixels.groupBy(group.alias("angle"), "det_y", "det_x").agg(F.avg("v").alias("v"))


def averaged_angles(angles: DataFrame, factor: int) -> DataFrame:
    group = F.floor(F.col("angle") / factor).cast("int")
    return angles.groupBy(group.alias("angle")).agg(F.avg("theta").alias("theta"))


def averaged_rows(pixels: DataFrame, row: int, reach: int, rows: int) -> DataFrame:
    """One sinogram: the mean of the rows around ``row``."""
    if not 2 * reach < rows:
        raise ValueError(f"averaging {2 * reach + 1} rows needs more than {2 * reach} detector rows, not {rows}")
    near = pixels.where(F.col("det_y").between(row - reach, row + reach))
    return near.groupBy("angle", "det_x").agg(F.avg("v").alias("v"))


def first_and_last(pixels: DataFrame) -> DataFrame:
    """Each pixel's value at the first and the last angle."""
    return pixels.groupBy("det_y", "det_x").agg(F.min_by("v", "angle").alias("first_v"), F.max_by("v", "angle").alias("last_v"))


def binned(pixels: DataFrame, factor: int) -> DataFrame:
    """The detector resampled to means of factor x factor pixels."""
    y, x = (F.floor(F.col(c) / factor).cast("int") for c in ("det_y", "det_x"))
    return pixels.groupBy("angle", y.alias("det_y"), x.alias("det_x")).agg(F.avg("v").alias("v"))


def extents(parts: DataFrame, part: str, length: str) -> DataFrame:
    """Where each part begins, and the length of all: a running sum over the parts."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(part, length, F.coalesce(F.sum(length).over(before), F.lit(0)).alias("start"), F.sum(length).over(Window.partitionBy(F.lit(1))).alias("total"))
