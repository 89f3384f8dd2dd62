"""Operators on single values.

Those named ``..._lines`` work on the arrays of a line where it lies: no row per pixel, and
no exchange of the data.  The others take pixels that a query has in rows anyway.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoflow.functions.columns import finite_or_zero, safe_ratio
from tomoflow.operators.aggregate import calibration_mean, global_stats
from tomoflow.sources.scan import voxels


def clean(pixels: DataFrame) -> DataFrame:
    """NaN and infinities become 0."""
    return pixels.withColumn("v", finite_or_zero(F.col("v")))


def corrected(pixels: DataFrame, darks: DataFrame, flats: DataFrame, cutoff: float = 10.0, minus_log: bool = False, nonnegative: bool = False) -> DataFrame:
    """(v - dark) / (flat - dark), clipped to +-cutoff, with the frames' means.

    The means are one row a detector pixel, averaged before they are joined, and go to
    the tasks as a broadcast while they stay below Spark's threshold.
    """
    dark = calibration_mean(darks).select("det_y", "det_x", F.col("v").alias("dark"))
    flat = calibration_mean(flats).select("det_y", "det_x", F.col("v").alias("flat"))
    both = dark.join(flat, ["det_y", "det_x"])
    ratio = safe_ratio(F.col("v") - F.col("dark"), F.col("flat") - F.col("dark"))
    value = F.least(F.greatest(ratio, F.lit(-cutoff)), F.lit(cutoff))
    if minus_log:
        value = -F.log(F.greatest(value, F.lit(1e-6)))
    if nonnegative:
        value = F.greatest(value, F.lit(0.0))
    return pixels.join(both, ["det_y", "det_x"]).select("angle", "det_y", "det_x", value.alias("v"))


def minus_log(pixels: DataFrame, floor: float = 1e-6) -> DataFrame:
    return pixels.withColumn("v", -F.log(F.greatest(F.col("v"), F.lit(floor))))


def rescaled(pixels: DataFrame, bits: int = 8, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values between low and high (else the global ones) as whole numbers of ``bits`` bits."""
    top = (1 << bits) - 1
    stats = global_stats(pixels).select(F.col("min").alias("lo"), F.col("max").alias("hi"))
    rows = pixels.crossJoin(F.broadcast(stats)) if low is None or high is None else pixels.withColumns({"lo": F.lit(low), "hi": F.lit(high)})
    share = (F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi")) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.floor(top * share)).otherwise(0).cast("int")
    return rows.select("angle", "det_y", "det_x", scaled.alias("v"))


def line_pixels(lines: DataFrame) -> DataFrame:
    return voxels(lines)


#: Calibration lines of up to so many bytes (two frames of the detector) are broadcast.
BROADCAST_BYTES = 256 << 20


def each_value(lines: DataFrame, value: Callable[[Column], Column]) -> DataFrame:
    return lines.withColumn("line", F.transform(F.col("line").cast("array<double>"), value))


def clean_lines(lines: DataFrame) -> DataFrame:
    return each_value(lines, finite_or_zero)


def minus_log_lines(lines: DataFrame, floor: float = 1e-6) -> DataFrame:
    return each_value(lines, lambda v: -F.log(F.greatest(v, F.lit(floor))))


def mean_lines(frames: DataFrame, averaging: str = "mean") -> DataFrame:
    """The mean, or median, calibration frame: det_y, line."""
    pixels = frames.select("det_y", F.posexplode("line").alias("det_x", "v"))
    if averaging not in ("mean", "median"):
        raise ValueError(f"frames are averaged by mean or median, not {averaging!r}")
    v = F.col("v").cast("double")
    middle = (F.avg(v) if averaging == "mean" else F.median(v)).alias("v")
    values = pixels.groupBy("det_y", "det_x").agg(middle)
    return values.groupBy("det_y").agg(F.transform(F.array_sort(F.collect_list(F.struct("det_x", "v"))), lambda p: p["v"]).alias("line"))


def corrected_lines(
    lines: DataFrame,
    darks: DataFrame,
    flats: DataFrame,
    cutoff: float = 10.0,
    minus_log: bool = False,
    nonnegative: bool = False,
    averaging: str = "mean",
    frame_pixels: int | None = None,
) -> DataFrame:
    """As ``corrected``, line by line.

    The frames' means are one row a detector row.  With ``frame_pixels``, the pixels of a
    frame, they are broadcast if two frames take no more than ``BROADCAST_BYTES``; else Spark
    joins them by detector row.
    """
    both = mean_lines(darks, averaging).withColumnRenamed("line", "dark").join(mean_lines(flats, averaging).withColumnRenamed("line", "flat"), "det_y")
    if frame_pixels is not None and 16 * frame_pixels <= BROADCAST_BYTES:
        both = F.broadcast(both)

    def value(p: Column) -> Column:
        ratio = safe_ratio(p["line"] - p["dark"], p["flat"] - p["dark"])
        out = F.least(F.greatest(ratio, F.lit(-cutoff)), F.lit(cutoff))
        if minus_log:
            out = -F.log(F.greatest(out, F.lit(1e-6)))
        return F.greatest(out, F.lit(0.0)) if nonnegative else out

    met = lines.withColumn("line", F.col("line").cast("array<double>")).join(both, "det_y")
    return met.withColumn("line", F.transform(F.arrays_zip("line", "dark", "flat"), value)).select(*lines.columns)


def line_stats(lines: DataFrame) -> DataFrame:
    """min, max, mean and n of all values, NaN and infinities as 0: partial results line by line."""
    clean = F.transform(F.col("line").cast("array<double>"), finite_or_zero)
    parts = lines.select(clean.alias("line")).select(
        F.array_min("line").alias("low"), F.array_max("line").alias("high"), F.aggregate("line", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("line").alias("n")
    )
    return parts.agg(F.min("low").alias("min"), F.max("high").alias("max"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def rescaled_lines(lines: DataFrame, bits: int = 8, low: float | None = None, high: float | None = None) -> DataFrame:
    """As ``rescaled``, line by line; without limits one aggregation finds them, one row that is broadcast."""
    top = (1 << bits) - 1
    if low is None or high is None:
        rows = lines.crossJoin(F.broadcast(line_stats(lines).select(F.col("min").alias("lo"), F.col("max").alias("hi"))))
    else:
        rows = lines.withColumns({"lo": F.lit(low), "hi": F.lit(high)})
    lo, hi = F.col("lo"), F.col("hi")

    def value(v: Column) -> Column:
        share = (F.least(F.greatest(v, lo), hi) - lo) / (hi - lo)
        return F.when(hi > lo, F.floor(top * share)).otherwise(0).cast("int")

    return each_value(rows, value).select(*lines.columns)
