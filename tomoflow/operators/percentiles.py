"""Exact percentiles of frames without bringing a frame's values together.

Numbers are taken as whole numbers of their bits, in the same order.  A pass counts values by the
next ``BITS`` (16) of these, tasks first, among those that share the bits found so far; the counts tell
in which of the bins each wanted rank lies.  Single-precision lines take two passes, double-precision
ones four, whatever their values are.  What moves are counts: at most 65,536 a frame and wanted
rank, far fewer where values repeat.  All passes are one plan; nothing goes through the driver.

A percentile between two ranks is interpolated linearly.  NaN counts as the greatest value.  The sum
of the two weighted values is rounded as in Spark's ``percentile``; where ``fused``, its first product
is not rounded before, as in DuckDB's ``quantile_cont``.  Limits of a stretch are fused: a pixel at the
upper one is floor(255 * x / x), which is 254 or 255 by the last bit of x.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomoflow.functions.columns import stretch_to_byte

BITS = 16


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits in the order of the values; those of single precision use the low 32."""
    width = 8 * values.dtype.itemsize
    bits = values.view(f"u{values.dtype.itemsize}").astype(np.uint64)
    sign = np.uint64(1 << (width - 1))
    every = np.uint64((1 << width) - 1)
    return np.where(bits & sign, ~bits & every, bits | sign)


def restored(numbers: np.ndarray, width: int) -> np.ndarray:
    """The values of ordered numbers."""
    sign, every = np.uint64(1 << (width - 1)), np.uint64((1 << width) - 1)
    numbers = numbers.astype(np.uint64)
    bits = np.where(numbers & sign, numbers ^ sign, ~numbers & every)
    return bits.astype(f"u{width // 8}").view(f"f{width // 8}").astype(float)


def fused_between(place: float, low: float, high: float) -> float:
    """low * (1 - d) + high * d at d = place - floor(place), where only high * d and the sum are rounded."""
    d = place - math.floor(place)
    if d == 0:
        return low
    if not (math.isfinite(low) and math.isfinite(high)):
        return low * (1 - d) + high * d
    return float(Fraction(low) * Fraction(1 - d) + Fraction(high * d))


def counts_by_bits(rows: DataFrame, key: str, width: int, known: int) -> DataFrame:
    """key, bin, n: counts of values by their first ``known`` + BITS bits, of those whose first ``known`` bits are wanted.

    ``rows`` has key and line, and ``wanted`` (array of numbers) where bits are known.
    """
    kind = "<f4" if width == 32 else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines = batch.column(0).to_numpy(), batch.column(1)
            wanted = batch.column(2).to_pylist() if known else None
            found: dict[int, list[np.ndarray]] = {}
            for i, own in enumerate(keys.tolist()):
                values = lines[i].values.drop_null().to_numpy(zero_copy_only=False).astype(kind)
                bins = ordered(values) >> np.uint64(width - known - BITS)
                if known:
                    bins = bins[np.isin(bins >> np.uint64(BITS), np.array(wanted[i], np.int64).astype(np.uint64))]
                found.setdefault(own, []).append(bins)
            for own, parts in found.items():
                bins, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), own, np.int32)), pa.array(bins.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "bin", "n"])

    columns = [F.col(key).cast("int").alias("key"), "line", *(["wanted"] if known else [])]
    counted = rows.where("line IS NOT NULL").select(*columns).mapInArrow(run, "key int, bin long, n long")
    return counted.groupBy("key", "bin").agg(F.sum("n").alias("n"))


def percentiles(lines: DataFrame, key: str, shares: tuple[float, ...], fused: bool = False) -> DataFrame:
    """``key`` and p, the percentiles of all values of its lines."""
    single = lines.schema["line"].dataType.elementType.simpleString() == "float"
    width = 32 if single else 64
    by_key = Window.partitionBy("key").orderBy("bin")
    ranks = None
    for known in range(0, width, BITS):
        if ranks is None:
            counted = counts_by_bits(lines, key, width, 0)
            total = F.sum("n").over(Window.partitionBy("key"))
            places = F.array(*[F.struct(F.lit(i).alias("share"), (F.lit(float(s)) * (F.col("total") - 1)).alias("place")) for i, s in enumerate(shares)])
            runs = counted.withColumns({"after": F.sum("n").over(by_key), "total": total}).select("key", "bin", "n", "after", F.explode(places).alias("at"))
            runs = runs.select("key", "bin", "n", "after", "at.share", "at.place", F.explode(F.array(F.floor("at.place"), F.ceil("at.place"))).alias("rank"))
            inside = (F.col("rank") < F.col("after")) & (F.col("rank") >= F.col("after") - F.col("n"))
            ranks = runs.where(inside).select("key", "share", "place", "rank", "bin", (F.col("rank") - F.col("after") + F.col("n")).alias("rest"))
        else:
            wanted = ranks.groupBy("key").agg(F.collect_set("bin").alias("wanted"))
            near = lines.join(wanted.withColumnRenamed("key", "w_key"), F.col(key) == F.col("w_key")).select(key, "line", "wanted")
            counted = counts_by_bits(near, key, width, known).withColumn("first", F.shiftrightunsigned("bin", BITS))
            within = Window.partitionBy("key", "first").orderBy("bin")
            runs = counted.withColumn("after", F.sum("n").over(within)).select(F.col("key").alias("c_key"), "first", F.col("bin").alias("c_bin"), "n", "after")
            met = ranks.join(runs, (F.col("key") == F.col("c_key")) & (F.col("bin") == F.col("first")))
            inside = (F.col("rest") < F.col("after")) & (F.col("rest") >= F.col("after") - F.col("n"))
            ranks = met.where(inside).select("key", "share", "place", "rank", F.col("c_bin").alias("bin"), (F.col("rest") - F.col("after") + F.col("n")).alias("rest"))

    @F.pandas_udf("double")
    def value(bins: pd.Series) -> pd.Series:
        return pd.Series(restored(bins.to_numpy().astype(np.int64), width))

    @F.pandas_udf("double")
    def fused_value(places: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        return pd.Series([fused_between(*x) for x in zip(places.tolist(), lows.tolist(), highs.tolist(), strict=True)], dtype=float)

    rows = ranks.distinct().withColumn("v", value("bin"))
    ends = rows.groupBy("key", "share", "place").agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"))
    between = (F.ceil("place") - F.col("place")) * F.col("low") + (F.col("place") - F.floor("place")) * F.col("high")
    at = fused_value("place", "low", "high") if fused else F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between)
    done = ends.select("key", F.struct("share", at.alias("v")).alias("one")).groupBy("key").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return done.select(F.col("key").alias(key), F.transform("all", lambda p: p["v"]).alias("p"))


def stretched(lines: DataFrame, key: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Each frame clipped to its percentiles and scaled to whole numbers from 0 to 255; null where a frame has no values."""
    limits = percentiles(lines, key, (low, high), fused=True).select(F.col(key).alias("p_key"), "p")
    met = lines.join(limits, F.col(key) == F.col("p_key"), "left")
    line = F.transform(F.col("line").cast("array<double>"), lambda v: stretch_to_byte(v, F.col("p")[0], F.col("p")[1]))
    return met.withColumn("line", line).select(*lines.columns)
