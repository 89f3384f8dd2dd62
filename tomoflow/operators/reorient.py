"""Operators that look at the scan along another axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomoflow.functions.columns import part_bound


def by_projection(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Lines of an angle side by side, one exchange."""
    return lines.repartition(*([parts] if parts else []), "angle").sortWithinPartitions("angle", "det_y")


def by_sinogram(lines: DataFrame, parts: int | None = None) -> DataFrame:
    return lines.repartition(*([parts] if parts else []), "det_y").sortWithinPartitions("det_y", "angle")


def frames(lines: DataFrame, pattern: str = "sinogram") -> DataFrame:
    """One row a frame: its index and its lines in order."""
    key, other = ("det_y", "angle") if pattern == "sinogram" else ("angle", "det_y")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(other, "line"))), lambda p: p["line"])
    return lines.groupBy(key).agg(ordered.alias("frame"), F.count(F.lit(1)).alias("n_lines"))


def swapped(lines: DataFrame) -> DataFrame:
    """Angles and detector rows change places."""
    others = [c for c in lines.columns if c not in ("angle", "det_y")]
    return lines.select(F.col("det_y").alias("angle"), F.col("angle").alias("det_y"), *others)


def folded(lines: DataFrame, half: int, width: int, overlap: int = 0) -> DataFrame:
    """A scan over 360 degrees as one over 180: each line with the mirrored one of the opposite angle.

    Without overlap, the mean of both; with it, both side by side, blended linearly over
    ``overlap`` columns, the opposite one mirrored on the left.  One join of lines.
    """
    front = lines.where(F.col("angle") < half).select("angle", "det_y", F.col("line").cast("array<double>").alias("right"))
    back = lines.where(F.col("angle").between(half, 2 * half - 1))
    back = back.select((F.col("angle") - half).alias("angle"), "det_y", F.reverse(F.col("line").cast("array<double>")).alias("left"))
    both = front.join(back, ["angle", "det_y"])
    if not overlap:
        return both.select("angle", "det_y", F.zip_with("right", "left", lambda v, w: (v + w) / 2).alias("line"))
    shift = width - overlap
    met = F.arrays_zip(F.slice("left", shift + 1, overlap).alias("l"), F.slice("right", 1, overlap).alias("r"))
    share = lambda i: (i + 0.5) / overlap
    blend = F.transform(met, lambda p, i: p["l"] * (1 - share(i)) + p["r"] * share(i))
    return both.select("angle", "det_y", F.concat(F.slice("left", 1, shift), blend, F.slice("right", overlap + 1, shift)).alias("line"))


def chunk_table(spark, length: int, parts: int) -> DataFrame:
    """Half-open range of each share of an axis."""
    return spark.range(parts).select(
        F.col("id").cast("int").alias("part"),
        part_bound(F.lit(float(length)), parts, F.col("id")).alias("start"),
        part_bound(F.lit(float(length)), parts, F.col("id") + 1).alias("stop"),
    )


def block_table(spark, length: int, most: int) -> DataFrame:
    """Blocks of at most ``most`` slices, with a mark on the last."""
    numbers = spark.range(-(-length // most)).select(F.col("id").cast("int").alias("block"))
    start = F.col("block") * most
    rows = numbers.select("block", start.alias("start"), F.least(start + most, F.lit(length)).alias("stop"))
    return rows.withColumn("last", F.lead("block").over(Window.orderBy("block")).isNull())


def seam_blended(lines: DataFrame, seam: int, reach: int) -> DataFrame:
    """A linear passage over the columns within ``reach`` of a seam, between their outer values; inside each line."""
    left, right = seam - reach, seam + reach
    line = F.col("line").cast("array<double>")
    a, b = (F.get("line", F.lit(at)) if at >= 0 else F.lit(None).cast("double") for at in (left, right))
    passage = F.transform("line", lambda v, i: F.when(i.between(left, right), a + (b - a) * ((i - left) / (2.0 * reach))).otherwise(v))
    return lines.withColumn("line", line).withColumn("line", F.when(a.isNotNull() & b.isNotNull(), passage).otherwise(F.col("line")))
