"""One parameter, several values: the values are joined to the cropped data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sweep_values(spark, values: tuple) -> DataFrame:
    """sweep_idx, value: as many rows as the user gave values."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "sweep_idx int, value double")


def swept(pixels: DataFrame, values: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply`` on the pixels of each value (columns sweep_idx and value are there).

    The values are a handful of driver rows, so their broadcast has a proven size.
    """
    return apply(pixels.crossJoin(F.broadcast(values)))


def middle_rows(results: DataFrame, rows: int) -> DataFrame:
    """The middle detector row of each value's result, numbered by value."""
    return results.where(F.col("det_y") == rows // 2).drop("det_y").withColumnRenamed("sweep_idx", "det_y")


def stacked(results: list[DataFrame]) -> DataFrame:
    """Results of separate runs, one after the other along the values."""
    out = None
    for i, one in enumerate(results):
        numbered = one.withColumn("sweep_idx", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered)
    return out
