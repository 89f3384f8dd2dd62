"""Copies of slices beyond the ends of an axis and around blocks, and running medians inside a line.

Rows may be lines or pixels.  Neighbourhoods across lines are in ``neighbourhood``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("angle", "det_y", "det_x")


def padded(rows: DataFrame, before: int, after: int, length: int, axis: str = "angle") -> DataFrame:
    """The rows and copies of the two end slices beyond them; ``core`` tells them apart."""
    ends = rows.where(F.col(axis).isin(0, length - 1))
    low = F.when(F.col(axis) == 0, F.sequence(F.lit(-before), F.lit(-1))) if before else F.when(F.lit(False), F.array(F.lit(0)))
    high = F.when(F.col(axis) == length - 1, F.sequence(F.lit(length), F.lit(length + after - 1))) if after else F.when(F.lit(False), F.array(F.lit(0)))
    empty = F.array().cast("array<int>")
    places = F.concat(F.coalesce(low, empty), F.coalesce(high, empty))
    halo = ends.withColumn("to", F.explode(places)).withColumn(axis, F.col("to")).drop("to")
    return rows.withColumn("core", F.lit(True)).unionByName(halo.withColumn("core", F.lit(False)))


def blocks(rows: DataFrame, size: int, before: int, after: int, length: int, axis: str = "angle") -> DataFrame:
    """The rows of each block of ``size`` slices with its halo, true neighbours where there are any."""
    whole = padded(rows, before, after, length, axis)
    place = F.col(axis)
    count = -(-length // size)
    first = F.greatest(F.lit(0), F.ceil((place - (size + after - 1)) / size)).cast("int")
    last = F.least(F.lit(count - 1), F.floor((place + before) / size)).cast("int")
    dealt = whole.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.col("block") * size
    stop = F.least(start + size, F.lit(length))
    return dealt.withColumn("core", place.between(start, stop - 1))


#: Numbers of lines that are worked on at once.
SLAB = 1 << 20


def remove_outlier_lines(lines: DataFrame, difference: float, reach: int = 1) -> DataFrame:
    """Values further than ``difference`` from the running median along det_x become it; edges are repeated.

    Arrow batches of lines where they lie: no exchange, and no row per pixel.
    """
    names = lines.columns
    place = names.index("line")

    def fixed(line: np.ndarray) -> np.ndarray:
        windows = sliding_window_view(np.pad(line, ((0, 0), (reach, reach)), mode="edge"), 2 * reach + 1, axis=1)
        median = np.partition(windows, reach, axis=2)[..., reach]
        return np.where(np.abs(line - median) > difference, median, line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            out, begins = np.empty(len(values)), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            for width in np.unique(lengths[lengths > 0]).tolist():  # nearly always one
                mine = np.flatnonzero(lengths == width)
                for at in range(0, len(mine), max(1, SLAB // width)):
                    few = mine[at : at + max(1, SLAB // width)]
                    where = begins[few][:, None] + np.arange(width)
                    out[where] = fixed(values[where])
            columns = list(batch.columns)
            columns[place] = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'line' else f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(run, schema)
