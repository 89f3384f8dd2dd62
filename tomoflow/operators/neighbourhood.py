"""Neighbourhoods in all three directions, by exchange of lines.

The scan is cut into blocks of angles and rows.  A line goes to its own block and, where it
lies within reach of them, to the neighbour blocks: that is the one exchange, and what
is copied is the halo.  A block and its halo become one three-dimensional array in an Arrow group, so
a task holds one block - as many angles and rows as ``BLOCK_BYTES`` allow for the width - and never
a row per pixel.  Beyond the ends of the scan the outermost lines are repeated.

Functions take the block with its halo, and edges repeated along the lines, and give the core.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block's numbers, its halo left out.
BLOCK_BYTES = 16 << 20
LINES = "angle int, det_y int, line array<double>"

Reach = tuple[int, int, int]
BlockFunction = Callable[[np.ndarray], np.ndarray]


def block_shape(width: int, reach: Reach, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Angles and rows of a block: about as many of either, all rows where no neighbours beside are asked for."""
    lines = max(1, block_bytes // (8 * max(1, width)))
    if not reach[1]:
        return max(8, lines // 16), 16
    side = max(4 * max(reach[:2]), int(lines**0.5), 1)
    return side, side


def blocks_of(place: Column, size: int, before: int, after: int) -> Column:
    """The blocks that want the line at a place: its own, and those within whose halo it lies; none is numbered below 0."""
    first = F.greatest(F.lit(0), F.ceil((place - (size + after - 1)) / size))
    return F.sequence(first.cast("int"), F.floor((place + before) / size).cast("int"))


def dealt(lines: DataFrame, size: tuple[int, int], before: tuple[int, int], after: tuple[int, int]) -> DataFrame:
    """``lines`` with block_a and block_y, halo lines copied to each block that wants them."""
    wide = lines.withColumn("block_a", F.explode(blocks_of(F.col("angle"), size[0], before[0], after[0])))
    return wide.withColumn("block_y", F.explode(blocks_of(F.col("det_y"), size[1], before[1], after[1])))


def _box(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Angles, rows and the array of a block; every row has to be there at every angle."""
    angle, row = (table[c].to_numpy() for c in ("angle", "det_y"))
    angles, rows = np.unique(angle), np.unique(row)
    line = table["line"].combine_chunks()
    if len(angle) != len(angles) * len(rows):
        raise ValueError(f"angles {angles[0]} to {angles[-1]}, rows {rows[0]} to {rows[-1]}: {len(angle)} lines, not {len(angles) * len(rows)}")
    values = line.flatten().to_numpy(zero_copy_only=False).reshape(len(angle), -1)
    order = np.lexsort((row, angle))
    return angles, rows, values[order].reshape(len(angles), len(rows), -1).astype(float)


def each_block(lines: DataFrame, function: BlockFunction, reach: Reach, size: tuple[int, int], after: Reach | None = None) -> DataFrame:
    """``function`` on every block of ``size`` angles and rows with its halo; its core becomes the lines.

    ``reach`` is the halo on both sides, or before, if ``after`` has that behind.
    """
    after = reach if after is None else after

    def run(table: pa.Table) -> pa.Table:
        block = (table["block_a"][0].as_py(), table["block_y"][0].as_py())
        angles, rows, box = _box(table)
        pads, cores = [], []
        for number, length, have, low, high in zip(block, size, (angles, rows), reach, after, strict=False):
            core = have[(have >= number * length) & (have < (number + 1) * length)]
            cores.append(core)
            if not len(core):
                return pa.table({"angle": pa.array([], pa.int32()), "det_y": pa.array([], pa.int32()), "line": pa.array([], pa.list_(pa.float64()))})
            pads.append((low - int((have < core[0]).sum()), high - int((have > core[-1]).sum())))
        done = function(np.pad(box, (*pads, (reach[2], after[2])), mode="edge"))
        n, width = done.shape[0] * done.shape[1], done.shape[2]
        offsets = pa.array(np.arange(n + 1) * width, pa.int32())
        arrays = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(done, float).ravel()))
        return pa.table({"angle": np.repeat(cores[0], len(cores[1])).astype(np.int32), "det_y": np.tile(cores[1], len(cores[0])).astype(np.int32), "line": arrays})

    wide = dealt(lines.select("angle", "det_y", "line"), size, reach[:2], after[:2])
    return wide.groupBy("block_a", "block_y").applyInArrow(run, LINES)


def median_of_box(box: np.ndarray, reach: Reach) -> np.ndarray:
    """One angle at a time, so that the neighbourhoods of a few frames are held."""
    view = sliding_window_view(box, [2 * r + 1 for r in reach])
    middle = int(np.prod([2 * r + 1 for r in reach])) // 2
    out = np.empty(view.shape[:3])
    for i, frame in enumerate(view):
        out[i] = np.partition(frame.reshape(*frame.shape[:2], -1), middle, axis=2)[..., middle]
    return out


def core_of(box: np.ndarray, reach: Reach) -> np.ndarray:
    return box[tuple(slice(r, n - r) for r, n in zip(reach, box.shape, strict=True))]


def outliers_of_box(box: np.ndarray, reach: Reach, difference: float) -> np.ndarray:
    median, own = median_of_box(box, reach), core_of(box, reach)
    return np.where(np.abs(own - median) > difference, median, own)


def sum_of_box(box: np.ndarray, reach: Reach) -> np.ndarray:
    """Sums over each neighbourhood, one axis after the other."""
    for axis, r in enumerate(reach):
        n = box.shape[axis] - 2 * r
        box = sum(np.take(box, range(i, i + n), axis) for i in range(2 * r + 1))
    return box


def mean_of_box(box: np.ndarray, reach: Reach) -> np.ndarray:
    return sum_of_box(box, reach) / np.prod([2 * r + 1 for r in reach])


def width_of(lines: DataFrame) -> int:
    """Width of the lines: one line is read."""
    row = lines.select(F.size("line")).first()
    return row[0] if row else 1


def filtered(lines: DataFrame, function: Callable, reach: Reach, width: int | None = None, **arguments) -> DataFrame:
    """A function of a neighbourhood, ``reach`` places to either side on each axis, at every pixel."""
    size = block_shape(width or width_of(lines), reach)
    return each_block(lines, partial(function, reach=reach, **arguments), reach, size)


def median_filter(lines: DataFrame, reach: Reach, width: int | None = None) -> DataFrame:
    return filtered(lines, median_of_box, reach, width)


def mean_filter(lines: DataFrame, reach: Reach, width: int | None = None) -> DataFrame:
    return filtered(lines, mean_of_box, reach, width)


def box_sum(lines: DataFrame, reach: Reach, width: int | None = None) -> DataFrame:
    return filtered(lines, sum_of_box, reach, width)


def remove_outliers(lines: DataFrame, difference: float, reach: Reach, width: int | None = None) -> DataFrame:
    """Values further than ``difference`` from their neighbourhood's median become it."""
    return filtered(lines, outliers_of_box, reach, width, difference=difference)


def along(mask: np.ndarray, axis: int, reach: int) -> np.ndarray:
    """How many are set within ``reach`` places on an axis; the box has that much more on either side."""
    counts = np.cumsum(mask, axis=axis, dtype=np.int32)
    counts = np.concatenate([np.zeros_like(np.take(counts, [0], axis)), counts], axis=axis)
    n = mask.shape[axis] - 2 * reach
    return np.take(counts, range(2 * reach + 1, 2 * reach + 1 + n), axis) - np.take(counts, range(n), axis)


def stripes_of_box(box: np.ndarray, difference: float, columns: int, length: int, threshold: float, depth: int, least_rows: int, width: int) -> np.ndarray:
    """The stripe mask of a block with a halo of ``length`` angles and ``depth`` rows; see ``stripes_mask``."""
    view = sliding_window_view(np.pad(box, ((0, 0), (0, 0), (columns, columns)), mode="edge"), 2 * columns + 1, axis=2)
    stands_out = np.abs(box - np.partition(view, columns, axis=3)[..., columns]) > difference
    long = along(stands_out, 0, length) >= threshold * (2 * length + 1)
    deep = long[:, depth : long.shape[1] - depth] & (along(long, 1, depth) >= least_rows)
    if not width:
        return deep.astype(float)
    wide = np.pad(deep, ((0, 0), (0, 0), (width, width)))
    before, after = (np.any([wide[:, :, shift : shift + deep.shape[2]] for shift in shifts], axis=0) for shifts in (range(width), range(width + 1, 2 * width + 1)))
    return (deep | (before & after)).astype(float)


def stripes_mask(
    lines: DataFrame,
    difference: float = 0.1,
    columns: int = 2,
    length: int = 10,
    threshold: float = 0.7,
    depth: int = 1,
    least_rows: int = 2,
    stripe_width: int = 2,
    width: int | None = None,
) -> DataFrame:
    """1 where a stripe is, by rules along all three axes.

    column   a pixel stands out if it is further than ``difference`` from the median of
             ``columns`` columns to either side
    angle    its stripe is long: of the ``length`` angles before and after, itself included, a share
             of ``threshold`` stands out in the same place
    row      it is deep: of the ``depth`` rows above and below, itself included, ``least_rows`` are
             long in the same column and angle
    gaps     columns between two of a stripe, each within ``stripe_width``, belong to it

    Beyond the ends of angles and rows the outermost line counts again.
    """
    size = block_shape(width or width_of(lines), (length, depth, 0))
    function = partial(stripes_of_box, difference=difference, columns=columns, length=length, threshold=threshold, depth=depth, least_rows=least_rows, width=stripe_width)
    return each_block(lines, function, (length, depth, 0), size)
