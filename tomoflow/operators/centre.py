"""Finding the centre of rotation: a few frames are gathered, the search runs on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoflow.operators.aggregate import averaged_rows
from tomoflow.sources.scan import voxels


def sinogram(lines: DataFrame, rows: int, ind: int | None = None, average_radius: int = 0) -> np.ndarray:
    """One sinogram in order of angle: one detector row, or the mean of those around it."""
    row = (rows - 1) // 2 if ind is None else ind
    near = lines.where(F.col("det_y").between(row - average_radius, row + average_radius))
    pixels = averaged_rows(voxels(near), row, average_radius, rows) if average_radius else voxels(near).select("angle", "det_x", "v")
    line = F.transform(F.array_sort(F.collect_list(F.struct("det_x", "v"))), lambda p: p["v"])
    ordered = pixels.groupBy("angle").agg(line.alias("line")).orderBy("angle").toPandas()
    return np.stack(ordered["line"].to_numpy()).astype(np.float32)


def projection(lines: DataFrame, angle: int) -> np.ndarray:
    frame = lines.where(F.col("angle") == angle).orderBy("det_y").select("line").toPandas()
    return np.stack(frame["line"].to_numpy()).astype(np.float32)


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Shift of b against a by phase correlation, to a tenth of a pixel or so."""
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    cross /= np.maximum(np.abs(cross), 1e-12)
    peak = np.fft.ifft2(cross).real
    at = np.unravel_index(peak.argmax(), peak.shape)
    out = []
    for axis, i in enumerate(at):
        n = peak.shape[axis]
        line = np.take(peak, [(i - 1) % n, i, (i + 1) % n], axis=axis)
        other = [at[k] if k != axis else slice(None) for k in range(2)]
        left, middle, right = line[tuple(other)]
        bend = left - 2 * middle + right
        part = 0.5 * (left - right) / bend if n > 2 and abs(bend) > 1e-12 else 0.0
        place = i + part
        out.append(float(place - n if place > n / 2 else place))
    return out[0], out[1]


def by_phase_correlation(first: np.ndarray, last: np.ndarray) -> float:
    """Centre from the first projection and the mirrored last one (180 degrees apart)."""
    _, shift = shift_between(first, last[:, ::-1])
    return (first.shape[1] - 1 + shift) / 2


def by_symmetry(sino: np.ndarray, smin: float = -50, smax: float = 50, step: float = 0.5, drop: int = 20, ratio: float = 0.5) -> float:
    """Centre for which the sinogram and its mirror image continue each other best.

    For each candidate the mirrored sinogram is moved into place below the first one; the
    energy its spectrum has outside of the double wedge of a true scan is smallest at the
    centre.
    """
    n, m = sino.shape
    middle = (m - 1) / 2
    flipped = sino[:, ::-1]
    spectrum_y = np.fft.fftfreq(2 * n)[:, None] * 2 * n
    spectrum_x = np.fft.fftfreq(m)[None, :] * m
    outside = (np.abs(spectrum_y) > np.abs(spectrum_x) * ratio * np.pi + min(drop, n // 4)).astype(float)
    best = (np.inf, middle)
    columns = np.arange(m)
    reach = (max(smin, -m / 4), min(smax, m / 4))
    for offset in np.arange(reach[0], reach[1] + step / 2, step):
        move = 2 * offset
        moved = np.stack([np.interp(columns - move, columns, row) for row in flipped])
        beyond = columns < move if move > 0 else columns > m - 1 + move
        moved[:, beyond] = sino[:, beyond]
        cost = (np.abs(np.fft.fft2(np.vstack([sino, moved]))) * outside).mean()
        if cost < best[0]:
            best = (cost, middle + offset)
    return float(best[1])


def by_overlap(first: np.ndarray, opposite: np.ndarray, window: int = 10) -> tuple[float, float, str, float]:
    """cor, overlap, side and place of the overlap of a scan over 360 degrees.

    The edge columns of one frame are looked for in the mirrored opposite frame; the
    side where they are found best is where the frames overlap.
    """
    m = first.shape[1]
    mirrored = opposite[:, ::-1]
    window = min(window, m // 4) or 1

    def match(edge: np.ndarray, other: np.ndarray) -> tuple[float, int]:
        def score(i: int) -> float:
            part = other[:, i : i + window]
            a, b = edge - edge.mean(), part - part.mean()
            return float((a * b).sum() / (np.sqrt((a * a).sum() * (b * b).sum()) + 1e-12))

        scores = [score(i) for i in range(m - window + 1)]
        return max(scores), int(np.argmax(scores))

    left, at_left = match(first[:, :window], mirrored)
    right, at_right = match(first[:, m - window :], mirrored)
    if left > right:
        overlap, side, place = m - at_left, "left", at_left
        cor = (overlap - 1) / 2
    else:
        overlap, side, place = at_right + window, "right", at_right
        cor = m - 1 - (overlap - 1) / 2
    return float(cor), float(overlap), side, float(place)


def best_sharpness(sino: np.ndarray, theta: np.ndarray, candidates: list[float]) -> float:
    """The candidate whose reconstruction has the least entropy."""
    from tomoflow.operators.frames import fbp

    def entropy(center: float) -> float:
        image = fbp(sino, theta, center)
        counts, _ = np.histogram(image, 64)
        share = counts[counts > 0] / counts.sum()
        return float(-(share * np.log2(share)).sum())

    return min(candidates, key=entropy)
