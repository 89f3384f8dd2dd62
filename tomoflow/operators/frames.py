"""Whole frames in Python: what no expression can say.

A frame - a projection or a sinogram - is one group, so a group's size is that of one
frame; Arrow carries it.  The functions take and give two-dimensional arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tomoflow.operators import wavelets

LINES = "angle int, det_y int, line array<float>"


def each_frame(lines: DataFrame, function: Callable[..., np.ndarray], pattern: str, by: list[str] | None = None, **arguments: Any) -> DataFrame:
    """``function(frame, **arguments)`` on every frame; its rows become the lines.

    The frame's rows are in order of the other axis.  A frame that keeps its number of
    rows keeps their indices, another one is numbered from 0.  ``by`` names further
    keys, such as the index of a sweep.
    """
    own, other = ("det_y", "angle") if pattern == "sinogram" else ("angle", "det_y")
    keys = [*(by or []), own]
    schema = ", ".join([*(f"{k} int" for k in by or []), LINES])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(other)
        frame = np.stack(group["line"].to_numpy()).astype(np.float32)
        made = np.atleast_2d(np.asarray(function(frame, **arguments), np.float32))
        index = group[other].to_numpy() if len(made) == len(frame) else np.arange(len(made))
        columns = {k: np.int32(v) for k, v in zip(keys, key, strict=True)}
        out = pd.DataFrame({other: index.astype("int32"), "line": list(made)})
        for name, value in columns.items():
            out[name] = value
        return out[[*(by or []), "angle", "det_y", "line"]]

    return lines.select(*(by or []), "angle", "det_y", "line").groupBy(*keys).applyInPandas(run, schema)


def _shifted(frame: np.ndarray, reach: int) -> np.ndarray:
    """All shifts of a frame within ``reach`` in both directions, edges repeated."""
    wide = np.pad(frame, reach, mode="edge")
    n, m = frame.shape
    return np.stack([wide[i : i + n, j : j + m] for i in range(2 * reach + 1) for j in range(2 * reach + 1)])


def median_2d(frame: np.ndarray, size: int = 3) -> np.ndarray:
    return np.median(_shifted(frame, size // 2), axis=0)


def dezing_2d(frame: np.ndarray, size: int = 3, difference: float = 0.1) -> np.ndarray:
    """Pixels far from their neighbourhood's median become the median."""
    median = median_2d(frame, size)
    return np.where(np.abs(frame - median) > difference, median, frame)


def paganin(frame: np.ndarray, ratio_delta_beta: float = 250.0, pixel_size: float = 1.28, distance: float = 1.0, energy: float = 53.0) -> np.ndarray:
    """Phase retrieval of one projection: -log of the frame smoothed by 1 / (1 + c |f|^2).

    Pixel size in micrometres, distance in metres, energy in keV.
    """
    wavelength = 1.2398419843320026e-9 / energy
    n, m = frame.shape
    wide = np.pad(frame, ((n, n), (m, m)), mode="edge")
    fy, fx = (np.fft.fftfreq(k, pixel_size * 1e-6) for k in wide.shape)
    factor = np.pi * wavelength * distance * ratio_delta_beta
    smooth = np.fft.ifft2(np.fft.fft2(wide) / (1 + factor * (fy[:, None] ** 2 + fx[None, :] ** 2))).real
    return -np.log(np.maximum(smooth[n : 2 * n, m : 2 * m], 1e-6))


def remove_stripe_fw(sinogram: np.ndarray, level: int = 3, sigma: float = 2.0, wname: str = "haar", pad: bool = True) -> np.ndarray:
    """Combined wavelet and Fourier stripe filter: columns' detail is damped at low frequencies."""
    if pad:  # mirrored beyond both ends of the angles, so that they don't meet in the spectrum
        edge = max(1, len(sinogram) // 4)
        return remove_stripe_fw(np.pad(sinogram, ((edge, edge), (0, 0)), mode="reflect" if len(sinogram) > 1 else "edge"), level, sigma, wname, False)[edge : edge + len(sinogram)]
    n, m = sinogram.shape
    order = wavelets.order_of(wname)
    # the second axis is split into details; frequencies run along the angles
    low, details = wavelets.decompose(sinogram.T.astype(float), order, level)
    damp = 1 - np.exp(-(np.fft.fftfreq(n, 1 / n) ** 2) / (2 * sigma**2))
    damped = [np.fft.ifft(np.fft.fft(high, axis=1) * damp, axis=1).real for high in details]
    return wavelets.recompose(low, damped, m, order).T


def sort_stripes(sinogram: np.ndarray, size: int = 3) -> np.ndarray:
    """Stripes removed by sorting: each column's values sorted along the angles, a median
    across the columns, and each value back at its angle."""
    order = np.argsort(sinogram, axis=0, kind="stable")
    wide = np.pad(np.take_along_axis(sinogram, order, axis=0), ((0, 0), (size // 2, size // 2)), mode="edge")
    ranked = np.median(np.stack([wide[:, i : i + sinogram.shape[1]] for i in range(2 * (size // 2) + 1)]), axis=0)
    out = np.empty_like(sinogram)
    np.put_along_axis(out, order, ranked.astype(sinogram.dtype), axis=0)
    return out


def remove_all_stripe(sinogram: np.ndarray, size: int = 5, ratio: float = 3.0) -> np.ndarray:
    """Large stripes by their mean against its median, the rest by sorting."""
    mean = sinogram.mean(axis=0)
    wide = np.pad(mean, size // 2, mode="edge")
    smooth = np.median(np.stack([wide[i : i + len(mean)] for i in range(size)]), axis=0)
    gap = mean - smooth
    level = np.median(np.abs(gap)) + 1e-12
    return sort_stripes(sinogram - np.where(np.abs(gap) > ratio * level, gap, 0)[None, :], size)


def ramp(width: int) -> np.ndarray:
    """Frequency response of the band-limited ramp kernel for a padded width."""
    n = np.arange(-(width // 2), width // 2)
    odd = n % 2 != 0
    kernel = np.zeros(width)
    kernel[n == 0] = 0.25
    kernel[odd] = -1 / (np.pi * n[odd]) ** 2
    return np.abs(np.fft.fft(np.fft.ifftshift(kernel)))


def fbp(sinogram: np.ndarray, theta: np.ndarray, center: float | None = None, recon_size: int | None = None, recon_mask_radius: float | None = None, filter_freq_cutoff: float = 1.0) -> np.ndarray:
    """Filtered back projection of one sinogram (angles x columns); theta in radians."""
    if len(theta) != len(sinogram):
        raise ValueError(f"{len(sinogram)} projections, but {len(theta)} angles")
    n_angles, columns = sinogram.shape
    size = int(recon_size or columns)
    center = (columns - 1) / 2 if center is None else center
    width = 1 << int(2 * columns - 1).bit_length()
    response = 2 * ramp(width)
    response[np.abs(np.fft.fftfreq(width)) > 0.5 * filter_freq_cutoff] = 0
    filtered = np.fft.ifft(np.fft.fft(sinogram, width, axis=1) * response, axis=1).real[:, :columns]
    grid = np.arange(size) - (size - 1) / 2
    out = np.zeros((size, size))
    for row, angle in zip(filtered, theta, strict=True):
        at = center + grid[None, :] * np.cos(angle) + grid[:, None] * np.sin(angle)
        out += np.interp(at, np.arange(columns), row, left=0, right=0)
    out *= np.pi / (2 * n_angles)
    if recon_mask_radius is not None:
        out[grid[None, :] ** 2 + grid[:, None] ** 2 > (recon_mask_radius * size / 2) ** 2] = 0
    return out


def project(image: np.ndarray, theta: np.ndarray, columns: int) -> np.ndarray:
    """Forward projection: the transpose of back projection without filter."""
    size = len(image)
    grid = np.arange(size) - (size - 1) / 2
    out = np.zeros((len(theta), columns))
    for i, angle in enumerate(theta):
        at = (columns - 1) / 2 + grid[None, :] * np.cos(angle) + grid[:, None] * np.sin(angle)
        low = np.floor(at).astype(int)
        share = at - low
        for place, weight in ((low, 1 - share), (low + 1, share)):
            ok = (place >= 0) & (place < columns)
            out[i] += np.bincount(place[ok], weights=(weight * image)[ok], minlength=columns)
    return out


def back_project(sinogram: np.ndarray, theta: np.ndarray, size: int) -> np.ndarray:
    columns = sinogram.shape[1]
    grid = np.arange(size) - (size - 1) / 2
    out = np.zeros((size, size))
    for row, angle in zip(sinogram, theta, strict=True):
        at = (columns - 1) / 2 + grid[None, :] * np.cos(angle) + grid[:, None] * np.sin(angle)
        out += np.interp(at, np.arange(columns), row, left=0, right=0)
    return out


def denoise_tv(image: np.ndarray, regularisation: float = 0.05, iterations: int = 50) -> np.ndarray:
    """Total-variation denoising by the dual projected-gradient method."""
    p = np.zeros((2, *image.shape))
    for _ in range(iterations):
        divergence = np.zeros(image.shape)
        divergence[:-1] += p[0, :-1]
        divergence[1:] -= p[0, :-1]
        divergence[:, :-1] += p[1, :, :-1]
        divergence[:, 1:] -= p[1, :, :-1]
        u = image + regularisation * divergence
        gradient = np.zeros(p.shape)
        gradient[0, :-1] = u[1:] - u[:-1]
        gradient[1, :, :-1] = u[:, 1:] - u[:, :-1]
        p = p + gradient / (8 * regularisation)
        p /= np.maximum(1, np.sqrt((p**2).sum(axis=0)))
    return u


def fista(sinogram: np.ndarray, theta: np.ndarray, iterations: int = 15, regularisation: float = 0.0, recon_size: int | None = None) -> np.ndarray:
    """Accelerated gradient reconstruction, with total-variation steps if asked for."""
    size = int(recon_size or sinogram.shape[1])
    x = y = np.zeros((size, size))
    probe = np.ones((size, size))
    for _ in range(5):
        probe = back_project(project(probe, theta, sinogram.shape[1]), theta, size)
        norm = np.linalg.norm(probe)
        probe /= norm
    t = 1.0
    for _ in range(iterations):
        new = y - back_project(project(y, theta, sinogram.shape[1]) - sinogram, theta, size) / (1.05 * norm)
        if regularisation:
            new = denoise_tv(new, regularisation, 10)
        new = np.maximum(new, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def undistort(frame: np.ndarray, xcenter: float, ycenter: float, list_fact: list[float], shift_xy=(0, 0), step_xy=(1, 1)) -> np.ndarray:
    """Radial distortion removed: pixel r is read at r times the polynomial of its radius."""
    n, m = frame.shape
    x = np.arange(m) * step_xy[1] + shift_xy[0] - xcenter
    y = np.arange(n) * step_xy[0] + shift_xy[1] - ycenter
    radius = np.sqrt(x[None, :] ** 2 + y[:, None] ** 2)
    factor = sum(f * radius**i for i, f in enumerate(list_fact))
    px = np.clip((x[None, :] * factor + xcenter - shift_xy[0]) / step_xy[1], 0, m - 1)
    py = np.clip((y[:, None] * factor + ycenter - shift_xy[1]) / step_xy[0], 0, n - 1)
    x0, y0 = np.minimum(px.astype(int), max(0, m - 2)), np.minimum(py.astype(int), max(0, n - 2))
    x1, y1 = np.minimum(x0 + 1, m - 1), np.minimum(y0 + 1, n - 1)
    ax, ay = px - x0, py - y0
    return frame[y0, x0] * (1 - ax) * (1 - ay) + frame[y0, x1] * ax * (1 - ay) + frame[y1, x0] * (1 - ax) * ay + frame[y1, x1] * ax * ay


def stripes_mask(sinogram: np.ndarray, threshold: float = 0.7, size: int = 5) -> np.ndarray:
    """1 where columns stand out along most angles."""
    gap = np.abs(sinogram - median_2d(sinogram, size))
    often = (gap > np.median(gap) * 3).mean(axis=0) > threshold
    return np.repeat(often[None, :].astype(float), len(sinogram), axis=0)
