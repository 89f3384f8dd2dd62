"""Reconstruction in Fourier space by gridding.

By the slice theorem the spectrum of a projection lies on a line through the origin of the
image's spectrum.  The filtered spectra of all projections are spread over a square grid with a
short kernel, the grid is transformed back at once, and the image is divided by the
kernel's own transform, which the spreading has laid over it.

The kernel is the prolate spheroidal wave function of order 0: of all functions of its width the
one with the least energy outside of the image.  It is the eigenvector of the Legendre
expansion's recurrence (a symmetric matrix) for the space-bandwidth product ``BANDWIDTH``.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Cells that the kernel spans, and its space-bandwidth product for a grid of twice the image.
CELLS = 6
BANDWIDTH = np.pi * CELLS * 0.75


@cache
def prolate(bandwidth: float = BANDWIDTH, terms: int = 60) -> np.ndarray:
    """Legendre coefficients of the wave function of order 0 on [-1, 1], 1 in the middle."""
    k = np.arange(0, 2 * terms, 2, dtype=float)
    c2 = bandwidth**2
    diagonal = k * (k + 1) + c2 * (2 * k * (k + 1) - 1) / ((2 * k + 3) * (2 * k - 1))
    beside = c2 * (k[:-1] + 2) * (k[:-1] + 1) / ((2 * k[:-1] + 3) * np.sqrt((2 * k[:-1] + 1) * (2 * k[:-1] + 5)))
    _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    coefficients = np.zeros(2 * terms)
    coefficients[::2] = vectors[:, 0] * np.sqrt(k + 0.5)
    return coefficients / np.polynomial.legendre.legval(0.0, coefficients)


def kernel(distance: np.ndarray) -> np.ndarray:
    """Weight of a cell by its distance; none beyond half the cells."""
    x = distance / (CELLS / 2)
    return np.where(np.abs(x) <= 1, np.polynomial.legendre.legval(np.clip(x, -1, 1), prolate()), 0.0)


def apodisation(places: np.ndarray, size: int) -> np.ndarray:
    """What spreading by the kernel lays over the image at the given places of a grid of ``size``."""
    x, weights = np.polynomial.legendre.leggauss(64)
    u = x * CELLS / 2
    return (CELLS / 2) * np.cos(2 * np.pi * np.outer(places, u) / size) @ (weights * kernel(u))


#: Damping by frequency, as a share of the highest: the ramp alone rings at sharp edges.
DAMPING = {
    "none": np.ones_like,
    "shepp": lambda f: np.sinc(f / 2),
    "linear": lambda f: np.sinc(f / 2) ** 2,  # what linear interpolation does in back projection
    "cosine": lambda f: np.cos(np.pi * f / 2),
    "hann": lambda f: (1 + np.cos(np.pi * f)) / 2,
    "parzen": lambda f: np.where(f < 0.5, 1 - 6 * f**2 * (1 - f), 2 * (1 - np.minimum(f, 1)) ** 3),
}


def gridrec(
    sinogram: np.ndarray,
    theta: np.ndarray,
    center: float | None = None,
    recon_size: int | None = None,
    recon_mask_radius: float | None = None,
    filter_freq_cutoff: float = 1.0,
    filter_name: str = "linear",
) -> np.ndarray:
    """One slice from one sinogram (angles x columns); theta in radians, over half a turn."""
    from tomoflow.operators.frames import ramp

    if filter_name not in DAMPING:
        raise ValueError(f"filters are {', '.join(DAMPING)}, not {filter_name!r}")
    if len(theta) != len(sinogram):
        raise ValueError(f"{len(sinogram)} projections, but {len(theta)} angles")
    n_angles, columns = sinogram.shape
    size = int(recon_size or columns)
    center = (columns - 1) / 2 if center is None else center
    grid = 1 << int(2 * max(columns, size) - 1).bit_length()
    k = np.fft.fftfreq(grid, 1 / grid)
    response = ramp(grid) * np.exp(2j * np.pi * k * center / grid)
    response = response * DAMPING[filter_name](2 * np.abs(k) / grid)
    response[np.abs(k) > 0.5 * filter_freq_cutoff * grid] = 0
    spectra = np.fft.fft(sinogram, grid, axis=1) * response
    cells = np.zeros((2, grid * grid))
    near = np.arange(CELLS) - CELLS // 2 + 1
    for line, angle in zip(spectra, theta, strict=True):
        u, v = k * np.cos(angle), k * np.sin(angle)
        at_u, at_v = (np.floor(p).astype(int)[:, None] + near for p in (u, v))
        w_u, w_v = kernel(u[:, None] - at_u), kernel(v[:, None] - at_v)
        cell = (at_v % grid)[:, :, None] * grid + (at_u % grid)[:, None, :]
        weight = w_v[:, :, None] * w_u[:, None, :]
        for part, values in zip(cells, (line.real, line.imag), strict=True):
            part += np.bincount(cell.ravel(), (weight * values[:, None, None]).ravel(), grid * grid)
    first = -(size - 1) / 2
    turn = np.exp(2j * np.pi * k * first / grid)
    image = np.fft.ifft2((cells[0] + 1j * cells[1]).reshape(grid, grid) * turn[:, None] * turn[None, :]).real[:size, :size]
    places = np.arange(size) + first
    laid = apodisation(places, grid)
    out = image * (np.pi * grid / n_angles) / (laid[:, None] * laid[None, :])
    if recon_mask_radius is not None:
        out[places[None, :] ** 2 + places[:, None] ** 2 > (recon_mask_radius * size / 2) ** 2] = 0
    return out
