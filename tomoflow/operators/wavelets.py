"""Orthogonal wavelet filter banks of the Daubechies family, worked out rather than listed.

The scaling filter of order n has n zeros at -1; what is left of its power spectrum is a
polynomial in y = (2 - z - 1/z) / 4, each of whose roots gives a pair z, 1/z.  The filter takes
the root inside the unit circle.  Signals are transformed as periods; to keep their ends
apart they are mirrored beyond them, as far as the filters of all levels reach.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np

MOST_ORDER = 10


@cache
def scaling_filter(order: int) -> np.ndarray:
    """The 2 * order coefficients of the low-pass filter; their sum is the root of 2, their squares' is 1."""
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"wavelets db1 to db{MOST_ORDER} are built in, not db{order}")
    roots = []
    for y in np.roots([comb(order - 1 + k, k) for k in reversed(range(order))]):
        half = 1 - 2 * y  # z + 1/z = 2 - 4 y
        pair = half + np.array([1, -1]) * np.sqrt(half * half - 1)
        roots.append(pair[np.argmin(np.abs(pair))])
    taps = np.real(np.poly([-1.0] * order + roots))
    return taps * np.sqrt(2) / taps.sum()


def order_of(name: str) -> int:
    """``haar`` is db1."""
    if name == "haar":
        return 1
    if name.startswith("db") and name[2:].isdigit():
        scaling_filter(int(name[2:]))
        return int(name[2:])
    raise ValueError(f"wavelets haar and db1 to db{MOST_ORDER} are built in, not {name!r}")


def split(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high band of periods along the first axis, of even length."""
    low = scaling_filter(order)
    high = low[::-1] * (-1) ** np.arange(len(low))
    near = [np.roll(x, -k, axis=0)[::2] for k in range(len(low))]
    return tuple(sum(c * part for c, part in zip(taps, near, strict=True)) for taps in (low, high))


def joined(low_band: np.ndarray, high_band: np.ndarray, order: int) -> np.ndarray:
    """The transpose of ``split``, which is its inverse."""
    low = scaling_filter(order)
    high = low[::-1] * (-1) ** np.arange(len(low))
    out = np.zeros((2 * len(low_band), *low_band.shape[1:]))
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        spread = np.zeros_like(out)
        spread[::2] = a * low_band + b * high_band
        out += np.roll(spread, k, axis=0)
    return out


def margins(n: int, order: int, level: int) -> tuple[int, int]:
    """Places to add before and after n, so that all levels have an even length and the ends don't meet."""
    reach = (2 * order - 1) * ((1 << level) - 1) if order > 1 else 0
    return reach, reach + -(n + 2 * reach) % (1 << level)


def decompose(x: np.ndarray, order: int, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Last low band, and the high bands from the finest on, of a signal along the first axis, mirrored beyond its ends."""
    low, high = np.pad(x, (margins(len(x), order, level), *[(0, 0)] * (x.ndim - 1)), mode="symmetric" if len(x) else "constant"), []
    for _ in range(level):
        low, detail = split(low, order)
        high.append(detail)
    return low, high


def recompose(low: np.ndarray, high: list[np.ndarray], n: int, order: int) -> np.ndarray:
    """The signal of n places from its bands."""
    for detail in reversed(high):
        low = joined(low, detail, order)
    before = margins(n, order, len(high))[0]
    return low[before : before + n]
