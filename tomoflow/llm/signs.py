"""Texts as arrays of code points, so that word features are computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LAST = 0x110000


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(LAST)), bool, LAST)


@cache
def lower_table() -> np.ndarray:
    """Each code point's lower case, where that is one sign."""
    table = np.arange(LAST, dtype=np.uint32)
    for i in range(LAST):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


class Block:
    """Code points and words (stretches of letters) of several texts.

    ``codes``: lower-cased code points, 0 for what is no letter; ``begin`` and ``end`` of
    each word therein; ``doc`` its text; ``offset`` the place of each text.
    """

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts) + "\0"
        self.raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        letter = letter_table()[self.raw]
        self.codes = np.where(letter, lower_table()[self.raw], 0).astype(np.uint32)
        edges = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0))
        self.begin, self.end = edges[::2], edges[1::2]
        self.offset = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.doc = np.searchsorted(self.offset, self.begin, side="right") - 1
        #: number of the first word of each text, and of the last one's successor
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))


def chunks(texts: list[str], most: int) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` characters; a text is never cut."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def arrow_chunks(texts: pa.Array, most: int) -> Iterator[tuple[slice, list[str]]]:
    """Slices of a column of texts of about ``most`` bytes, with their texts; null is empty.

    Only one slice at a time is held as Python strings.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="left")) + 1)
        stop = min(stop, len(texts))
        yield slice(start, stop), [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop
