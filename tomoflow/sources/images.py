"""Encoders of grey images: PGM, PNG, baseline TIFF and baseline JPEG.

An encoder takes a two-dimensional array of whole numbers, the bits of a pixel and the quality
(JPEG only), and gives the file's bytes.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np


def pgm(image: np.ndarray, bits: int = 8, quality: int = 95) -> bytes:
    """Portable grey map of whole numbers."""
    kind = ">u1" if bits <= 8 else ">u2"
    head = f"P5\n{image.shape[1]} {image.shape[0]}\n{(1 << bits) - 1}\n".encode()
    return head + image.astype(kind).tobytes()


def png(image: np.ndarray, bits: int = 8, quality: int = 95) -> bytes:
    kind, depth = (">u1", 8) if bits <= 8 else (">u2", 16)
    rows = b"".join(b"\0" + r.astype(kind).tobytes() for r in image)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tiff(image: np.ndarray, bits: int = 8, quality: int = 95) -> bytes:
    """Baseline TIFF: one uncompressed strip of 8, 16 or 32 bits a pixel, black is 0."""
    size = 1 if bits <= 8 else 2 if bits <= 16 else 4
    data = image.astype(f"<u{size}").tobytes()
    height, width = image.shape
    # tag, type (3: two bytes, 4: four), value. Fixed values of the format
    fields = [(256, 4, width), (257, 4, height), (258, 3, 8 * size), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, height), (279, 4, len(data)), (339, 3, 1)]
    first = 8 + 2 + 12 * len(fields) + 4
    directory = b"".join(struct.pack("<HHII", tag, kind, 1, first if tag == 273 else value) for tag, kind, value in fields)
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + directory + struct.pack("<I", 0) + data


# Quantisation of luminance at quality 50
QUANTA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
#: Places of a block of 8 x 8 by diagonals, every second one upwards.
ZIGZAG = sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
#: Run of 16 zeros, and end of a block.
LONG_RUN, BLOCK_END = 0xF0, 0x00


def quantisation(quality: int) -> np.ndarray:
    """The divisors for a quality from 1 to 100."""
    if not 1 <= quality <= 100:
        raise ValueError(f"jpeg_quality is from 1 to 100, not {quality}")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(QUANTA) * scale + 50) // 100, 1, 255)


def cosines() -> np.ndarray:
    """The orthonormal cosine transform of 8 numbers."""
    k = np.arange(8)
    out = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 16) / 2
    out[0] /= np.sqrt(2)
    return out


def code_lengths(symbols: np.ndarray) -> dict[int, int]:
    """Huffman code lengths, at most 16, of the symbols that occur; one code stays free, as the format asks."""
    found, n = np.unique(symbols, return_counts=True)
    floor = max(1, int(n.sum()) >> 10)  # no code gets longer than log 1024 / log 1.618 bits
    heap = [(max(floor, int(c)), int(s), ((int(s), 0),)) for s, c in zip(found, n, strict=True)] + [(floor, 256, ((256, 0),))]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), tuple((s, depth + 1) for s, depth in a[2] + b[2])))
    depths = dict(heap[0][2])
    # the code without symbol has to be the last of the longest
    longest = max(depths, key=lambda s: (depths[s], s == 256))
    depths[longest], depths[256] = depths[256], depths[longest]
    del depths[256]
    return depths


def huffman(symbols: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as the file has it, and code and length by symbol."""
    depths = code_lengths(symbols)
    order = sorted(depths, key=lambda s: (depths[s], s))
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, last = 0, 0
    for s in order:
        code <<= depths[s] - last
        codes[s], lengths[s], last = code, depths[s], depths[s]
        code += 1
    counts = bytes(sum(d == length for d in depths.values()) for length in range(1, 17))
    return counts + bytes(order), codes, lengths


def magnitudes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of bits of each value, and these bits (negative ones less one)."""
    sizes = np.where(values == 0, 0, np.floor(np.log2(np.maximum(1, np.abs(values)))).astype(np.int64) + 1)
    return sizes, np.where(values < 0, values + (1 << sizes) - 1, values)


def packed(codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """The codes' bits one after the other, ones at the end; a byte 255 is followed by 0."""
    total = int(lengths.sum())
    ends = np.repeat(np.cumsum(lengths), lengths)
    bits = (np.repeat(codes, lengths) >> (ends - np.arange(total) - 1)) & 1
    data = np.packbits(np.concatenate([bits, np.ones(-total % 8, np.int64)]).astype(np.uint8)).tobytes()
    return data.replace(b"\xff", b"\xff\0")


def jpeg(image: np.ndarray, bits: int = 8, quality: int = 95) -> bytes:
    """Baseline JPEG of one component of 8 bits, with Huffman tables of its own."""
    if bits > 8:
        raise ValueError(f"JPEG images have 8 bits, not {bits}")
    height, width = image.shape
    quanta, transform = quantisation(quality), cosines()
    wide = np.pad(image.astype(float), ((0, -height % 8), (0, -width % 8)), mode="edge") - 128
    blocks = wide.reshape(wide.shape[0] // 8, 8, wide.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    spectrum = (transform @ blocks @ transform.T).reshape(-1, 64)
    cells = np.rint(spectrum / quanta).astype(np.int64)[:, ZIGZAG]
    mean_size, mean_bits = magnitudes(np.diff(cells[:, 0], prepend=0))
    block, at = np.nonzero(cells[:, 1:])
    first = np.diff(block, prepend=-1) != 0
    run = at - np.where(first, -1, np.concatenate([[0], at[:-1]])[: len(at)]) - 1
    size, extra = magnitudes(cells[block, at + 1])
    ended = np.ones(len(cells), bool)
    ended[block[at == 62]] = False
    # events: (block, place, order within it), symbol, further bits and how many
    many = run // 16
    of = np.repeat(np.arange(len(run)), many)
    place = np.concatenate([block * 66 + at + 1, block[of] * 66 + at[of] + 1, np.flatnonzero(ended) * 66 + 65])
    order = np.concatenate([np.ones(len(run), int), np.zeros(len(of), int), np.zeros(int(ended.sum()), int)])
    symbol = np.concatenate([(run % 16 << 4) + size, np.full(len(of), LONG_RUN), np.full(int(ended.sum()), BLOCK_END)])
    more, more_size = (np.concatenate([x, np.zeros(len(of) + int(ended.sum()), np.int64)]) for x in (extra, size))
    mean_table, mean_codes, mean_lengths = huffman(mean_size)
    table, codes, lengths = huffman(symbol)
    place = np.concatenate([np.arange(len(cells)) * 66, place])
    order = np.concatenate([np.zeros(len(cells), int), order])
    code = np.concatenate([(mean_codes[mean_size] << mean_size) | mean_bits, (codes[symbol] << more_size) | more])
    length = np.concatenate([mean_lengths[mean_size] + mean_size, lengths[symbol] + more_size])
    sequence = np.lexsort((order, place))

    def segment(marker: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data

    return b"".join(
        [
            b"\xff\xd8",
            segment(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0)),
            segment(0xDB, b"\0" + bytes(quanta[ZIGZAG].tolist())),
            segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
            segment(0xC4, b"\x00" + mean_table),
            segment(0xC4, b"\x10" + table),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            packed(code[sequence], length[sequence]),
            b"\xff\xd9",
        ]
    )


WRITERS = {"pgm": pgm, "png": png, "tif": tiff, "tiff": tiff, "jpeg": jpeg, "jpg": jpeg}
