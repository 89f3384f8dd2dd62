"""Image files, read back by small readers that share nothing with the encoders."""

import struct

import numpy as np
import pytest

from tomoflow.sources import images
from tomoflow.sources.sinks import images as image_table


def read_tiff(data):
    assert data[:4] == b"II*\0"
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack_from("<HHII", data, at + 2 + 12 * i)
        tags[tag] = value & 0xFFFF if kind == 3 else value
    assert list(tags) == sorted(tags) and tags[259] == 1 and tags[262] == 1
    kind = f"<u{tags[258] // 8}"
    return np.frombuffer(data, kind, tags[256] * tags[257], tags[273]).reshape(tags[257], tags[256])


def read_jpeg(data):
    """A baseline decoder of one component, bit by bit."""
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    at, tables, quanta = 2, {}, None
    while True:
        marker, size = struct.unpack_from(">xBH", data, at)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quanta = list(body[1:65])
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
        elif marker == 0xC4:
            counts, values, code, table, place = body[1:17], body[17:], 0, {}, 0
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    assert code != (1 << length) - 1  # no code of ones
                    table[length, code] = values[place]
                    code, place = code + 1, place + 1
                code <<= 1
            tables[body[0]] = table
        elif marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\0", b"\xff"))
    place = 0

    def symbol(table):
        nonlocal place
        for length in range(1, 17):
            found = table.get((length, int(bits[place : place + length], 2)))
            if found is not None:
                place += length
                return found
        raise ValueError("no such code")

    def number(size):
        nonlocal place
        if not size:
            return 0
        value = int(bits[place : place + size], 2)
        place += size
        return value if value >> (size - 1) else value - (1 << size) + 1

    rows, columns, before = -(-height // 8), -(-width // 8), 0
    zigzag, (y, x), step = [], (0, 0), 1
    for _ in range(64):
        zigzag.append(8 * y + x)
        if step == 1 and (x == 7 or y == 0):
            y, x, step = (y + 1, x, -1) if x == 7 else (y, x + 1, -1)
        elif step == -1 and (y == 7 or x == 0):
            y, x, step = (y, x + 1, 1) if y == 7 else (y + 1, x, 1)
        else:
            y, x = y - step, x + step
    out = np.zeros((8 * rows, 8 * columns))
    n = np.arange(8)
    for b in range(rows * columns):
        cells = np.zeros(64)
        before += number(symbol(tables[0x00]))
        cells[0] = before * quanta[0]
        k = 1
        while k < 64:
            s = symbol(tables[0x10])
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                cells[zigzag[k]] = number(s & 15) * quanta[k]
            k += 1
        spectrum, block = cells.reshape(8, 8), np.zeros((8, 8))
        for v in range(8):
            for u in range(8):
                scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                block += scale * spectrum[v, u] * np.outer(np.cos((2 * n + 1) * v * np.pi / 16), np.cos((2 * n + 1) * u * np.pi / 16))
        out[8 * (b // columns) :, 8 * (b % columns) :][:8, :8] = block + 128
    return out[:height, :width]


def picture(height, width, seed=0):
    y, x = np.mgrid[:height, :width]
    noise = np.random.default_rng(seed).normal(scale=6, size=(height, width))
    return np.clip(127 + 90 * np.sin(x / 5) * np.cos(y / 7) + noise, 0, 255).astype(int)


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_tiff(bits):
    image = np.random.default_rng(bits).integers(0, 1 << bits, size=(13, 21))
    assert (read_tiff(images.tiff(image, bits)) == image).all()


@pytest.mark.parametrize("size", [(8, 8), (16, 24), (13, 21), (1, 1), (40, 33)])
def test_jpeg(size):
    image = picture(*size)
    errors, lengths = [], []
    for quality in (10, 50, 95, 100):
        data = images.jpeg(image, quality=quality)
        errors.append(np.abs(read_jpeg(data) - image).mean())
        lengths.append(len(data))
    assert errors[-1] < 0.6 and errors[2] < 2.5 and lengths == sorted(lengths)
    if min(size) > 8:
        assert errors[0] > errors[2]


def test_jpeg_of_flat_and_busy_pictures():
    for value in (0, 7, 255):
        assert np.abs(read_jpeg(images.jpeg(np.full((20, 20), value))) - value).max() <= 1
    busy = np.random.default_rng(1).integers(0, 2, size=(64, 64)) * 255
    assert np.abs(read_jpeg(images.jpeg(busy, quality=100)) - busy).mean() < 1
    spread = np.zeros((16, 16), int)
    spread[7, 7] = 255  # long runs of zeros
    assert np.abs(read_jpeg(images.jpeg(spread, quality=60)) - spread).mean() < 5
    for bad in (0, 101):
        with pytest.raises(ValueError, match="jpeg_quality"):
            images.jpeg(busy, quality=bad)
    with pytest.raises(ValueError, match="8 bits"):
        images.jpeg(busy, bits=16)


def test_images_of_frames(spark):
    data = np.stack([picture(9, 14, seed) for seed in range(3)])
    rows = [(a, y, [float(v) for v in data[a, y]]) for a in range(3) for y in range(9)]
    lines = spark.createDataFrame(rows, "angle int, det_y int, line array<float>")
    for kind, read, error in (("tiff", read_tiff, 0), ("jpeg", read_jpeg, 2.5)):
        made = {r.name: bytes(r.content) for r in image_table(lines, 0, file_format=kind, low=0.0, high=255.0).collect()}
        assert sorted(made) == [f"0000{a}.{kind}" for a in range(3)]
        for a in range(3):
            assert np.abs(read(made[f"0000{a}.{kind}"]) - data[a]).mean() <= error
    small, large = (sum(len(r.content) for r in image_table(lines, 0, file_format="jpeg", quality=q).collect()) for q in (20, 98))
    assert small < large
