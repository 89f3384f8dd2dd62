"""Volumes in HDF5 files: what of the published file format detector scans use.

Read: superblocks 0 to 3, object headers 1 and 2, groups as symbol tables or as links in the
header, soft links; compact, contiguous and chunked data (a B-tree of chunks, or a single
chunk), whole and floating-point numbers of either byte order, filters deflate, shuffle and
fletcher32.  What else a file may hold is named in the error.

Written: superblock 0, symbol tables, one B-tree of chunks a volume - the oldest forms, which
every reader knows.  The chunks themselves are written elsewhere (see ``volumes``); here is what
describes them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np

#: Fixed values of the file format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, CONTINUATION, SYMBOLS = 0x1, 0x2, 0x3, 0x5, 0x6, 0x8, 0xB, 0x10, 0x11
DEFLATE, SHUFFLE, FLETCHER32 = 1, 2, 3
#: Half of the entries of a node of names, of a tree of names and of a tree of chunks, as superblock 0 has them.
LEAF_K, GROUP_K, CHUNK_K = 4, 16, 32


class Hdf5Error(ValueError):
    """The file isn't HDF5, is damaged, or uses what isn't built in."""


Reader = Callable[[int, int], bytes]


def local_path(path: str) -> str | None:
    """The path on a mounted file system; None where it names another store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def reader_of(path: str) -> Reader:
    """Bytes of a file by place and number: on a mounted file system, or in a store that Arrow reads."""
    local = local_path(path)
    if local is not None:
        handle = open(local, "rb")  # stays open as long as the reader
        return lambda at, size: os.pread(handle.fileno(), size, at)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    remote = store.open_input_file(inner)
    return lambda at, size: remote.read_at(size, at)


@dataclass(frozen=True)
class Chunk:
    """Where a chunk lies in the file, and which part of the data set it is."""

    place: tuple[int, ...]
    address: int
    size: int
    #: bit i: filter i was left out
    mask: int = 0


@dataclass
class Dataset:
    shape: tuple[int, ...] = ()
    kind: np.dtype | None = None
    layout: str = ""
    address: int = NOWHERE
    chunk: tuple[int, ...] = ()
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    fill: bytes | None = None
    inline: bytes = b""
    single: tuple[int, int] | None = None

    @property
    def block(self) -> tuple[int, ...]:
        """The part of the data that is read at once: a chunk; of contiguous data all of one place on the first axis."""
        return self.chunk or (1, *self.shape[1:])


class Hdf5File:
    """The groups and data sets of a file.  ``reads`` counts chunks that were read."""

    def __init__(self, path: str):
        self.path, self.read_at, self.reads = path, reader_of(path), 0
        self.base, self.root = self._superblock()

    def _bytes(self, at: int, size: int) -> bytes:
        data = self.read_at(self.base + at, size)
        if len(data) < size:
            raise Hdf5Error(f"{self.path}: the file ends before byte {at + size}")
        return data

    def _superblock(self) -> tuple[int, int]:
        self.base = 0
        for at in [0, *(512 << i for i in range(12))]:  # it may lie behind a user's block
            head = self.read_at(at, 9)
            if len(head) < 9:
                break
            if head[:8] == SIGNATURE:
                break
        else:
            head = b""
        if head[:8] != SIGNATURE:
            raise Hdf5Error(f"{self.path}: no HDF5 file")
        version = head[8]
        data = self.read_at(at, 104)
        sizes = data[13:15] if version < 2 else data[9:11]
        if tuple(sizes) != (8, 8):
            raise Hdf5Error(f"{self.path}: only offsets and lengths of 8 bytes are built in")
        if version < 2:
            first = 24 if version == 0 else 28
            (base,) = struct.unpack_from("<Q", data, first)
            _, root = struct.unpack_from("<QQ", data, first + 32)
        elif version in (2, 3):
            base, _, _, root = struct.unpack_from("<4Q", data, 12)
        else:
            raise Hdf5Error(f"{self.path}: superblock {version} isn't built in")
        return base, root

    # object headers

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """Type and data of each message of the object header at an address."""
        head = self._bytes(at, 16)
        if head[:4] == b"OHDR":
            flags = head[5]
            begin = 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self._bytes(at + begin, width), "little")
            parts, prefix = [self._bytes(at + begin + width, size)], 6 if flags & 4 else 4
            while parts:
                data, at = parts.pop(0), 0
                while at + prefix <= len(data):
                    kind, size, _ = struct.unpack_from("<BHB", data, at)
                    body = data[at + prefix : at + prefix + size]
                    at += prefix + size
                    if kind == CONTINUATION:
                        where, length = struct.unpack_from("<QQ", body)
                        parts.append(self._bytes(where + 4, length - 8))
                    else:
                        yield kind, body
        elif head[0] == 1:
            count, _, size = struct.unpack_from("<HII", head, 2)
            parts = [self._bytes(at + 16, size)]
            while parts and count:
                data, at = parts.pop(0), 0
                while at + 8 <= len(data) and count:
                    kind, size = struct.unpack_from("<HH", data, at)
                    body = data[at + 8 : at + 8 + size]
                    at += 8 + size
                    count -= 1
                    if kind == CONTINUATION:
                        where, length = struct.unpack_from("<QQ", body)
                        parts.append(self._bytes(where, length))
                    else:
                        yield kind, body
        else:
            raise Hdf5Error(f"{self.path}: no object header at {at}")

    # groups

    def links(self, at: int) -> dict[str, int | str]:
        """What a group holds: addresses, or the paths of soft links; nothing for a data set."""
        out: dict[str, int | str] = {}
        for kind, body in self.messages(at):
            if kind == SYMBOLS:
                tree, heap = struct.unpack_from("<QQ", body)
                names = self._heap(heap)
                for node in self._name_nodes(tree):
                    out |= self._symbols(node, names)
            elif kind == LINK:
                name, target = self._link(body)
                out[name] = target
            elif kind == LINK_INFO:
                (dense,) = struct.unpack_from("<Q", body, 10 if body[1] & 1 else 2)
                if dense != NOWHERE:
                    raise Hdf5Error(f"{self.path}: a group of links in a fractal heap isn't built in")
        return out

    def _heap(self, at: int) -> bytes:
        head = self._bytes(at, 32)
        if head[:4] != b"HEAP":
            raise Hdf5Error(f"{self.path}: no heap of names at {at}")
        size, _, data = struct.unpack_from("<QQQ", head, 8)
        return self._bytes(data, size)

    def _name_nodes(self, at: int) -> Iterator[int]:
        head = self._bytes(at, 24)
        if head[:5] != b"TREE\0":
            raise Hdf5Error(f"{self.path}: no tree of names at {at}")
        level, used = struct.unpack_from("<BH", head, 5)
        body = self._bytes(at + 24, 16 * used + 8)
        for i in range(used):
            (child,) = struct.unpack_from("<Q", body, 16 * i + 8)
            yield from self._name_nodes(child) if level else [child]

    def _symbols(self, at: int, names: bytes) -> dict[str, int | str]:
        head = self._bytes(at, 8)
        if head[:4] != b"SNOD":
            raise Hdf5Error(f"{self.path}: no node of names at {at}")
        (used,) = struct.unpack_from("<H", head, 6)
        body, out = self._bytes(at + 8, 40 * used), {}
        for i in range(used):
            name, header, cached, _, link = struct.unpack_from("<QQIII", body, 40 * i)
            out[_text(names, name)] = _text(names, link) if cached == 2 else header
        return out

    def _link(self, body: bytes) -> tuple[str, int | str]:
        flags, at, kind = body[1], 2, 0
        if flags & 8:
            kind, at = body[at], at + 1
        at += (8 if flags & 4 else 0) + (1 if flags & 0x10 else 0)
        width = 1 << (flags & 3)
        size = int.from_bytes(body[at : at + width], "little")
        at += width
        name, at = body[at : at + size].decode(), at + size
        if kind == 0:
            return name, struct.unpack_from("<Q", body, at)[0]
        (size,) = struct.unpack_from("<H", body, at)
        target = body[at + 2 : at + 2 + size]
        return name, target.decode() if kind == 1 else "external:" + target[1:].replace(b"\0", b":").decode()

    def address(self, path: str) -> int:
        """Address of the object at a path; soft links are followed."""
        at, here = self.root, ""
        for name in filter(None, path.split("/")):
            held = self.links(at)
            if name not in held:
                raise Hdf5Error(f"{self.path} has no {path!r}")
            target, here = held[name], f"{here}/{name}"
            for _ in range(16):
                if isinstance(target, int):
                    break
                if target.startswith("external:"):
                    raise Hdf5Error(f"{self.path}: {here} lies in another file; external links aren't built in")
                whole = target if target.startswith("/") else f"{here.rsplit('/', 1)[0]}/{target}"
                target = self.address(whole)
            at = target
        return at

    def members(self) -> dict[str, Any]:
        """Names of the file: groups are mappings, data sets None; links are followed where they lead somewhere."""

        def below(at: int, here: str, above: tuple[int, ...]) -> dict[str, Any] | None:
            kinds = {kind for kind, _ in self.messages(at)}
            if DATASPACE in kinds:
                return None
            out = {}
            for name, target in self.links(at).items():
                if isinstance(target, str):
                    try:
                        target = self.address(f"{here}/{name}")
                    except Hdf5Error:
                        continue
                if target not in above:
                    out[name] = below(target, f"{here}/{name}", (*above, target))
            return out

        return below(self.root, "", (self.root,)) or {}

    # data sets

    def dataset(self, path: str) -> Dataset:
        out = Dataset()
        for kind, body in self.messages(self.address(path)):
            if kind == DATASPACE:
                first = 8 if body[0] == 1 else 4
                out.shape = struct.unpack_from(f"<{body[1]}Q", body, first)
            elif kind == DATATYPE:
                out.kind = self._datatype(body)
            elif kind == LAYOUT:
                self._layout(body, out)
            elif kind == FILTERS:
                out.filters = self._filters(body)
            elif kind == FILL:
                out.fill = self._fill(body)
        if not out.layout:
            raise Hdf5Error(f"{self.path}: {path} is no data set")
        if out.kind is None:
            raise Hdf5Error(f"{self.path}: {path} holds no numbers")
        return out

    def _datatype(self, body: bytes) -> np.dtype | None:
        kind, (size,) = body[0] & 15, struct.unpack_from("<I", body, 4)
        order = ">" if body[1] & 1 else "<"
        if kind == 0 and size in (1, 2, 4, 8):
            return np.dtype(f"{order}{'i' if body[1] & 8 else 'u'}{size}")
        if kind == 1 and size in (2, 4, 8):
            return np.dtype(f"{order}f{size}")
        return None

    def _layout(self, body: bytes, out: Dataset) -> None:
        version, kind = body[0], body[1]
        if version == 4 and kind == 2:
            flags, rank, width = body[2], body[3], body[4]
            sizes = [int.from_bytes(body[5 + i * width : 5 + (i + 1) * width], "little") for i in range(rank)]
            at = 5 + rank * width
            index, at = body[at], at + 1
            if index != 1:
                raise Hdf5Error(f"{self.path}: chunk index {index} of layout 4 isn't built in; write the file for older readers, too")
            size, mask = int(np.prod(sizes)), 0
            if flags & 2:
                size, mask = struct.unpack_from("<QI", body, at)
                at += 12
            out.layout, out.chunk, out.single = "chunked", tuple(sizes[:-1]), (size, mask)
            (out.address,) = struct.unpack_from("<Q", body, at)
        elif version in (3, 4) and kind == 0:
            (size,) = struct.unpack_from("<H", body, 2)
            out.layout, out.inline = "compact", body[4 : 4 + size]
        elif version in (3, 4) and kind == 1:
            out.layout, out.address = "contiguous", struct.unpack_from("<Q", body, 2)[0]
        elif version == 3 and kind == 2:
            rank = body[2]
            (out.address,) = struct.unpack_from("<Q", body, 3)
            out.layout, out.chunk = "chunked", struct.unpack_from(f"<{rank}I", body, 11)[:-1]
        else:
            raise Hdf5Error(f"{self.path}: layout {version}, class {kind} isn't built in")

    def _filters(self, body: bytes) -> list[tuple[int, tuple[int, ...]]]:
        version, count = body[0], body[1]
        at, out = 8 if version == 1 else 2, []
        for _ in range(count):
            (number,) = struct.unpack_from("<H", body, at)
            at += 2
            length = 0
            if version == 1 or number >= 256:
                (length,) = struct.unpack_from("<H", body, at)
                at += 2
            _, n = struct.unpack_from("<HH", body, at)
            at += 4 + (-(-length // 8) * 8 if version == 1 else length)
            out.append((number, struct.unpack_from(f"<{n}I", body, at)))
            at += 4 * n + (4 if version == 1 and n % 2 else 0)
        known = {DEFLATE, SHUFFLE, FLETCHER32}
        if {number for number, _ in out} - known:
            raise Hdf5Error(f"{self.path}: filters {sorted({n for n, _ in out} - known)} aren't built in")
        return out

    def _fill(self, body: bytes) -> bytes | None:
        if body[0] == 3:
            defined, at = body[1] & 0x20, 2
        else:
            defined, at = body[3] or body[0] == 1, 4
        if not defined or len(body) < at + 4:
            return None
        (size,) = struct.unpack_from("<I", body, at)
        return body[at + 4 : at + 4 + size] or None

    def chunks(self, data: Dataset, low: tuple[int, ...] | None = None, high: tuple[int, ...] | None = None) -> list[Chunk]:
        """The stored chunks that meet a range, in order; subtrees that lie before or behind it on the first axis aren't read."""
        low, high = low or (0,) * len(data.shape), high or data.shape
        if data.layout == "contiguous":
            step = int(np.prod(data.shape[1:], dtype=np.int64)) * data.kind.itemsize
            whole = [] if data.address == NOWHERE else [Chunk((i, *[0] * (len(data.shape) - 1)), data.address + i * step, step) for i in range(low[0], high[0])]
            return whole
        if data.address == NOWHERE:
            return []
        if data.single is not None:
            return [Chunk((0,) * len(data.shape), data.address, *data.single)]
        return sorted(self._chunk_tree(data.address, data.chunk, low, high), key=lambda c: c.place)

    def _chunk_tree(self, at: int, sizes: tuple[int, ...], low: tuple[int, ...], high: tuple[int, ...]) -> Iterator[Chunk]:
        head = self._bytes(at, 24)
        if head[:5] != b"TREE\1":
            raise Hdf5Error(f"{self.path}: no tree of chunks at {at}")
        level, used = struct.unpack_from("<BH", head, 5)
        key = 8 + 8 * (len(sizes) + 1)
        body = self._bytes(at + 24, used * (key + 8) + key)
        for i in range(used):
            size, mask, *place, _ = struct.unpack_from(f"<II{len(sizes) + 1}Q", body, i * (key + 8))
            (child,) = struct.unpack_from("<Q", body, i * (key + 8) + key)
            if level:
                (following,) = struct.unpack_from("<Q", body, (i + 1) * (key + 8) + 8)
                if place[0] < high[0] and (following + sizes[0] > low[0] or i == used - 1):
                    yield from self._chunk_tree(child, sizes, low, high)
            elif all(p < h and p + s > lo for p, s, lo, h in zip(place, sizes, low, high, strict=True)):
                yield Chunk(tuple(place), child, size, mask)

    def block(self, data: Dataset, chunk: Chunk) -> np.ndarray:
        """The numbers of a chunk."""
        self.reads += 1
        raw = self._bytes(chunk.address, chunk.size)
        for i, (number, values) in reversed(list(enumerate(data.filters))):
            if chunk.mask >> i & 1:
                continue
            if number == DEFLATE:
                raw = zlib.decompress(raw)
            elif number == FLETCHER32:
                raw = raw[:-4]
            else:
                width = values[0] if values else data.kind.itemsize
                whole = len(raw) // width * width
                raw = np.frombuffer(raw, np.uint8, whole).reshape(width, -1).T.tobytes() + raw[whole:]
        return np.frombuffer(raw, data.kind, int(np.prod(data.block))).reshape(data.block)

    def read(self, data: Dataset, low: tuple[int, ...] | None = None, high: tuple[int, ...] | None = None, chunks: list[Chunk] | None = None) -> np.ndarray:
        """The numbers of a range; where no chunk is stored, the fill value."""
        low, high = low or (0,) * len(data.shape), high or data.shape
        shape = tuple(b - a for a, b in zip(low, high, strict=True))
        if data.layout == "compact":
            whole = np.frombuffer(data.inline, data.kind).reshape(data.shape)
            return whole[tuple(slice(a, b) for a, b in zip(low, high, strict=True))]
        out = np.full(shape, np.frombuffer(data.fill, data.kind)[0] if data.fill else 0, data.kind)
        if not shape:
            return np.frombuffer(self._bytes(data.address, data.kind.itemsize), data.kind).reshape(())
        if data.layout == "contiguous" and len(shape) == 1:
            if data.address == NOWHERE:
                return out
            raw = self._bytes(data.address + low[0] * data.kind.itemsize, shape[0] * data.kind.itemsize)
            return np.frombuffer(raw, data.kind)
        for chunk in self.chunks(data, low, high) if chunks is None else chunks:
            part = self._rows_of(data, chunk, low, high) if data.layout == "contiguous" else self.block(data, chunk)
            own = part.shape
            begin = chunk.place if data.layout != "contiguous" else (chunk.place[0], low[1], *chunk.place[2:])
            cut = [(max(p, lo), min(p + n, hi)) for p, n, lo, hi in zip(begin, own, low, high, strict=True)]
            if all(a < b for a, b in cut):
                to = tuple(slice(a - lo, b - lo) for (a, b), lo in zip(cut, low, strict=True))
                out[to] = part[tuple(slice(a - p, b - p) for (a, b), p in zip(cut, begin, strict=True))]
        return out

    def _rows_of(self, data: Dataset, chunk: Chunk, low: tuple[int, ...], high: tuple[int, ...]) -> np.ndarray:
        """Of contiguous data only the rows asked for are read."""
        self.reads += 1
        row = int(np.prod(data.shape[2:], dtype=np.int64)) * data.kind.itemsize
        raw = self._bytes(chunk.address + low[1] * row, (high[1] - low[1]) * row)
        return np.frombuffer(raw, data.kind).reshape(1, high[1] - low[1], *data.shape[2:])


def _text(data: bytes, at: int) -> str:
    return data[at : data.index(b"\0", at)].decode()


# writing


def pad8(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


#: Numbers that are written, and what describes them. Fixed values of the file format.
DATATYPES = {
    "<f4": b"\x11\x20\x1f\x00" + struct.pack("<IHHBBBBI", 4, 0, 32, 23, 8, 0, 23, 127),
    "<f8": b"\x11\x20\x3f\x00" + struct.pack("<IHHBBBBI", 8, 0, 64, 52, 11, 0, 52, 1023),
    "<i4": b"\x10\x08\x00\x00" + struct.pack("<IHH", 4, 0, 32),
    "<i8": b"\x10\x08\x00\x00" + struct.pack("<IHH", 8, 0, 64),
}


def encoded(block: np.ndarray, level: int) -> tuple[bytes, int]:
    """A chunk's bytes, shuffled and deflated, and the mask of left-out filters; as it is where that is no gain."""
    raw = np.ascontiguousarray(block).tobytes()
    if level:
        shuffled = np.frombuffer(raw, np.uint8).reshape(-1, block.dtype.itemsize).T.tobytes()
        small = zlib.compress(shuffled, level)
        if len(small) < len(raw):
            return small, 0
    return raw, 3 if level else 0


class Description:
    """What describes the data of a file, made for a place behind them; ``data`` is to be written there."""

    def __init__(self, at: int):
        self.at, self.data = at, bytearray()

    def put(self, data: bytes) -> int:
        where = self.at + len(self.data)
        self.data += pad8(data)
        return where

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHBxxx", kind, len(pad8(data)), 0) + pad8(data) for kind, data in messages)
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def group(self, members: dict[str, int]) -> int:
        """A group of at most eight members, by address."""
        if len(members) > 2 * LEAF_K:
            raise ValueError(f"a group is written with at most {2 * LEAF_K} members")
        names, places = bytearray(8), {}
        for name in sorted(members, key=str.encode):
            places[name] = len(names)
            names += pad8(name.encode() + b"\0")
        symbols = b"".join(struct.pack("<QQII16x", places[n], members[n], 0, 0) for n in places)
        node = self.put(b"SNOD" + struct.pack("<BxH", 1, len(members)) + symbols.ljust(40 * 2 * LEAF_K, b"\0"))
        heap_data = self.put(bytes(names))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, heap_data))
        last = max(places.values(), default=0)
        tree = b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, node, last)
        return self._header([(SYMBOLS, struct.pack("<QQ", self.put(tree.ljust(24 + 8 * (4 * GROUP_K + 1), b"\0")), heap))])

    def _described(self, shape: tuple[int, ...], datatype: bytes, layout: bytes, filters: bytes | None = None) -> int:
        space = struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)
        never_filled = bytes([2, 3, 1, 0])
        more = [(FILTERS, filters)] if filters else []
        return self._header([(DATASPACE, space), (DATATYPE, datatype), (FILL, never_filled), (LAYOUT, layout), *more])

    def array(self, values: np.ndarray) -> int:
        """A small data set with its numbers."""
        where = self.put(values.tobytes()) if values.size else NOWHERE
        return self._described(values.shape, DATATYPES[values.dtype.str], struct.pack("<BBQQ", 3, 1, where, values.nbytes))

    def text(self, value: str) -> int:
        data = value.encode() + b"\0"
        return self._described((), b"\x13\x00\x00\x00" + struct.pack("<I", len(data)), struct.pack("<BBQQ", 3, 1, self.put(data), len(data)))

    def volume(self, shape: tuple[int, ...], chunk: tuple[int, ...], kind: str, chunks: list[Chunk], level: int) -> int:
        """A chunked data set whose chunks lie where ``chunks`` says."""
        width = np.dtype(kind).itemsize
        filters = None
        if level:
            filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", SHUFFLE, 0, 1, 1, width) + struct.pack("<HHHHI4x", DEFLATE, 0, 1, 1, level)
        tree = self._chunk_tree(sorted(chunks, key=lambda c: c.place), chunk)
        layout = struct.pack("<BBBQ", 3, 2, len(shape) + 1, tree) + struct.pack(f"<{len(shape) + 1}I", *chunk, width)
        return self._described(shape, DATATYPES[kind], layout, filters)

    def _chunk_tree(self, chunks: list[Chunk], sizes: tuple[int, ...]) -> int:
        """Nodes of up to 64 children, level by level, each level's nodes side by side."""
        if not chunks:
            return NOWHERE

        def key(c: Chunk) -> bytes:
            return struct.pack(f"<II{len(sizes) + 1}Q", c.size, c.mask, *c.place, 0)

        room = 24 + 2 * CHUNK_K * 8 + (2 * CHUNK_K + 1) * len(key(chunks[0]))
        end = key(Chunk(tuple(p + s for p, s in zip(chunks[-1].place, sizes, strict=True)), 0, 0))
        children, level = [(key(c), c.address) for c in chunks], 0
        while True:
            runs = [children[i : i + 2 * CHUNK_K] for i in range(0, len(children), 2 * CHUNK_K)]
            first = self.at + len(self.data)
            step = len(pad8(bytes(room)))
            nodes = []
            for i, run in enumerate(runs):
                left = first + (i - 1) * step if i else NOWHERE
                right = first + (i + 1) * step if i + 1 < len(runs) else NOWHERE
                body = b"".join(k + struct.pack("<Q", address) for k, address in run) + (runs[i + 1][0][0] if i + 1 < len(runs) else end)
                node = b"TREE" + struct.pack("<BBHQQ", 1, level, len(run), left, right) + body
                nodes.append((run[0][0], self.put(node.ljust(room, b"\0"))))
            if len(nodes) == 1:
                return nodes[0][1]
            children, level = nodes, level + 1


def superblock(root: int, end: int) -> bytes:
    """The first bytes of a file whose root group is at an address."""
    head = SIGNATURE + struct.pack("<BBBBBBBxHHI", 0, 0, 0, 0, 0, 8, 8, LEAF_K, GROUP_K, 0)
    return head + struct.pack("<4Q", 0, NOWHERE, end, NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)


def nested(description: Description, tree: dict[str, Any]) -> int:
    """A group of groups (mappings) and data sets (addresses)."""
    return description.group({name: nested(description, below) if isinstance(below, dict) else below for name, below in tree.items()})


def with_path(tree: dict[str, Any], path: str, address: int) -> dict[str, Any]:
    """``tree`` with an address at a path."""
    name, _, rest = path.strip("/").partition("/")
    return tree | {name: with_path(tree.get(name, {}), rest, address) if rest else address}


def grid(shape: tuple[int, ...], chunk: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """The places of all chunks, in order."""
    return product(*(range(0, n, c) for n, c in zip(shape, chunk, strict=True)))
