"""HDF5 volumes as a Spark data source: detector lines in, detector lines out.

    spark.read.format("tomo_hdf5").option("data_path", "/entry/data/data").load(file)
    lines.write.format("tomo_hdf5").options(data_path="/data", shape="180,64,128").save(file)

Reading.  Rows are ``angle, det_y, image_key, line, degrees``.  A partition is a run of
frames with the addresses of the chunks it needs, so tasks read nothing but their chunks.  Options
give ranges of ``angles``, ``rows`` and ``columns`` and the image ``keys`` that are wanted; ``Volume``
sets them, and scans are opened with those of their preview.  A task holds one chunk's angles of
its rows.  Keys and angles, a number a frame, are read when the plan is made.

Filters aren't pushed to the source: Spark 4.1 keeps what is pushed with the table, so that two
scans of one table with different filters would read the same part.

Writing.  The volume's shape is known, so every chunk has a place of its own in the file, as
large as its numbers uncompressed.  Tasks write their chunks there, each into its own place, in a
file that isn't visible yet; deflated chunks leave the rest of their place unwritten, which
takes no room on the disk.  A task sends the driver places and sizes of its chunks; the driver
writes one index of all of them behind the data and gives the file its name.  A repeated task
writes the same bytes to the same places.  If the job fails, the file goes.  The rows of a chunk have to come
one after the other to one task: ``save_volume`` deals them so, in one exchange.  The folder
has to be mounted on driver and executors.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tomoflow.plans.model import Window
from tomoflow.sources import hdf5

FORMAT = "tomo_hdf5"
LINES = "angle int, det_y int, image_key int, line array<float>, degrees double"
#: Bytes of a partition's numbers.
PARTITION_BYTES = 64 << 20
#: Bytes before the first chunk.
FRONT = 4096


@dataclass
class Frames(InputPartition):
    """A run of frames: range of angles, and what of them is wanted."""

    start: int
    stop: int
    chunks: list[hdf5.Chunk]
    keys: list[int]
    degrees: list[float | None]


def _range(text: str | None, n: int) -> Window:
    """``start:stop`` as a range of an axis of n places; either may be left out."""
    start, _, stop = (text or ":").partition(":")
    low = min(n, max(0, int(start or 0)))
    return Window(low, max(low, min(n, int(stop or n))))


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.data_path = options["path"], options["data_path"]
        self.key_path, self.angle_path = options.get("image_key_path"), options.get("angles_path")
        file = hdf5.Hdf5File(self.path)
        self.data = file.dataset(self.data_path)
        if len(self.data.shape) != 3:
            raise hdf5.Hdf5Error(f"{self.path}: {self.data_path} has {len(self.data.shape)} axes, not 3")
        n, rows, width = self.data.shape
        self.angles, self.rows, self.columns = (_range(options.get(k), size) for k, size in (("angles", n), ("rows", rows), ("columns", width)))
        self.wanted_keys = {int(k) for k in options["keys"].split(",")} if "keys" in options else None

    def numbers(self, file: hdf5.Hdf5File, path: str | None) -> np.ndarray | None:
        if path is None:
            return None
        values = file.read(file.dataset(path)).ravel()
        if len(values) < self.data.shape[0]:
            raise hdf5.Hdf5Error(f"{self.path}: {path} has {len(values)} numbers for {self.data.shape[0]} frames")
        return values

    def partitions(self) -> list[Frames]:
        file, data = hdf5.Hdf5File(self.path), self.data
        keys, degrees = self.numbers(file, self.key_path), self.numbers(file, self.angle_path)
        a, y, x = self.angles, self.rows, self.columns
        if not (len(a) and len(y) and len(x)):
            return []
        low, high = (a.start, y.start, x.start), (a.stop, y.stop, x.stop)
        own = [0] * data.shape[0] if keys is None else keys.astype(int).tolist()
        deep = data.block[0]
        by_slab: dict[int, list[hdf5.Chunk]] = {}
        for chunk in file.chunks(data, low, high) if data.layout != "compact" else []:
            by_slab.setdefault(chunk.place[0] // deep, []).append(chunk)
        slab_bytes = 4 * deep * (y.stop - y.start) * (x.stop - x.start)
        step = max(1, PARTITION_BYTES // max(1, slab_bytes))
        slabs = [s for s in range(a.start // deep, -(-a.stop // deep)) if self._wanted(own, s, deep)]
        out = []
        for i in range(0, len(slabs), step):
            run = slabs[i : i + step]
            start, stop = max(a.start, run[0] * deep), min(a.stop, (run[-1] + 1) * deep)
            places = None if degrees is None else degrees[start:stop].astype(float).tolist()
            out.append(Frames(start, stop, [c for s in run for c in by_slab.get(s, [])], own[start:stop], places or [None] * (stop - start)))
        return out

    def _wanted(self, keys: list[int], slab: int, deep: int) -> bool:
        span = keys[max(self.angles.start, slab * deep) : min(self.angles.stop, (slab + 1) * deep)]
        return self.wanted_keys is None or bool(self.wanted_keys & set(span))

    def read(self, partition: Frames, file: hdf5.Hdf5File | None = None) -> Iterator[pa.RecordBatch]:
        file, data = file or hdf5.Hdf5File(self.path), self.data
        y, x, deep, tall = self.rows, self.columns, data.block[0], data.block[1]
        for slab in range(partition.start // deep, -(-partition.stop // deep)):
            first, last = max(partition.start, slab * deep), min(partition.stop, (slab + 1) * deep)
            frames = [f for f in range(first, last) if self.wanted_keys is None or partition.keys[f - partition.start] in self.wanted_keys]
            mine = [c for c in partition.chunks if c.place[0] // deep == slab] if frames else []
            for row in range(y.start // tall * tall, y.stop if frames else 0, tall):
                low, high = (first, max(y.start, row), x.start), (last, min(y.stop, row + tall), x.stop)
                near = [c for c in mine if c.place[1] < high[1] and c.place[1] + tall > low[1]]
                block = file.read(data, low, high, near).astype(np.float32)
                for frame in frames:
                    at = frame - partition.start
                    yield self._batch(frame, low[1], block[frame - first], partition.keys[at], partition.degrees[at])

    @staticmethod
    def _batch(frame: int, row: int, lines: np.ndarray, key: int, degrees: float | None) -> pa.RecordBatch:
        n, width = lines.shape
        values = pa.array(np.ascontiguousarray(lines).ravel())
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values)
        columns = [pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int32)), pa.array(np.full(n, key, np.int32)), arrays]
        return pa.RecordBatch.from_arrays([*columns, pa.array([degrees] * n, pa.float64())], ["angle", "det_y", "image_key", "line", "degrees"])


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its chunks, and the stored angle of their frames."""

    chunks: list[hdf5.Chunk] = field(default_factory=list)
    degrees: dict[int, float] = field(default_factory=dict)
    keys: dict[int, int] = field(default_factory=dict)


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        asked = tuple(int(n) for n in options["chunk"].split(",")) if "chunk" in options else (1, *self.shape[1:])
        self.chunk = tuple(max(1, min(c, n)) for c, n in zip(asked, self.shape, strict=True))
        if self.chunk[2] != max(1, self.shape[2]):
            raise ValueError("chunks hold whole lines")
        self.level, self.data_path = int(options.get("level", 0)), options.get("data_path", "/data")
        self.more = json.loads(options.get("more", "{}"))
        self.names, self.overwrite = names, overwrite
        target = hdf5.local_path(options["path"])
        if target is None:
            raise ValueError("HDF5 files are written to mounted folders only")
        if os.path.exists(target) and not overwrite:
            raise FileExistsError(f"{target} is there")
        self.target = target
        self.hidden = os.path.join(os.path.dirname(os.path.abspath(target)), f".{os.path.basename(target)}.{uuid.uuid4().hex}")
        os.makedirs(os.path.dirname(self.hidden), exist_ok=True)

    @property
    def _rooms(self) -> int:
        return -(-self.shape[1] // self.chunk[1])

    @property
    def _room(self) -> int:
        return 4 * int(np.prod(self.chunk)) + 7 & ~7

    def _place(self, block: tuple[int, int]) -> int:
        return FRONT + (block[0] * self._rooms + block[1]) * self._room

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, seen, block, held = Written(), set(), None, np.zeros(self.chunk, "<f4")
        deep, tall = self.chunk[:2]
        handle = os.open(self.hidden, os.O_WRONLY | os.O_CREAT, 0o644)

        def flush() -> None:
            if block is None:
                return
            if block in seen:
                raise ValueError("the rows of a chunk have to come one after the other; use save_volume")
            seen.add(block)
            data, mask = hdf5.encoded(held, self.level)
            at = self._place(block)
            while data:
                sent = os.pwrite(handle, data, at)
                data, at = data[sent:], at + sent
            size = at - self._place(block)
            done.chunks.append(hdf5.Chunk((block[0] * deep, block[1] * tall, 0), self._place(block), size, mask))
            held[:] = 0

        try:
            for batch in iterator:
                columns = {n: batch.column(i) for i, n in enumerate(self.names)}
                for i, (angle, row) in enumerate(zip(columns["angle"].to_pylist(), columns["det_y"].to_pylist(), strict=True)):
                    line = columns["line"][i].values.to_numpy(zero_copy_only=False)
                    if not (0 <= angle < self.shape[0] and 0 <= row < self.shape[1] and len(line) == self.shape[2]):
                        raise ValueError(f"line {row} of frame {angle} with {len(line)} values doesn't fit a volume of {self.shape}")
                    if block != (angle // deep, row // tall):
                        flush()
                        block = (angle // deep, row // tall)
                    held[angle % deep, row % tall] = line
                    for name, kept in (("degrees", done.degrees), ("image_key", done.keys)):
                        if name in columns and columns[name][i].is_valid:
                            kept[angle] = columns[name][i].as_py()
            flush()
            os.fsync(handle)
        finally:
            os.close(handle)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        chunks = [c for m in messages if m is not None for c in m.chunks]
        if len({c.place for c in chunks}) < len(chunks):
            self.abort(messages)
            raise ValueError("two tasks wrote the same chunk; use save_volume")
        rooms = -(-self.shape[0] // self.chunk[0]) * self._rooms
        description = hdf5.Description(FRONT + rooms * self._room)
        tree = hdf5.with_path({}, self.data_path, description.volume(self.shape, self.chunk, "<f4", chunks, self.level))
        degrees = {a: d for m in messages if m is not None for a, d in m.degrees.items()}
        keys = {a: k for m in messages if m is not None for a, k in m.keys.items()}
        if degrees and "angles_path" in self.more:
            values = np.array([degrees.get(a, np.nan) for a in range(self.shape[0])], "<f8")
            tree = hdf5.with_path(tree, self.more["angles_path"], description.array(values))
        if keys and "image_key_path" in self.more:
            tree = hdf5.with_path(tree, self.more["image_key_path"], description.array(np.array([keys.get(a, 0) for a in range(self.shape[0])], "<i4")))
        for path, text in self.more.get("texts", {}).items():
            tree = hdf5.with_path(tree, path, description.text(text))
        for path, values in self.more.get("numbers", {}).items():
            tree = hdf5.with_path(tree, path, description.array(np.array(values, "<i8")))
        root = hdf5.nested(description, tree)
        with open(os.open(self.hidden, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as file:
            file.seek(description.at)
            file.write(description.data)
            file.seek(0)
            file.write(hdf5.superblock(root, description.at + len(description.data)))
            file.flush()
            os.fsync(file.fileno())
        os.replace(self.hidden, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(self.hidden)


class Volumes(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options), schema.names, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the data source."""
    spark.dataSource.register(Volumes)
    return spark


@dataclass(frozen=True)
class Volume:
    """A volume of a file, of which parts can be read as lines."""

    spark: SparkSession
    path: str
    data_path: str
    image_key_path: str | None = None
    angles_path: str | None = None

    def reader(self, **options: str) -> VolumeReader:
        return VolumeReader({"path": self.path, **self._given(), **options})

    def _given(self) -> dict[str, str]:
        given = {"data_path": self.data_path, "image_key_path": self.image_key_path, "angles_path": self.angles_path}
        return {k: v for k, v in given.items() if v is not None}

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.reader().data.shape

    def frames(self) -> list[tuple[int, int, float | None]]:
        """Angle, image key and stored angle of every frame: numbers beside the data, which isn't read."""
        reader = self.reader()
        file, n = hdf5.Hdf5File(self.path), reader.data.shape[0]
        keys, degrees = reader.numbers(file, self.image_key_path), reader.numbers(file, self.angles_path)
        return [(i, 0 if keys is None else int(keys[i]), None if degrees is None else float(degrees[i])) for i in range(n)]

    def lines(self, key: int | None = None, angles: Window | None = None, rows: Window | None = None, columns: Window | None = None) -> DataFrame:
        """angle, det_y, image_key, line, degrees of a part; columns cut the lines."""
        ranges = {k: f"{w.start}:{w.stop}" for k, w in (("angles", angles), ("rows", rows), ("columns", columns)) if w is not None}
        keys = {} if key is None else {"keys": str(key)}
        return registered(self.spark).read.format(FORMAT).options(**self._given(), **ranges, **keys).load(self.path)


def read_volume(spark: SparkSession, path: str, data_path: str, image_key_path: str | None = None, angles_path: str | None = None) -> DataFrame:
    """All lines of an HDF5 volume: angle, det_y, image_key, line, degrees."""
    return Volume(spark, path, data_path, image_key_path, angles_path).lines()


#: Bytes of a chunk that is made where none is asked for.
CHUNK_BYTES = 4 << 20


def chunk_for(shape: tuple[int, int, int], pattern: str = "projection", chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int, int]:
    """A chunk of about ``chunk_bytes`` that suits reading by projection or by sinogram: whole lines, most of them of one frame."""
    n, rows, width = (max(1, s) for s in shape)
    lines = max(1, chunk_bytes // (4 * width))
    if pattern == "sinogram":
        deep = min(n, lines)
        return deep, min(rows, max(1, lines // deep)), width
    tall = min(rows, lines)
    return min(n, max(1, lines // tall)), tall, width


def save_volume(
    lines: DataFrame,
    shape: tuple[int, int, int],
    path: str,
    data_path: str = "/data",
    chunk: tuple[int, int, int] | None = None,
    level: int = 0,
    mode: str = "overwrite",
    **more: Any,
) -> None:
    """Lines (and ``degrees``, ``image_key``, if there) as one volume; one exchange brings the lines of a chunk together.

    ``more``: ``angles_path`` and ``image_key_path`` for these columns, ``texts`` and
    ``numbers`` by path.
    """
    chunk = tuple(max(1, min(c, s)) for c, s in zip(chunk or chunk_for(shape), shape, strict=True))
    kept = [c for c in ("degrees", "image_key") if c in lines.columns]
    rows = lines.select(F.col("angle").cast("int").alias("angle"), F.col("det_y").cast("int").alias("det_y"), F.col("line").cast("array<float>").alias("line"), *kept)
    slab, part = F.expr(f"angle div {chunk[0]}"), F.expr(f"det_y div {chunk[1]}")
    dealt = rows.repartition(slab, part).sortWithinPartitions(slab, part, "angle", "det_y")
    given = {"data_path": data_path, "shape": ",".join(map(str, shape)), "chunk": ",".join(map(str, chunk)), "level": str(level), "more": json.dumps(more)}
    registered(lines.sparkSession)
    dealt.write.format(FORMAT).options(**given).mode(mode).save(path)
