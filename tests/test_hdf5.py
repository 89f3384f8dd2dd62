"""HDF5 volumes: files put together here byte by byte, files written by tasks, what a preview reads."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoflow.sources import declared, hdf5, volumes
from tomoflow.sources.scan import hdf5_members, nexus_paths

NOWHERE = 2**64 - 1


class Bytes:
    """A file put together by hand, in forms that the library itself doesn't write."""

    def __init__(self, front=64):
        self.data = bytearray(front)

    def put(self, data):
        at = len(self.data)
        self.data += data
        return at

    def header(self, *messages, split=False):
        """Object header 2, its last message in a continuation if asked for."""

        def one(kind, body):
            return struct.pack("<BHB", kind, len(body), 0) + body

        own = list(messages)
        if split:
            block = b"OCHK" + one(*own.pop()) + b"sums"
            own.append((0x10, struct.pack("<QQ", self.put(block), len(block))))
        body = b"".join(one(*m) for m in own)
        return self.put(b"OHDR" + struct.pack("<BBH", 2, 1, len(body)) + body + b"sums")

    def close(self, path, root):
        self.data[:48] = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + struct.pack("<4Q", 0, NOWHERE, len(self.data), root) + b"sums"
        path.write_bytes(self.data)
        return str(path)


def space(*shape):
    return 0x1, struct.pack("<BBBB", 2, len(shape), 0, 1) + struct.pack(f"<{len(shape)}Q", *shape)


def hard(name, address):
    return 0x6, struct.pack("<BBB", 1, 0, len(name)) + name.encode() + struct.pack("<Q", address)


def soft(name, target):
    return 0x6, struct.pack("<BBBB", 1, 8, 1, len(name)) + name.encode() + struct.pack("<H", len(target)) + target.encode()


BIG_U2 = 0x3, bytes([0x10, 1, 0, 0]) + struct.pack("<IHH", 2, 0, 16)
F8 = 0x3, bytes([0x11, 0x20, 0x3F, 0]) + struct.pack("<IHHBBBBI", 8, 0, 64, 52, 11, 0, 52, 1023)


@pytest.fixture
def foreign(tmp_path):
    """Big-endian numbers in chunks of 2 x 3 x 4 behind a tree of two levels, shuffled, deflated, with check sums; one chunk is
    stored as it is and one isn't there."""
    data = np.random.default_rng(1).integers(0, 1000, size=(5, 7, 8)).astype(">u2")
    file, entries = Bytes(), []
    for a in range(0, 6, 2):
        for y in range(0, 9, 3):
            for x in (0, 4):
                block = np.zeros((2, 3, 4), ">u2")
                part = data[a : a + 2, y : y + 3, x : x + 4]
                block[tuple(slice(n) for n in part.shape)] = part
                raw, mask = block.tobytes(), 0
                if (a, y, x) == (2, 3, 4):
                    data[2:4, 3:6, 4:8] = 77
                    continue
                if (a, y, x) == (0, 0, 0):
                    mask = 0b11
                else:
                    raw = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, 2).T.tobytes())
                raw += b"sums"
                entries.append((struct.pack("<II4Q", len(raw), mask, a, y, x, 0), file.put(raw)))

    def node(level, children, end):
        body = b"".join(k + struct.pack("<Q", at) for k, at in children) + end
        return children[0][0], file.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(children), NOWHERE, NOWHERE) + body)

    runs = [entries[i : i + 6] for i in range(0, len(entries), 6)]
    ends = [*(r[0][0] for r in runs[1:]), struct.pack("<II4Q", 0, 0, 6, 0, 0, 0)]
    _, tree = node(1, [node(0, r, e) for r, e in zip(runs, ends, strict=True)], ends[-1])
    layout = 0x8, struct.pack("<BBBQ4I", 3, 2, 4, tree, 2, 3, 4, 2)
    filters = 0xB, struct.pack("<BB", 2, 3) + struct.pack("<HHHI", 2, 1, 1, 2) + struct.pack("<HHHI", 1, 1, 1, 6) + struct.pack("<HHH", 3, 0, 0)
    fill = 0x5, struct.pack("<BBI", 3, 0x20, 2) + (77).to_bytes(2, "big")
    volume = file.header(space(5, 7, 8), BIG_U2, fill, filters, layout, split=True)
    plain = data.astype("<f8")
    raw = file.put(plain.tobytes())
    contiguous = file.header(space(5, 7, 8), F8, (0x8, struct.pack("<BBQQ", 3, 1, raw, plain.nbytes)))
    keys = file.header(space(5), BIG_U2, (0x8, struct.pack("<BBH", 3, 0, 10) + np.array([1, 0, 0, 2, 0], ">u2").tobytes()))
    angles = np.arange(5) * 1.5
    turned = file.header(space(5), F8, (0x8, struct.pack("<BBQQ", 3, 1, file.put(angles.tobytes()), 40)))
    text = 0x3, bytes([0x13, 0, 0, 0]) + struct.pack("<I", 7)
    named = file.header((0x1, bytes([2, 0, 0, 0])), text, (0x8, struct.pack("<BBH", 3, 0, 7) + b"NXtomo\0"))
    detector = file.header(hard("frames", volume), hard("image_key", keys))
    instrument = file.header(hard("detector", detector))
    shown = file.header(soft("data", "/scan/instrument/detector/frames"), hard("rotation_angle", turned), hard("whole", contiguous))
    entry = file.header(hard("definition", named), hard("instrument", instrument), hard("data", shown), soft("nothing", "nowhere"))
    return file.close(tmp_path / "foreign.nxs", file.header(hard("scan", entry))), data


def test_a_foreign_file(foreign):
    path, data = foreign
    file = hdf5.Hdf5File(path)
    assert hdf5_members(path) == {
        "scan": {"definition": None, "instrument": {"detector": {"frames": None, "image_key": None}}, "data": {"data": None, "rotation_angle": None, "whole": None}}
    }
    for name in ("data", "whole"):
        found = file.dataset(f"/scan/data/{name}")
        assert (file.read(found) == data).all()
        assert (file.read(found, (1, 2, 3), (4, 6, 7)) == data[1:4, 2:6, 3:7]).all()
    assert file.read(file.dataset("scan/instrument/detector/image_key")).tolist() == [1, 0, 0, 2, 0]
    with pytest.raises(hdf5.Hdf5Error, match="no numbers"):
        file.dataset("/scan/definition")
    with pytest.raises(hdf5.Hdf5Error, match="'/scan/absent'"):
        file.dataset("/scan/absent")


def test_foreign_files_open_as_scans(spark, foreign):
    path, data = foreign
    given = {"data_path": "auto", "image_key_path": "auto", "rotation_angles": "auto"}
    scan = declared.load(spark, path, given)
    assert scan.shape == (3, 7, 8)
    assert {(r.angle, r.det_y): r.line for r in scan.lines.collect()} == {(i, y): data[a, y].tolist() for i, a in enumerate([1, 2, 4]) for y in range(7)}
    assert [round(np.degrees(r.theta), 9) for r in scan.angles.orderBy("angle").collect()] == [1.5, 3.0, 6.0]
    assert sorted((r.det_y, r.line) for r in scan.darks.collect()) == [(y, data[3, y].tolist()) for y in range(7)]
    assert declared.contents(spark, path)[-1] == "auto" and "/scan/data/whole" in declared.contents(spark, path)


def chunks_read(reader):
    """The numbers a reader gives, and how many chunks its tasks have read."""
    file, rows = hdf5.Hdf5File(reader.path), []
    for part in reader.partitions():
        for batch in reader.read(part, file):
            rows += [(r["angle"], r["det_y"], r["line"]) for r in batch.to_pylist()]
    return rows, file.reads


def test_previews_read_fewer_chunks(foreign):
    path, data = foreign
    options = {"path": path, "data_path": "scan/data/data", "image_key_path": "scan/instrument/detector/image_key"}
    rows, whole = chunks_read(volumes.VolumeReader(options))
    assert len(rows) == 35 and whole == 17
    rows, reads = chunks_read(volumes.VolumeReader(options | {"angles": "2:", "rows": ":3"}))
    assert sorted(r[:2] for r in rows) == [(a, y) for a in (2, 3, 4) for y in range(3)] and reads == 4
    assert all(line == data[a, y].tolist() for a, y, line in rows)
    rows, reads = chunks_read(volumes.VolumeReader(options | {"columns": "5:8", "keys": "2"}))
    assert sorted(rows) == [(3, y, data[3, y, 5:].tolist()) for y in range(7)] and reads == 2  # the third isn't stored
    for nothing in ({"keys": "7"}, {"angles": "9:12"}, {"rows": "4:4"}):
        assert chunks_read(volumes.VolumeReader(options | nothing)) == ([], 0)


def test_contiguous_rows_are_read_alone(foreign):
    reader = volumes.VolumeReader({"path": foreign[0], "data_path": "scan/data/whole", "rows": "4:5", "angles": "2:3"})
    (part,), file, asked = reader.partitions(), hdf5.Hdf5File(foreign[0]), []
    inner = file.read_at
    file.read_at = lambda at, size: asked.append(size) or inner(at, size)
    assert sum(b.num_rows for b in reader.read(part, file)) == 1 and asked == [64]


def test_scans_of_a_preview_read_its_chunks_only(spark, tmp_path):
    """All chunks but those of the preview are spoiled, and nothing fails."""
    path = tmp_path / "v.h5"
    whole = np.round(VOLUME)
    keyed = lines(spark, whole).withColumn("image_key", F.when(F.col("angle") >= 140, 3 - F.col("angle") % 2).otherwise(0) % 3)
    volumes.save_volume(keyed, VOLUME.shape, str(path), "/d", (5, 3, 5), 1, image_key_path="/k", angles_path="/a")
    file, data = hdf5.Hdf5File(str(path)), bytearray(path.read_bytes())
    for chunk in file.chunks(file.dataset("/d")):
        if chunk.place[0] not in (10, 15, 140, 145) or chunk.place[1]:
            data[chunk.address : chunk.address + chunk.size] = b"x" * chunk.size
    path.write_bytes(data)
    given = {"data_path": "/d", "image_key_path": "/k", "rotation_angles": {"data_path": "/a"}}
    preview = {"angles": {"start": 12, "stop": 17}, "detector_y": {"start": 0, "stop": 3}, "detector_x": {"start": 1}}
    scan = declared.load(spark, str(path), given | {"darks": "ignore", "preview": preview})
    assert scan.shape == (5, 3, 4)
    assert {(r.angle, r.det_y): r.line for r in scan.lines.collect()} == {(a, y): whole[a + 12, y, 1:].tolist() for a in range(5) for y in range(3)}
    with pytest.raises(Exception, match="decompress"):
        declared.load(spark, str(path), given | {"darks": "ignore"}).lines.collect()


VOLUME = np.random.default_rng(5).normal(size=(150, 6, 5)).astype(np.float32)


def lines(spark, data=VOLUME, parts=4):
    rows = [(a, y, [float(v) for v in data[a, y]], a * 0.5, a % 3) for a in range(len(data)) for y in range(data.shape[1])]
    return spark.createDataFrame(rows, "angle int, det_y int, line array<float>, degrees double, image_key int").repartition(parts)


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("chunk", [None, (1, 4, 5), (7, 6, 5), (200, 1, 5)])
def test_written_volumes(spark, tmp_path, chunk, level):
    path = str(tmp_path / "v.h5")
    volumes.save_volume(lines(spark), VOLUME.shape, path, "/e/data", chunk, level, angles_path="/e/angle", image_key_path="/e/key", numbers={"/data_dims/detector_x_y": [5, 6]})
    file = hdf5.Hdf5File(path)
    assert (file.read(file.dataset("/e/data")) == VOLUME).all()
    assert file.read(file.dataset("/e/angle")).tolist() == [a * 0.5 for a in range(150)]
    assert file.read(file.dataset("/data_dims/detector_x_y")).tolist() == [5, 6]
    got = volumes.read_volume(spark, path, "/e/data", "/e/key", "/e/angle").where("angle >= 100 AND det_y = 2 AND image_key = 1").collect()
    assert sorted((r.angle, r.det_y, r.image_key, r.degrees) for r in got) == [(a, 2, 1, a * 0.5) for a in range(100, 150) if a % 3 == 1]
    assert all(r.line == VOLUME[r.angle, 2].tolist() for r in got)
    assert os.listdir(tmp_path) == ["v.h5"]


def test_two_scans_of_a_file_are_two(spark, tmp_path):
    path = str(tmp_path / "v.h5")
    volumes.save_volume(lines(spark), VOLUME.shape, path, image_key_path="/key")
    table = volumes.read_volume(spark, path, "/data", "/key")
    counts = [table.where(f"image_key = {k}").groupBy("det_y").count().withColumnRenamed("count", f"n{k}") for k in (0, 1)]
    firsts = [table.where(f"image_key = {k}").groupBy("det_y").agg({"angle": "min"}).withColumnRenamed("min(angle)", f"a{k}") for k in (0, 1)]
    both = counts[0].join(counts[1], "det_y").join(firsts[0], "det_y").join(firsts[1], "det_y")
    assert {tuple(r)[1:] for r in both.collect()} == {(50, 50, 0, 1)}


def test_numbers_that_pack_well_take_little_room(spark, tmp_path):
    flat = np.zeros((20, 64, 256), np.float32)
    path = str(tmp_path / "v.h5")
    volumes.save_volume(lines(spark, flat), flat.shape, path, level=6)
    assert os.stat(path).st_blocks * 512 < flat.nbytes / 3
    file = hdf5.Hdf5File(path)
    assert not file.read(file.dataset("/data")).any()


def test_missing_and_wrong_lines(spark, tmp_path):
    path = str(tmp_path / "v.h5")
    volumes.save_volume(lines(spark).where("angle <> 7 AND det_y < 5"), VOLUME.shape, path, chunk=(1, 6, 5))
    file = hdf5.Hdf5File(path)
    want = VOLUME.copy()
    want[7], want[:, 5] = 0, 0
    assert (file.read(file.dataset("/data")) == want).all()
    volumes.save_volume(lines(spark).where("false"), VOLUME.shape, str(tmp_path / "empty.h5"))
    assert volumes.read_volume(spark, str(tmp_path / "empty.h5"), "/data").where("array_max(line) <> 0").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "v.h5"
    with pytest.raises(Exception, match="doesn't fit"):
        volumes.save_volume(lines(spark), (150, 5, 5), str(path))
    assert os.listdir(tmp_path) == []
    volumes.save_volume(lines(spark), VOLUME.shape, str(path))
    before = path.read_bytes()
    with pytest.raises(Exception, match="doesn't fit"):
        volumes.save_volume(lines(spark), (100, 6, 5), str(path))
    assert os.listdir(tmp_path) == ["v.h5"] and path.read_bytes() == before
    with pytest.raises(Exception, match="is there"):
        volumes.save_volume(lines(spark), VOLUME.shape, str(path), mode="append")
    dealt = volumes.registered(spark) and lines(spark, parts=9)
    with pytest.raises(Exception, match="save_volume"):
        dealt.write.format(volumes.FORMAT).options(shape="150,6,5", chunk="50,6,5").mode("overwrite").save(str(tmp_path / "w.h5"))
    assert os.listdir(tmp_path) == ["v.h5"]


def test_what_is_no_file_of_this_kind(tmp_path, foreign):
    (tmp_path / "x.h5").write_bytes(b"no such file" * 99)
    with pytest.raises(hdf5.Hdf5Error, match="no HDF5 file"):
        hdf5.Hdf5File(str(tmp_path / "x.h5"))
    data = open(foreign[0], "rb").read()
    (tmp_path / "short.h5").write_bytes(data[:-60])
    with pytest.raises(hdf5.Hdf5Error, match="ends before"):
        hdf5.Hdf5File(str(tmp_path / "short.h5")).members()


def test_groups_around_a_definition():
    assert nexus_paths({"a": {"b": {"definition": None}}, "definition": None}) == ""
    assert nexus_paths({"x": {"y": None}, "a": {"b": {"definition": None}, "definition": None}}) == "/a"
    assert nexus_paths({"ab": {"definition": None}, "a": {"definition": None}}) == "/ab"


def test_chunks_for_a_pattern():
    assert volumes.chunk_for((1800, 2160, 2560)) == (1, 409, 2560)
    assert volumes.chunk_for((1800, 2160, 2560), "sinogram") == (409, 1, 2560)
    assert volumes.chunk_for((10, 4, 8)) == (10, 4, 8) and volumes.chunk_for((0, 0, 0)) == (1, 1, 1)
