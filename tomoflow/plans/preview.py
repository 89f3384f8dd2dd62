"""Loader parameters: previews, subsets, rotation angles, calibration frames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from tomoflow.plans.model import Preview, Window

AXES = ("angles", "detector_y", "detector_x")


def middle(length: int) -> tuple[int, int]:
    """The slices that ``mid`` stands for.

    Axes of two or three slices are taken whole, an axis of one slice, too.
    """
    if length < 4:
        return 0, length
    half = length // 2
    return (half - 2, half + 1) if length % 2 == 0 else (half - 1, half + 1)


def keyword(value: int | str | None, length: int, default: int) -> int:
    """An index, or what ``begin``, ``mid`` or ``end`` stand for."""
    if value is None:
        return default
    if not isinstance(value, str):
        return int(value)
    places = {"begin": 0, "mid": sum(middle(length)) // 2, "end": length}
    if value not in places:
        raise ValueError(f"unknown keyword {value!r}; there are {', '.join(places)}")
    return places[value]


def moved(index: int, offset: int, length: int) -> int:
    """The index moved by its offset; a move beyond the axis stops at its end."""
    if offset > 0:
        return min(length, index + offset)
    if offset < 0:
        return max(0, index + offset)
    return index


def window(entry: dict | str | None, length: int) -> Window:
    if entry is None:
        return Window(0, length)
    if entry == "mid":
        return Window(*middle(length))
    if isinstance(entry, str):
        raise ValueError(f"a preview axis is 'mid' or has start and stop, not {entry!r}")
    start = moved(keyword(entry.get("start"), length, 0), entry.get("start_offset") or 0, length)
    stop = moved(keyword(entry.get("stop"), length, length), entry.get("stop_offset") or 0, length)
    return Window(start, stop)


def parse_preview(entry: dict[str, Any] | None, shape: tuple[int, int, int]) -> Preview:
    """The preview of a loader's parameter, checked against the data's shape."""
    entry = entry or {}
    if entry.get("angles") == "mid":
        raise ValueError("'mid' is not supported for angles")
    unknown = set(entry) - set(AXES)
    if unknown:
        raise ValueError(f"unknown preview axes: {', '.join(sorted(unknown))}")
    return checked(Preview(*(window(entry.get(axis), n) for axis, n in zip(AXES, shape, strict=True))), shape)


def checked(preview: Preview, shape: tuple[int, int, int]) -> Preview:
    for axis, n in zip(AXES, shape, strict=True):
        w = getattr(preview, axis)
        if w.stop <= w.start:
            raise ValueError(f"{axis}: stop {w.stop} is not above start {w.start}")
        if w.start < 0 or w.stop > n:
            raise ValueError(f"{axis}: {w.start}..{w.stop} is outside of 0..{n}")
    return preview


def continuous_subset(preview: Preview, subset: dict[str, int] | None) -> Preview:
    """The subset of a continuous scan replaces the range of angles."""
    return preview if subset is None else replace(preview, angles=Window(subset["start"], subset["stop"]))


def sweep_preview(preview: Preview, raw_rows: int, rows: int = 5) -> Preview:
    """Few detector rows around the middle of the preview, for a sweep."""
    if raw_rows < rows:
        raise ValueError(f"a sweep needs {rows} detector rows; the data has {raw_rows}")
    w = preview.detector_y
    half, reach = len(w) // 2, rows // 2
    start, stop = w.start + half - reach, w.stop - half + reach
    return replace(preview, detector_y=Window(max(0, start), stop if stop < raw_rows else raw_rows))


@dataclass(frozen=True)
class UserAngles:
    """Evenly spaced angles in degrees, both ends included."""

    start: float
    stop: float
    n: int


@dataclass(frozen=True)
class StoredAngles:
    """Angles in degrees under a path of the input."""

    path: str


def parse_angles(entry: dict[str, Any]) -> UserAngles | StoredAngles:
    if "data_path" in entry:
        return StoredAngles(entry["data_path"])
    if "user_defined" in entry:
        given = entry["user_defined"]
        return UserAngles(given["start_angle"], given["stop_angle"], given["angles_total"])
    raise ValueError("rotation angles need 'data_path' or 'user_defined'")


@dataclass(frozen=True)
class Frames:
    """Where frames of one kind lie; without an image key all frames there count."""

    file: str
    path: str
    image_key: str | None = None


def parse_frames(entry: dict[str, Any] | str | None, default: Frames) -> Frames | None:
    """Calibration frames of a loader's parameter; None where they are to be ignored."""
    if entry is None:
        return default
    if entry == "ignore":
        return None
    file = entry.get("file") or entry.get("input_data")
    if file is None:
        raise ValueError("calibration frames need 'file'")
    return Frames(str(file), entry.get("data_path", default.path), entry.get("image_key_path"))


def calibration_plan(darks: Frames | None, flats: Frames | None) -> tuple[str, str]:
    """How darks and flats are read: ``dummy``, ``separate`` or ``together``."""
    if darks is None or flats is None:
        read = ("dummy" if darks is None else "separate", "dummy" if flats is None else "separate")
        alone = darks or flats
        if alone is not None and alone.image_key is None and alone.file == "":
            raise ValueError("without an image key all frames of the scan would count as calibration")
        return read
    if (darks.path, darks.file) != (flats.path, flats.file):
        return "separate", "separate"
    return "together", "together"


def distortion_coefficients(text: str) -> tuple[float, float, list[float]]:
    """xcenter, ycenter and factors: the last token of each line."""
    values = [float(line.split()[-1]) for line in text.splitlines() if line.strip()]
    if len(values) < 3:
        raise ValueError("distortion coefficients: two centres and at least one factor are needed")
    return values[0], values[1], values[2:]
