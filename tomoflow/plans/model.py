"""The pipeline as plain immutable data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

PATTERNS = ("projection", "sinogram", "all")
#: The axis along which a pattern's frames are cut: 0 angle, 1 detector row.
AXIS = {"projection": 0, "sinogram": 1}


@dataclass(frozen=True)
class Sweep:
    """A parameter that takes several values, one after the other."""

    values: tuple


@dataclass(frozen=True)
class Ref:
    """The value a step before publishes under a name."""

    step: str
    name: str


@dataclass(frozen=True)
class Window:
    """Half-open range of an axis."""

    start: int
    stop: int

    def __len__(self) -> int:
        return self.stop - self.start


@dataclass(frozen=True)
class Preview:
    angles: Window
    detector_y: Window
    detector_x: Window

    @property
    def shape(self) -> tuple[int, int, int]:
        return len(self.angles), len(self.detector_y), len(self.detector_x)


@dataclass(frozen=True)
class Step:
    method: str
    module: str
    parameters: dict[str, Any] = field(default_factory=dict)
    id: str | None = None
    side_outputs: dict[str, str] = field(default_factory=dict)
    save_result: bool = False
    pattern: str = "all"
    padded: tuple[int, int] = (0, 0)

    @property
    def sweep(self) -> tuple[str, Sweep] | None:
        """Name and values of the step's sweep."""
        return next(((k, v) for k, v in self.parameters.items() if isinstance(v, Sweep)), None)

    def given(self, **parameters) -> Step:
        return replace(self, parameters=self.parameters | parameters)


@dataclass(frozen=True)
class Pipeline:
    loader: Step
    steps: tuple[Step, ...]

    @property
    def sweeps(self) -> list[Step]:
        return [s for s in self.steps if s.sweep]


@dataclass(frozen=True)
class Stage:
    """Steps that run without a barrier, over frames of one pattern."""

    pattern: str
    steps: tuple[Step, ...]
    padding: tuple[int, int] = (0, 0)
    last: bool = False
