"""What is known of each method: its pattern, halo, parameters and implementation.

A method is a DataFrame function ``apply(scan, **parameters)`` of a ``Scan``, or a plain
Python function of one frame (an array), which runs frame by frame in Arrow batches.
Own methods are added with ``register``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

REQUIRED = "REQUIRED"


@dataclass(frozen=True)
class Method:
    name: str
    pattern: str = "all"
    apply: Callable | None = None
    frame: Callable | None = None
    #: parameters with their defaults; REQUIRED where there is none
    parameters: dict[str, Any] = field(default_factory=dict)
    #: halo before and after, from the parameters
    halo: Callable[[dict], tuple[int, int]] = lambda parameters: (0, 0)
    save_default: bool = False
    swaps_axes: bool = False
    #: names of the values it publishes
    publishes: tuple[str, ...] = ()
    #: bytes a slice needs, as a multiple of its own size
    memory_factor: float = 2.0
    any_parameter: bool = False

    def padding(self, parameters: dict) -> tuple[int, int]:
        return self.halo({**self.parameters, **parameters})


METHODS: dict[str, Method] = {}


def register(method: Method) -> Method:
    METHODS[method.name] = method
    return method


def spec(name: str) -> Method:
    """What is known of a method; unknown ones fit any pattern and have no halo."""
    _load()
    return METHODS.get(name, Method(name, any_parameter=True))


def known(name: str) -> bool:
    _load()
    return name in METHODS


def _load() -> None:
    if not METHODS:
        from tomoflow import builtin

        builtin.register_all()


def bind(function: Callable, given: dict[str, Any], context: dict[str, Any], pattern: str) -> dict[str, Any]:
    """Arguments of ``function`` after its first: context first, then what is given, then defaults.

    ``axis: auto`` becomes the axis of the pattern.  Unknown names and missing values
    raise ValueError.
    """
    signature = inspect.signature(function).parameters
    names = list(signature)[1:]
    takes_any = any(p.kind is inspect.Parameter.VAR_KEYWORD for p in signature.values())
    unknown = set(given) - set(names)
    if unknown and not takes_any:
        raise ValueError(f"{function.__name__} has no parameter {', '.join(sorted(unknown))}")
    out = {}
    for name in names:
        parameter = signature[name]
        if parameter.kind in (inspect.Parameter.VAR_KEYWORD, inspect.Parameter.VAR_POSITIONAL):
            continue
        if name in context:
            out[name] = context[name]
        elif name == "axis" and given.get(name, "auto") == "auto":
            out[name] = 1 if pattern == "sinogram" else 0
        elif name in given:
            out[name] = given[name]
        elif parameter.default is inspect.Parameter.empty:
            raise ValueError(f"{function.__name__} needs a value for {name}")
    if takes_any:
        out |= {k: v for k, v in given.items() if k in unknown}
    return out
