"""Pipelines from YAML and JSON text."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

import yaml

from tomoflow.functions.numbers import arange
from tomoflow.plans.model import Pipeline, Ref, Step, Sweep

REFERENCE = re.compile(r"^\$\{\{([A-Za-z0-9_.]+)\}\}$")


class PipelineError(ValueError):
    """A pipeline that can't be built."""


class Loader(yaml.SafeLoader):
    """YAML with sweeps, which refuses keys given twice."""

    def construct_mapping(self, node, deep=False):
        seen = set()
        for key_node, _ in node.value:
            key = self.construct_object(key_node, deep=True)
            if key in seen:
                raise PipelineError(f"key {key!r} is given twice (line {key_node.start_mark.line + 1})")
            seen.add(key)
        return super().construct_mapping(node, deep)


def _manual(loader: Loader, node) -> Sweep:
    return Sweep(tuple(loader.construct_sequence(node, deep=True)))


def _range(loader: Loader, node) -> Sweep:
    given = loader.construct_mapping(node, deep=True)
    return Sweep(tuple(arange(given["start"], given["stop"], given["step"])))


Loader.add_constructor("!Sweep", _manual)
Loader.add_constructor("!SweepRange", _range)


def read_text(pipeline: str | Path) -> tuple[str, str]:
    """Text and format of a pipeline given as a path or as text."""
    if isinstance(pipeline, Path) or pipeline.strip().endswith((".yaml", ".yml", ".json")):
        path = Path(pipeline)
        return path.read_text(), "json" if path.suffix == ".json" else "yaml"
    return pipeline, "json" if pipeline.lstrip().startswith("[") else "yaml"


def load_yaml(text: str) -> list[dict[str, Any]]:
    """The first document."""
    return next(iter(yaml.load_all(text, Loader)), None) or []


def load_json(text: str, lists_are_sweeps: bool = False) -> list[dict[str, Any]]:
    """Steps of JSON text.

    A sweep is ``{"sweep": [...]}`` or ``{"sweep_range": {"start", "stop", "step"}}``.
    With ``lists_are_sweeps`` the older form counts, too: the first parameter of a step
    that is a list, or a mapping of start, stop and step.
    """
    steps = json.loads(text)
    for step in steps:
        found = False
        for name, value in (step.get("parameters") or {}).items():
            if isinstance(value, dict) and set(value) == {"sweep"}:
                step["parameters"][name] = Sweep(tuple(value["sweep"]))
            elif isinstance(value, dict) and set(value) == {"sweep_range"}:
                step["parameters"][name] = Sweep(tuple(arange(**value["sweep_range"])))
            elif lists_are_sweeps and not found and isinstance(value, list):
                step["parameters"][name], found = Sweep(tuple(value)), True
            elif lists_are_sweeps and not found and isinstance(value, dict) and set(value) == {"start", "stop", "step"}:
                step["parameters"][name], found = Sweep(tuple(arange(**value))), True
    return steps


def reference(value: Any) -> tuple[str, str] | None:
    """Step id and name of a reference ``${{id.side_outputs.name}}``."""
    found = REFERENCE.match(value) if isinstance(value, str) else None
    if not found:
        return None
    parts = found[1].split(".")
    if len(parts) != 3 or parts[1] != "side_outputs":
        raise PipelineError(f"a reference has the form <id>.side_outputs.<name>, not {found[1]!r}")
    return parts[0], parts[2]


def build(raw: list[dict[str, Any]]) -> Pipeline:
    """The pipeline of parsed steps; the first one is the loader."""
    from tomoflow.methods import spec

    if not raw or "loaders" not in str(raw[0].get("module_path")):
        raise PipelineError("the first step has to be a loader")
    known: dict[str, Step] = {}
    steps: list[Step] = []
    for entry in raw:
        parameters = dict(entry.get("parameters") or {})
        for name, value in parameters.items():
            target = reference(value)
            if target is None:
                continue
            before = known.get(target[0])
            if before is None:
                raise PipelineError(f"step {target[0]!r}, which {entry['method']} refers to, doesn't come before it")
            if target[1] not in before.side_outputs.values():
                raise PipelineError(f"step {target[0]!r} has no side output {target[1]!r}")
            parameters[name] = Ref(*target)
        method = spec(entry["method"])
        step = Step(
            entry["method"],
            entry["module_path"],
            parameters,
            entry.get("id"),
            dict(entry.get("side_outputs") or {}),
            bool(entry.get("save_result", method.save_default)),
            method.pattern,
            method.padding(parameters),
        )
        if step.id is not None:
            if step.id in known:
                raise PipelineError(f"id {step.id!r} is given twice")
            known[step.id] = step
        steps.append(step)
    return Pipeline(steps[0], tuple(steps[1:]))


def parse(pipeline: str | Path, lists_are_sweeps: bool = False) -> Pipeline:
    text, kind = read_text(pipeline)
    return build(load_json(text, lists_are_sweeps) if kind == "json" else load_yaml(text))
