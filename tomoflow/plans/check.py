"""Checks of a pipeline before it runs; every rule reports, none stops the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml

from tomoflow.methods import REQUIRED, known, spec
from tomoflow.plans.model import Sweep
from tomoflow.plans.parse import REFERENCE, PipelineError, load_json, load_yaml, read_text, reference

SCHEMA = "rule string, step int, ok boolean, message string"
KEYS = ("method", "module_path", "parameters")


@dataclass(frozen=True)
class Finding:
    rule: str
    step: int
    ok: bool
    message: str


def _findings(rule: str, bad: list[tuple[int, str]]) -> list[Finding]:
    return [Finding(rule, i, False, m) for i, m in bad] or [Finding(rule, -1, True, "")]


def _parameters(step: dict) -> dict[str, Any]:
    given = step.get("parameters")
    return given if isinstance(given, dict) else {}


def keys_present(steps: list[dict]) -> list[tuple[int, str]]:
    return [(i, f"key {k!r} is missing") for i, s in enumerate(steps) for k in KEYS if k not in s]


def first_is_loader(steps: list[dict]) -> list[tuple[int, str]]:
    ok = steps and "loaders" in str(steps[0].get("module_path"))
    return [] if ok else [(0, "the first step has to be a loader")]


def methods_exist(steps: list[dict]) -> list[tuple[int, str]]:
    return [(i, f"unknown method {s.get('method')!r}") for i, s in enumerate(steps) if i and not known(str(s.get("method")))]


def parameters_known(steps: list[dict]) -> list[tuple[int, str]]:
    out = []
    for i, s in enumerate(steps):
        method = spec(str(s.get("method")))
        if i and not method.any_parameter:
            out += [(i, f"unknown parameter {p!r}") for p in _parameters(s) if p not in method.parameters]
    return out


def required_given(steps: list[dict]) -> list[tuple[int, str]]:
    out = []
    for i, s in enumerate(steps):
        needed = [p for p, v in spec(str(s.get("method"))).parameters.items() if v is REQUIRED]
        out += [(i, f"parameter {p!r} is required") for p in needed if p not in _parameters(s)]
    return out


def names_are_text(steps: list[dict]) -> list[tuple[int, str]]:
    return [(i, f"parameter name {p!r} is no text") for i, s in enumerate(steps) for p in _parameters(s) if not isinstance(p, str)]


def nothing_left_required(steps: list[dict]) -> list[tuple[int, str]]:
    return [(i, f"parameter {p!r} still says REQUIRED") for i, s in enumerate(steps) for p, v in _parameters(s).items() if v == REQUIRED]


def no_images_after_sweep(steps: list[dict]) -> list[tuple[int, str]]:
    swept, out = False, []
    for i, s in enumerate(steps):
        if swept and s.get("method") == "save_to_images":
            out.append((i, "images after a sweep are saved anyway"))
        swept = swept or any(isinstance(v, Sweep) for v in _parameters(s).values())
    return out


def id_has_side_outputs(steps: list[dict]) -> list[tuple[int, str]]:
    return [(i, "a step with an id declares side outputs") for i, s in enumerate(steps) if "id" in s and "side_outputs" not in s]


def ids_unique(steps: list[dict]) -> list[tuple[int, str]]:
    seen: set = set()
    out = []
    for i, s in enumerate(steps):
        if "id" in s:
            if s["id"] in seen:
                out.append((i, f"id {s['id']!r} is given twice"))
            seen.add(s["id"])
    return out


def _references(steps: list[dict]):
    for i, s in enumerate(steps):
        for name, value in _parameters(s).items():
            if isinstance(value, str) and REFERENCE.match(value):
                yield i, name, value


def references_well_formed(steps: list[dict]) -> list[tuple[int, str]]:
    out = []
    for i, _, value in _references(steps):
        try:
            reference(value)
        except PipelineError as error:
            out.append((i, str(error)))
    return out


def _targets(steps: list[dict]):
    for i, name, value in _references(steps):
        parts = REFERENCE.match(value)[1].split(".")
        if len(parts) == 3:
            yield i, parts[0], parts[2]


def referenced_id_before(steps: list[dict]) -> list[tuple[int, str]]:
    return [(i, f"no step {step!r} before") for i, step, _ in _targets(steps) if step not in {s.get("id") for s in steps[:i]}]


def referenced_name_declared(steps: list[dict]) -> list[tuple[int, str]]:
    out = []
    for i, step, name in _targets(steps):
        declared = [v for s in steps if s.get("id") == step for v in (s.get("side_outputs") or {}).values()]
        if declared and name not in declared:
            out.append((i, f"step {step!r} has no side output {name!r}"))
    return out


def one_sweep_at_most(steps: list[dict]) -> list[tuple[int, str]]:
    at = [i for i, s in enumerate(steps) for v in _parameters(s).values() if isinstance(v, Sweep)]
    return [(i, "more than one sweep") for i in at[1:]]


def sweep_without_side_outputs(steps: list[dict]) -> list[tuple[int, str]]:
    swept = [i for i, s in enumerate(steps) if any(isinstance(v, Sweep) for v in _parameters(s).values())]
    return [(i, "a step with a sweep can't publish side outputs") for i in swept if steps[i].get("side_outputs")]


def seam_after_correction(steps: list[dict]) -> list[tuple[int, str]]:
    names = [str(s.get("method")) for s in steps]
    corrections = [i for i, n in enumerate(names) if n in ("normalize", "dark_flat_field_correction")]
    return [(i, "blend seams after the dark and flat correction") for i, n in enumerate(names) if "seam_blend" in n and not (corrections and corrections[0] < i)]


#: What a file holds, by its name; "" is the input.
Contents = Callable[[str], list[str]]

RULES: dict[str, Callable[[list[dict]], list[tuple[int, str]]]] = {
    "keys": keys_present,
    "loader_first": first_is_loader,
    "method_exists": methods_exist,
    "parameter_known": parameters_known,
    "required_given": required_given,
    "names_text": names_are_text,
    "no_required_left": nothing_left_required,
    "no_images_after_sweep": no_images_after_sweep,
    "id_side_outputs": id_has_side_outputs,
    "id_unique": ids_unique,
    "reference_form": references_well_formed,
    "reference_id": referenced_id_before,
    "reference_name": referenced_name_declared,
    "one_sweep": one_sweep_at_most,
    "sweep_no_side_outputs": sweep_without_side_outputs,
    "seam_order": seam_after_correction,
}


def declared_in(given: dict[str, Any]) -> list[tuple[str, list[str]]]:
    """The files a loader's parameters name ("": the input) and what has to be in each; "auto" as it is."""
    angles = given.get("rotation_angles")
    of_angles = angles if isinstance(angles, str) else (angles or {}).get("data_path")
    out = [("", [given.get("data_path"), given.get("image_key_path"), of_angles])]
    for name in ("darks", "flats"):
        frames = given.get(name)
        if isinstance(frames, dict) and frames.get("file"):
            out.append((str(frames["file"]), [frames.get("data_path"), frames.get("image_key_path")]))
    return [(file, [p for p in paths if p is not None]) for file, paths in out]


def absent_paths(given: dict[str, Any], contents: Contents) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    for file, paths in declared_in(given):
        name = repr(file) if file else "the input"
        try:
            held = contents(file)
        except Exception as error:  # whatever the store or the format says
            out.append((0, f"{name} can't be read: {str(error).splitlines()[0]}"))
            continue
        out += [(0, f"{name} has no {p!r}") for p in paths if p not in held]
    return out


def check(pipeline: str | Path, columns: list[str] | Contents | None = None) -> list[Finding]:
    """All findings.

    ``columns``: what the input holds, to check the loader's paths against; or a function
    that gives what a file holds ("" is the input), for darks and flats of other files, too.
    It lists "auto" where that finds something.
    """
    text, kind = read_text(pipeline)
    try:
        steps = load_json(text) if kind == "json" else load_yaml(text)
    except PipelineError as error:
        return [Finding("syntax", -1, True, ""), Finding("duplicate_key", -1, False, str(error))]
    except (yaml.YAMLError, ValueError, TypeError, KeyError) as error:
        return [Finding("syntax", -1, False, str(error).splitlines()[0])]
    if not isinstance(steps, list) or not all(isinstance(s, dict) for s in steps):
        return [Finding("syntax", -1, False, "a pipeline is a list of steps")]
    out = [Finding("syntax", -1, True, ""), Finding("duplicate_key", -1, True, "")]
    for name, rule in RULES.items():
        out += _findings(name, rule(steps))
    if columns is not None and steps:
        if callable(columns):
            absent = absent_paths(_parameters(steps[0]), columns)
        else:
            own = _parameters(steps[0]) | {"darks": None, "flats": None}
            absent = absent_paths(own, lambda _: [*columns, "auto"])
        out += _findings("path_exists", absent)
    return out


def passes(pipeline: str | Path, columns: list[str] | Contents | None = None) -> bool:
    return all(f.ok for f in check(pipeline, columns))
