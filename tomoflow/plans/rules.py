"""Rewrites of a pipeline: each rule takes steps and gives steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from tomoflow.methods import REQUIRED, spec
from tomoflow.plans.model import Pipeline, Step

Rule = Callable[[tuple[Step, ...]], tuple[Step, ...]]

UNCHECKED = {"data_reducer", "data_checker", "calculate_stats", "rescale_to_int", "save_to_images"}
NOT_IN_SWEEPS = {"calculate_stats", "rescale_to_int", "save_to_images"}


#: How the ids of checks that ``check_between`` adds begin.
ADDED_CHECK = "datachecker_"


def reduce_first(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """Calibration frames are averaged before anything else."""
    return Step("data_reducer", "tomoflow.calibration", id="reducer_0"), *steps


def check_between(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """A check of the values after most steps: not after the last, centring, or saving."""
    out: list[Step] = []
    for i, step in enumerate(steps):
        out.append(step)
        if i < len(steps) - 1 and step.method not in UNCHECKED and "rotation" not in step.module:
            given = {"infsnans_correct": True, "zeros_warning": True, "data_to_method_name": step.method}
            out.append(Step("data_checker", "tomoflow.checks", given, f"{ADDED_CHECK}{step.id or i}"))
    return tuple(out)


def save_results(save_all: bool = False) -> Rule:
    """A save step after each step whose result is to be kept."""

    def rule(steps: tuple[Step, ...]) -> tuple[Step, ...]:
        out: list[Step] = []
        for i, step in enumerate(steps):
            out.append(step)
            wanted = step.save_result or save_all
            if wanted and step.method not in ("save_to_images", "data_checker") and "center" not in step.method:
                out.append(Step("save_intermediate_data", "tomoflow.sinks", {"of": step.method}, f"save_{step.id or i}", pattern=step.pattern))
        return tuple(out)

    return rule


def drop_redundant(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    return tuple(s for s in steps if s.method not in NOT_IN_SWEEPS)


def images_after_sweep(bits: int = 8) -> Rule:
    """Images after the sweep, and after each reconstruction that follows one."""

    def rule(steps: tuple[Step, ...]) -> tuple[Step, ...]:
        out: list[Step] = []
        swept = False
        for i, step in enumerate(steps):
            out.append(step)
            if step.sweep or ("recon" in step.module and swept):
                given = {"subfolder_name": f"images_sweep_{step.method}", "axis": 1, "bits": bits}
                out.append(Step("save_to_images", "tomoflow.images", given, f"saveimage_sweep_{step.id or i}"))
                swept = True
        return tuple(out)

    return rule


def fill_defaults(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """Parameters that are left out get their method's defaults."""
    out = []
    for step in steps:
        defaults = {k: v for k, v in spec(step.method).parameters.items() if v is not REQUIRED and k not in step.parameters}
        out.append(step.given(**defaults) if defaults else step)
    return tuple(out)


def rewrite(pipeline: Pipeline, save_all: bool = False, sweep_bits: int = 8) -> Pipeline:
    """All rules in order."""
    if pipeline.sweeps:
        rules: list[Rule] = [fill_defaults, reduce_first, drop_redundant, check_between, images_after_sweep(sweep_bits)]
    else:
        rules = [fill_defaults, reduce_first, check_between, save_results(save_all)]
    steps = pipeline.steps
    for rule in rules:
        steps = rule(steps)
    return replace(pipeline, steps=steps)
