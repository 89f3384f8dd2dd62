"""Running a pipeline: stages become one lazy plan, cut only where a value is needed.

Between stages of different patterns nothing is done here: the next operator's grouping
asks for its key, and Spark plans one exchange.  Steps that publish values (centres,
statistics) are the only actions on the way; the lines they read are persisted first, so
that they and all later steps share one pass.
"""

from __future__ import annotations

import importlib
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Observation

from tomoflow.methods import bind, known, spec
from tomoflow.monitor import Several, timed
from tomoflow.operators.frames import each_frame
from tomoflow.operators.sweep import stacked
from tomoflow.plans.model import AXIS, Pipeline, Ref, Stage, Step, Sweep
from tomoflow.plans.rules import ADDED_CHECK
from tomoflow.plans.stages import plan_stages, sweep_stages
from tomoflow.sources import sinks
from tomoflow.sources.scan import Scan

log = logging.getLogger("tomoflow")


@dataclass
class Settings:
    out_dir: str | None = None
    save_all: bool = False
    snapshots: bool = False
    monitors: Several = field(default_factory=lambda: Several([]))
    persist: bool = True
    #: how saved steps are written: tables, or one HDF5 volume each
    saved_as: str = "parquet"
    #: frames of a chunk of such a volume (0: as many as fit its usual size), and its deflate level
    frames_per_chunk: int = 0
    deflate: int = 0
    #: whether checks that the rewrites put in count zeros; ``warn_of_zeros`` tells what they found
    count_zeros: bool = False
    #: what a run has persisted; ``release`` gives it back once its result is used
    held: list = field(default_factory=list)

    def keep(self, scan: Scan) -> Scan:
        lines = scan.lines.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(lines)
        return scan.with_lines(lines)

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()


def resolved(step: Step, scan: Scan, published: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """The step's parameters: references by value, and values published under a parameter's name."""
    accepted = spec(step.method).parameters
    given = {k: v for k, v in scan.side_outputs.items() if k in accepted and not isinstance(step.parameters.get(k), Ref)}
    out = dict(step.parameters)
    out.update({k: v for k, v in given.items() if out.get(k) is None or k in published.get("*", {})})
    for name, value in out.items():
        if isinstance(value, Ref):
            out[name] = published[value.step][value.name]
        if isinstance(value, Sweep):
            raise ValueError(f"{step.method}: {name} has several values; that is a sweep run")
    return out


def own_function(step: Step) -> Callable | None:
    """A Python function of one frame: registered, or found under the step's module path."""
    if known(step.method):
        return spec(step.method).frame
    try:
        return getattr(importlib.import_module(step.module), step.method, None)
    except ImportError:
        return None


def apply_function(function: Callable, step: Step, scan: Scan, parameters: dict[str, Any]) -> Scan:
    """A function of one frame on every frame of the step's pattern.

    Its arguments are bound by name: the scan's angles (``angles``, ``angles_radians``,
    ``theta``) and, for projections, the means of the calibration frames (``darks``,
    ``flats``; one frame each), then what the step gives, then defaults.
    """
    import inspect

    names = inspect.signature(function).parameters
    pattern = "projection" if step.pattern == "all" else step.pattern
    context: dict[str, Any] = {}
    for name in ("angles", "angles_radians", "theta"):
        if name in names:
            context[name] = scan.angles.orderBy("angle").select("theta").toPandas()["theta"].to_numpy()[: scan.shape[0]]
    if pattern == "projection":
        for name in ("darks", "flats"):
            if name in names:
                context[name] = frame_mean(getattr(scan, name))
    arguments = bind(function, parameters, context, pattern)
    return scan.with_lines(each_frame(scan.lines, function, pattern, **arguments))


def frame_mean(frames_: Any):
    """The mean calibration frame as an array: as large as the detector."""
    import numpy as np

    from tomoflow.operators.aggregate import calibration_mean

    means = calibration_mean(frames_).toPandas().pivot(index="det_y", columns="det_x", values="v")
    return means.sort_index().sort_index(axis=1).to_numpy(np.float32)


def apply_step(step: Step, scan: Scan, settings: Settings, published: dict[str, dict[str, Any]]) -> Scan:
    method = spec(step.method)
    parameters = resolved(step, scan, published)
    if method.apply is None:
        function = own_function(step)
        if function is None:
            raise ValueError(f"unknown method {step.method!r}")
        return apply_function(function, step, scan, parameters)
    unknown = [p for p in parameters if p not in method.parameters and not method.any_parameter]
    if unknown:
        raise ValueError(f"{step.method} has no parameter {', '.join(unknown)}")
    if step.method == "data_checker" and not settings.count_zeros and str(step.id).startswith(ADDED_CHECK):
        parameters["zeros_warning"] = False
    if step.method == "save_intermediate_data":
        if settings.out_dir:
            package = step.module.split(".")[0]
            name = f"{settings.out_dir}/{sinks.result_name(str(step.id), package, step.parameters.get('of') or 'data')}"
            if settings.saved_as == "hdf5":
                sinks.save_hdf5(scan, f"{name}.h5", step.pattern, settings.frames_per_chunk, settings.deflate)
            else:
                sinks.save_scan(scan, name)
        return scan
    if step.method == "save_to_images":
        if settings.out_dir:
            axis = parameters.get("axis", "auto")
            axis = AXIS[step.pattern] if axis == "auto" else int(axis)
            stats = scan.side_outputs.get("glob_stats")
            low = high = None
            if stats:
                span = stats[1] - stats[0]
                low = stats[0] + span * parameters.get("perc_range_min", 0.0) / 100
                high = stats[0] + span * parameters.get("perc_range_max", 100.0) / 100
            sinks.save_images(
                scan.lines,
                f"{settings.out_dir}/{parameters.get('subfolder_name', 'images')}",
                axis=axis,
                bits=parameters.get("bits", 8),
                file_format=parameters.get("file_format", "pgm"),
                low=low,
                high=high,
                offset=parameters.get("offset", 0),
                quality=parameters.get("jpeg_quality", 95),
            )
        return scan
    if method.publishes and settings.persist:
        scan = settings.keep(scan)
    before = scan.side_outputs
    scan = method.apply(scan, step.pattern, **parameters)
    if step.id and step.side_outputs:
        values = {name: scan.side_outputs[own] for own, name in step.side_outputs.items()}
        published[step.id] = values
        published["*"] = published.get("*", {}) | values
        scan = replace(scan, side_outputs=before | values)
    if method.swaps_axes:
        from tomoflow.operators.reorient import swapped

        n, y, x = scan.shape
        scan = scan.with_lines(swapped(scan.lines), (y, n, x))
    return scan


def inspect(stages: list[Stage]) -> list[str]:
    """Warnings about a plan."""
    names = [s.method for stage in stages for s in stage.steps]
    out = []
    if len(stages) > 3:
        out.append(f"{len(stages)} stages: each change of pattern moves all data once")
    if "minus_log" in names and not {"normalize", "dark_flat_field_correction"} & set(names):
        out.append("minus_log without a dark and flat correction before it")
    for i, n in enumerate(names):
        if "seam_blend" in n and not {"normalize", "dark_flat_field_correction"} & set(names[:i]):
            raise ValueError("blend seams after the dark and flat correction")
    return out


#: Methods that leave the data as they are; snapshots are never named after them. Fixed values.
WITHOUT_IMAGE = ("data_checker", "calculate_stats", "find_center", "find_center_360", "find_center_pc", "find_center_vo", "save_intermediate_data")


def snapshot_name(stage: Stage) -> str | None:
    """The stage's last method that changes the data; None where no step does."""
    changing = [s.method for s in stage.steps if s.method not in WITHOUT_IMAGE]
    return changing[-1] if changing else None


#: Share of zeros above which a check of the data warns.
ZEROS_SHARE = 0.1


def counted_zeros(seen: Observation, seconds: float = 10.0) -> dict[str, Any] | None:
    """What an observation has seen; None if no action has run through it within ``seconds``.

    Spark tells observations some moments after an action's end; to ask for one that no
    action met would wait for ever.
    """
    deadline = time.monotonic() + seconds
    while seen._jo is None or not seen._jo.future().isCompleted():
        if seen._jo is None or time.monotonic() > deadline:
            return None
        time.sleep(0.02)
    return seen.get


def warn_of_zeros(scan: Scan, seconds: float = 10.0) -> dict[str, float]:
    """Shares of zeros that the checks counted while the scan was computed; those above ``ZEROS_SHARE`` are logged.

    To be called after an action on the scan's lines: the counts are made on its way.
    """
    out = {}
    for name, seen in scan.side_outputs.items():
        if isinstance(seen, Observation):
            counts = counted_zeros(seen, seconds)
            if counts is None:
                log.info("%s: not counted", name)
                continue
            out[name] = (counts["zeros"] or 0) / max(1, counts["n"] or 0)
            if out[name] > ZEROS_SHARE:
                log.warning("%s: %.1f %% of the values are 0", name, 100 * out[name])
    return out


def run_pipeline(pipeline: Pipeline, scan: Scan, settings: Settings | None = None) -> Scan:
    """All steps of a pipeline without sweep."""
    settings = settings or Settings()
    if pipeline.sweeps:
        raise ValueError("a parameter has several values; use run_sweep")
    _, stages = plan_stages(pipeline)
    for warning in inspect(stages):
        log.warning(warning)
    published: dict[str, dict[str, Any]] = {}
    with timed() as whole:
        for number, stage in enumerate(stages):
            log.info("stage %s: %s, %s", number, stage.pattern, ", ".join(s.method for s in stage.steps))
            for step in stage.steps:
                with timed() as spent:
                    scan = apply_step(step, scan, settings, published)
                    if settings.monitors.monitors:  # steps are lazy: to time one, its lines are made
                        scan = settings.keep(scan)
                        sinks.discard(scan.lines)
                settings.monitors.report("method", step.method, str(step.id), step.module, step.pattern, number, spent["s"])
            last = snapshot_name(stage)
            if settings.snapshots and settings.out_dir and last:
                image = sinks.snapshot(scan.lines, scan.shape, stage.pattern)
                image.write.mode("overwrite").parquet(f"{settings.out_dir}/snapshots/{number}_{last}")
    settings.monitors.total(whole["s"])
    return scan


def run_sweep(pipeline: Pipeline, scan: Scan, settings: Settings | None = None) -> Scan:
    """A pipeline with one sweep: the middle detector row of each value's result.

    The scan has the few rows of ``sweep_preview``.  The steps before run once and are
    persisted; the results of the values are stacked along the detector rows.
    """
    settings = settings or Settings()
    plan = sweep_stages(pipeline)
    published: dict[str, dict[str, Any]] = {}
    for step in plan.before:
        scan = apply_step(step, scan, settings, published)
    scan = settings.keep(scan)
    from pyspark.sql import functions as F

    rows = scan.shape[1]
    first = scan.lines.agg(F.min("det_y")).first()[0] or 0
    results, shape = [], scan.shape
    for value in plan.values:
        one = apply_step(plan.sweep.given(**{plan.parameter: value}), scan, settings, published)
        shape = one.shape
        results.append(one.lines.where(F.col("det_y") == first + rows // 2).select("angle", "line"))
    lines = stacked(results).withColumnRenamed("sweep_idx", "det_y").select("angle", "det_y", "line")
    scan = scan.with_lines(lines, (shape[0], len(plan.values), shape[2]))
    for step in plan.after:
        scan = apply_step(step, scan, settings, published)
    return scan
