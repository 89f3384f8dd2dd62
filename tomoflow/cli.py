"""Command line: run, check, memory-check."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tomoflow import log
from tomoflow.functions.numbers import byte_size
from tomoflow.monitor import make_monitors
from tomoflow.plans import check as checks
from tomoflow.plans.cost import peak_memory
from tomoflow.plans.parse import parse, read_text
from tomoflow.plans.rules import rewrite
from tomoflow.plans.stages import plan_stages

VERSION = "0.1"


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tomoflow")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a pipeline over a table of lines")
    run.add_argument("data")
    run.add_argument("pipeline", help="a path, or the pipeline's text")
    run.add_argument("out_dir")
    run.add_argument("--save-all", action="store_true", help="save the result of every step, whatever its save_result says")
    run.add_argument("--intermediate-format", choices=("parquet", "hdf5"), default="parquet", help="how saved steps are written")
    run.add_argument("--frames-per-chunk", type=int, default=0, help="frames of a chunk of HDF5 volumes; 0: about 4 MB")
    run.add_argument("--compress-intermediate", type=int, choices=range(10), default=0, metavar="LEVEL", help="deflate level of HDF5 volumes")
    run.add_argument("--snapshots", action="store_true")
    run.add_argument("--monitor", action="append", default=[])
    run.add_argument("--subset-start", type=int)
    run.add_argument("--subset-stop", type=int)
    run.add_argument("--sweep-bits", type=int, default=8)
    run.add_argument("--lists-are-sweeps", action="store_true")
    run.add_argument("--rows", type=int, default=10, help="detector rows of a table with one key")
    run.add_argument("--log-dir", help="folder of the driver for user.log and debug.log")
    check = commands.add_parser("check", help="check a pipeline")
    check.add_argument("pipeline", type=Path)
    check.add_argument("data", nargs="?")
    memory = commands.add_parser("memory-check", help="memory of the largest stage")
    memory.add_argument("pipeline")
    memory.add_argument("--shape", type=int, nargs=3, required=True)
    memory.add_argument("--parts", type=int, default=1)
    memory.add_argument("--limit", type=byte_size, default=0)
    return parser.parse_args(argv)


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tomoflow").getOrCreate()


def run(spark, data: str, pipeline: str, out_dir: str, options: argparse.Namespace):
    """Run a pipeline: its result is computed, and what the run held is given back; gives the scan."""
    from tomoflow.run import Settings, run_pipeline, run_sweep, warn_of_zeros
    from tomoflow.sources import declared
    from tomoflow.sources.sinks import discard

    plan = rewrite(parse(pipeline, options.lists_are_sweeps), options.save_all, options.sweep_bits)
    if "standard_tomo" not in plan.loader.method:
        raise NotImplementedError(f"there is no loader {plan.loader.method!r}")
    subset = None
    if options.subset_start is not None or options.subset_stop is not None:
        subset = {"start": options.subset_start, "stop": options.subset_stop}
    scan = declared.load(spark, data, plan.loader.parameters, options.rows, subset, bool(plan.sweeps))
    monitors = make_monitors(options.monitor)
    settings = Settings(out_dir, options.save_all, options.snapshots, monitors, count_zeros=True)
    settings.saved_as, settings.frames_per_chunk, settings.deflate = options.intermediate_format, options.frames_per_chunk, options.compress_intermediate
    try:
        scan = (run_sweep if plan.sweeps else run_pipeline)(plan, scan, settings)
        discard(scan.lines)
        warn_of_zeros(scan)
        monitors.write(spark, f"{out_dir}/monitor" if options.monitor else None)
    finally:
        settings.release()
    return scan


def main(argv: list[str] | None = None) -> int:
    options = arguments(sys.argv[1:] if argv is None else argv)
    log.setup(options.log_dir if options.command == "run" else None)
    if options.command == "check":
        columns = None
        if options.data:
            from tomoflow.sources.declared import contents

            spark = session()
            columns = lambda file: contents(spark, file or options.data)
        findings = checks.check(options.pipeline, columns)
        for f in findings:
            if not f.ok:
                print(f"{f.rule}, step {f.step}: {f.message}")
        return int(not all(f.ok for f in findings))
    if options.command == "memory-check":
        _, stages = plan_stages(rewrite(parse(options.pipeline)))
        peak = peak_memory(stages, tuple(options.shape), options.parts)
        print(f"{peak * options.parts / 2**30:.3f} GiB in all, {peak / 2**30:.3f} GiB a share")
        return int(bool(options.limit) and peak >= options.limit)
    spark = session()
    run(spark, options.data, options.pipeline, options.out_dir, options)
    from tomoflow.sources.sinks import pipeline_copy

    text = pipeline_copy(read_text(options.pipeline)[0], VERSION)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{options.out_dir}/pipeline")
    return 0


if __name__ == "__main__":
    sys.exit(main())
