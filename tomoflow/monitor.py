"""Timings of a run: recorded by step, reported as tables."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "type string, name string, task_id string, module string, pattern string, block int, cpu_s double, gpu_s double, to_gpu_s double, to_cpu_s double"


class Monitor(Protocol):
    def report(self, kind: str, name: str, task_id: str, module: str, pattern: str, block: int, seconds: float) -> None: ...

    def total(self, seconds: float) -> None: ...

    def write(self, spark: SparkSession, path: str | None = None) -> DataFrame: ...


@dataclass
class Bench:
    """One row per step and block; no device here, so those columns are 0."""

    rows: list[tuple] = field(default_factory=list)
    seconds: float = 0.0

    def report(self, kind, name, task_id, module, pattern, block, seconds) -> None:
        self.rows.append((kind, name, task_id, module, pattern, block, float(seconds), 0.0, 0.0, 0.0))

    def total(self, seconds: float) -> None:
        self.seconds = seconds

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, FIELDS)

    def write(self, spark: SparkSession, path: str | None = None) -> DataFrame:
        out = self.table(spark)
        if path:
            out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return out


@dataclass
class Summary(Bench):
    """Totals by name, and their share of the wall time."""

    def write(self, spark: SparkSession, path: str | None = None) -> DataFrame:
        return summarise(self.table(spark), self.seconds)


@dataclass
class Several:
    monitors: list[Monitor]

    def report(self, *values) -> None:
        for m in self.monitors:
            m.report(*values)

    def total(self, seconds: float) -> None:
        for m in self.monitors:
            m.total(seconds)

    def write(self, spark: SparkSession, path: str | None = None) -> list[DataFrame]:
        return [m.write(spark, path) for m in self.monitors]


KINDS = {"bench": Bench, "summary": Summary}


def make_monitors(names: list[str]) -> Several:
    unknown = [n for n in names if n not in KINDS]
    if unknown:
        raise ValueError(f"unknown monitor {', '.join(unknown)}; there are {', '.join(KINDS)}")
    return Several([KINDS[n]() for n in names])


def summarise(records: DataFrame, wall: float) -> DataFrame:
    """name, calls, seconds and percent of the wall time."""
    totals = records.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.sum("cpu_s").alias("seconds"))
    return totals.withColumn("percent", 100 * F.col("seconds") / wall if wall else F.lit(0.0))


def overhead(records: DataFrame, wall: float) -> float:
    """Wall time less methods, sources and sinks."""
    used = records.where(F.col("type").isin("method", "source", "sink")).agg(F.sum("cpu_s")).first()[0] or 0.0
    return wall - used


@contextmanager
def timed():
    """Seconds since the start, once and after the block."""
    start, spent = time.perf_counter_ns(), {}
    yield spent
    spent["s"] = (time.perf_counter_ns() - start) / 1e9
