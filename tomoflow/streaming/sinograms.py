"""Sinograms that grow while lines arrive.

A sinogram is known once the lines of all its angles are there, in whatever order and batches
they come.  Each detector row keeps its lines so far as a list in the state store - a line is
appended once and not touched again - and a bit for every angle it has.  With the last missing line
the sinogram is put in order, worked on and published, and the row's state goes.  What a
row holds is at most one sinogram; rows are independent keys, spread by their exchange.

A line that comes again is left out while its sinogram grows; after that it would begin another
one.  A stream that is started again from its checkpoint goes on with the lines it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

LINES = "angle int, det_y int, line array<double>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GrowingSinogram(StatefulProcessor):
    """One detector row: lines so far, and which angles they are of."""

    def __init__(self, n_angles: int, function: Callable[[np.ndarray], np.ndarray] | None = None):
        self.n_angles, self.function = n_angles, function

    def init(self, handle: Any) -> None:
        self.lines = handle.getListState("lines", "angle int, line array<double>")
        self.there = handle.getValueState("there", "bits binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        there = bytearray(self.there.get()[0]) if self.there.exists() else bytearray(-(-self.n_angles // 8))
        new = []
        for part in rows:
            for angle, line in zip(part["angle"].tolist(), part["line"], strict=True):
                if not 0 <= angle < self.n_angles:
                    raise ValueError(f"angle {angle} of a scan of {self.n_angles} angles")
                if not there[angle >> 3] >> (angle & 7) & 1:
                    there[angle >> 3] |= 1 << (angle & 7)
                    new.append((angle, [float(v) for v in line]))
        if sum(b.bit_count() for b in there) < self.n_angles:
            if new:
                self.lines.appendList(new)
                self.there.update((bytes(there),))
            return
        held = sorted([*(tuple(r) for r in self.lines.get()), *new])
        self.lines.clear()
        self.there.clear()
        frame = np.array([line for _, line in held], float)
        done = frame if self.function is None else np.asarray(self.function(frame), float)
        index = np.arange(len(done), dtype=np.int32)
        yield pd.DataFrame({"angle": index, "det_y": np.int32(key[0]), "line": list(done)})

    def close(self) -> None:
        pass


def completed_sinograms(lines: DataFrame, n_angles: int, function: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """A stream of the lines of completed sinograms, each worked on by ``function``, if given."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = lines.selectExpr("angle", "det_y", "cast(line AS array<double>) AS line")
    return rows.groupBy("det_y").transformWithStateInPandas(GrowingSinogram(n_angles, function), LINES, "Append", "None")


def arrived(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over what is there, going on from its checkpoint; what it has published so far is the table at ``path``."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
