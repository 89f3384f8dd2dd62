"""Statistics of lines that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoflow.functions.columns import finite_or_zero


def running_stats(lines: DataFrame, *keys: str) -> DataFrame:
    """min, max, mean and n so far; for a stream in complete or update mode.

    The state is one row a key, however long the stream runs.
    """
    values = lines.select(*keys, F.explode("line").alias("v")).withColumn("v", finite_or_zero(F.col("v").cast("double")))
    aggregates = [F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.count("v").alias("n")]
    return values.groupBy(*keys).agg(*aggregates)


def windowed_counts(events: DataFrame, time_col: str, key: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and key; state older than the watermark is dropped."""
    events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    w = events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run an aggregated stream over what is there; its last complete result is a table beside the checkpoint."""
    spark, batches = stream.sparkSession, []

    def keep(result: DataFrame, number: int) -> None:
        batches.append(f"{checkpoint}-{name}/{number}")
        result.write.mode("overwrite").parquet(batches[-1])

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(batches[-1]) if batches else spark.createDataFrame([], stream.schema)
