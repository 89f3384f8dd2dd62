"""Queries over the other tables: records of runs, and larger sparse cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoflow.monitor import summarise
from tomoflow.streaming.stats import drain, running_stats, windowed_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as timings: a name, and seconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 5 == 0, "source").when(F.col("event_id") % 5 == 1, "sink").otherwise("method")
    return events.select(kind.alias("type"), F.col("event_type").alias("name"), F.abs("value").alias("cpu_s"))


@query("SELECT event_type AS name, count(*) AS calls, round(sum(abs(value)), 4) AS seconds, round(100 * sum(abs(value)) / 1000.0, 4) AS percent FROM events GROUP BY event_type")
def monitor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = summarise(records(spark, sf_dir), 1000.0)
    return done.withColumns({c: F.round(c, 4) for c in ("seconds", "percent")})


@query("""SELECT CASE event_id % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'sink' ELSE 'method' END AS type, count(*) AS n, round(max(abs(value)), 6) AS longest
FROM events GROUP BY ALL""")
def monitor_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("cpu_s"), 6).alias("longest"))


@query("""WITH vox AS (SELECT (l_orderkey % 40)::INT AS angle, (l_partkey % 25)::INT AS det_y, (l_suppkey % 20)::INT AS det_x, l_quantity AS v FROM lineitem)
SELECT (angle // 4)::INT AS angle, det_y, det_x, round(avg(v), 6) AS v FROM vox GROUP BY ALL""")
def sparse_cube_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomoflow.operators.aggregate import averaged_frames

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pixels = rows.select(
        (F.col("l_orderkey") % 40).cast("int").alias("angle"), (F.col("l_partkey") % 25).cast("int").alias("det_y"), (F.col("l_suppkey") % 20).cast("int").alias("det_x"), F.col("l_quantity").alias("v")
    )
    return averaged_frames(pixels, 4).withColumn("v", F.round("v", 6))


@query("""WITH vox AS (SELECT (l_suppkey % 20)::INT AS det_y, l_extendedprice AS v FROM lineitem)
SELECT det_y, round(min(v), 4) AS "min", round(max(v), 4) AS "max", round(avg(v), 4) AS mean, count(v) AS n FROM vox GROUP BY det_y""")
def sparse_cube_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomoflow.operators.aggregate import global_stats

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    stats = global_stats(rows.select((F.col("l_suppkey") % 20).cast("int").alias("det_y"), F.col("l_extendedprice").alias("v")), "det_y")
    return stats.withColumns({c: F.round(c, 4) for c in ("min", "max", "mean")})


def _stream(spark: SparkSession, path: str, name: str):
    """A table's file, or folder of files, as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    folder, _, file = path.rpartition("/")
    return reader.option("pathGlobFilter", file).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


@query('SELECT (vec_id % 10)::INT AS det_y, round(min(v), 6) AS "min", round(max(v), 6) AS "max", round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1')
def streaming_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per detector row over a stream of lines, block after block."""
    from tomoflow.queries.cube import scratch

    stream = _stream(spark, f"{sf_dir}/embeddings.parquet", "lines")
    lines = stream.select((F.col("vec_id") % 10).cast("int").alias("det_y"), F.col("embedding").alias("line"))
    done = drain(running_stats(lines, "det_y"), "stream_stats", scratch(spark, "stream"))
    return done.withColumns({c: F.round(c, 6) for c in ("min", "max", "mean")})


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type over a stream with a watermark."""
    from tomoflow.queries.cube import scratch

    stream = _stream(spark, f"{sf_dir}/events.parquet", "events")
    done = drain(windowed_counts(stream, "ts", "event_type", "value", "1 day", "1 day"), "stream_windows", scratch(spark, "stream"))
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
