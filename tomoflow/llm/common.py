"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words: blank, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a session on one machine uses its warehouse; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths that this process has made in shared folders, and their sessions.
_MADE: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tomoflow-{label}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(drop_scratch)
    _MADE.append((spark, path))
    return path


def drop_scratch() -> None:
    """Delete what was written under scratch paths, as far as their sessions still run."""
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stash(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: an executor that is lost later costs no recomputation
    of what stands above, and every later pass sees the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What operators keep in a Python worker between tasks, and how each drops it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """An operator keeps something in its workers; ``forget`` drops it."""
    _KEPT[operator] = forget


@contextlib.contextmanager
def working(operator: str) -> Iterator[None]:
    """A task of an operator: what others have kept in this worker goes, and freed memory, too.

    Spark reuses its Python workers, so without this the memories of all operators that
    a session has run would add up in every worker.
    """
    for other, forget in _KEPT.items():
        if other != operator:
            forget()
    _trim()
    try:
        yield
    finally:
        _trim()


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts go to Python in batches of fewer rows than Spark's default of 10,000.

    A setting of the session that somebody has changed stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


#: Bits of an id filter for each id, and of the largest filter (32 MB).
BITS_AN_ID = 16
MOST_BITS = 1 << 28


class IdFilter:
    """Bits of a set of ids: no false negatives; full if the ids are too many, and then all pass."""

    def __init__(self, bits: np.ndarray, shared=None):
        self.size, self.shared = 8 * len(bits), shared
        self.bits = None if shared is not None else bits

    @staticmethod
    def places(ids: np.ndarray, size: int) -> np.ndarray:
        """Three places of each id."""
        h = (ids.astype(np.int64).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.stack([(h >> np.uint64(s)) & np.uint64(size - 1) for s in (0, 18, 36)]).astype(np.int64)

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        bits = self.shared.value if self.shared is not None else self.bits
        at = self.places(ids, self.size)
        return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def id_filter(rows: DataFrame, id_col: str) -> IdFilter:
    """A filter of the ids of ``rows`` (null: -1), broadcast; it grows with them up to ``MOST_BITS`` bits."""
    size = 1 << 16
    n = rows.count()
    while size < min(MOST_BITS, BITS_AN_ID * n):
        size *= 2

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = IdFilter.places(batch["id"].to_numpy(), size).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    bits = np.zeros(size // 8, np.uint8)
    for row in rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id")).coalesce(8).mapInPandas(fill, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    return IdFilter(bits, rows.sparkSession.sparkContext.broadcast(bits))


def split_by_id(docs: DataFrame, key: Column, listed: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose key may be among the ids of ``listed``, and those that certainly aren't.

    Few rows have to meet ``listed`` in a join then; the texts of all others stay where they are.
    """
    kept = id_filter(listed, id_col)

    @F.pandas_udf("boolean")
    def may_be_listed(ids: pd.Series) -> pd.Series:
        return pd.Series(kept.may_hold(ids.to_numpy()).astype(bool))

    hit = may_be_listed(F.coalesce(key, F.lit(-1)))
    return docs.where(hit), docs.where(~hit)


def without_listed(docs: DataFrame, key: Column, digest: Column, listed: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``listed`` (k_id, k_sha, stays); where ``stays``, one of them is left.

    Only rows whose id may be listed are given a digest and meet ``listed`` in a join.
    """
    maybe, clear = split_by_id(docs, key, listed, "k_id")
    keyed = maybe.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("doc_key"), digest.alias("doc_sha"))
    same = F.col("doc_key").eqNullSafe(F.col("k_id")) & (F.col("doc_sha") == F.col("k_sha"))
    left = clear.union(keyed.join(listed, same, "left_anti").select("doc.*"))
    repeated = listed.where("stays")
    if repeated.limit(1).count():
        left = left.union(keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_key", "doc_sha"]).select("doc.*"))
    return left


def column(df: DataFrame, name: str, kind: str) -> Column:
    """``df[name]`` cast to ``kind``; a typed null where the table lacks the column."""
    if name in df.columns:
        return F.col(f"`{name}`").cast(kind)
    return F.lit(None).cast(kind)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def word_count(text: Column) -> Column:
    """Number of words (``WORD``) of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
