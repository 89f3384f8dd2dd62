"""Exact deduplication by a tree-merge of sorted digest runs.

Each input partition sorts its digests into one *run* per digest bucket: distinct
SHA-256 digests of the normalised text, each with its smallest identifier, its
number of rows and the length of the text.  Runs are then exchanged in binomial
rounds: in every round the runs of one bucket whose numbers agree but for their
lowest bits meet in one task, which merges them into one sorted run.  After
ceil(log_fan_in(partitions)) rounds one run per bucket is left.

Memory and skew: a run holds a digest once however often its text occurs, so a
text that makes up a third of the table is one entry a run.  Buckets are ranges
of the digest, as many as keep a final run near ``bucket_rows`` entries.  Only
groups of two or more rows are joined back; those above ``hot_rows`` rows (at
most rows / hot_rows of them, a proven bound) are broadcast, so that no join key
of the shuffled join holds more than ``hot_rows`` rows.

Defined results
  * null text counts as empty; texts of white space only are one blank or empty.
  * a null id is larger than every other id.
  * rows that repeat one id with equal text are one group; exactly one row of the
    smallest id stays.
  * an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoflow.llm.common import SPACE, column, stash, without_listed, working

#: Packed entry of a run; ``nul`` puts null ids last.
ENTRY = np.dtype(
    [(f"d{i}", "<u8") for i in range(4)]
    + [("length", "<i8"), ("nul", "<i8"), ("id", "<i8"), ("row", "<i8"), ("rows", "<i8")]
)
ORDER = ["d0", "d1", "d2", "d3", "nul", "id", "row"]
RUNS = "bucket long, run long, entries binary"


def normalised(text: Column) -> Column:
    """Each stretch of ASCII white space becomes one blank; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Multiway merge; of equal digests the entry of the smallest id stays.

    Digests count as equal only if the lengths of their texts agree, too; a
    difference would be a collision and ends the job.
    """
    if not runs:
        return np.empty(0, ENTRY)
    both = np.concatenate(runs)
    both = both[np.lexsort([both[name] for name in reversed(ORDER)])]
    if not len(both):
        return both
    same = np.ones(len(both) - 1, bool)
    for name in ("d0", "d1", "d2", "d3"):
        same &= both[name][1:] == both[name][:-1]
    if np.any(same & (both["length"][1:] != both["length"][:-1])):
        raise ValueError("two texts of different length share one SHA-256 digest")
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    out = both[first].copy()
    out["rows"] = np.add.reduceat(both["rows"], first)
    return out


def _entries(batch: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(batch), ENTRY)
    words = np.frombuffer(b"".join(batch["sha"]), dtype=">u8").reshape(-1, 4)
    for i in range(4):
        out[f"d{i}"] = words[:, i]
    out["length"] = batch["length"]
    out["nul"] = batch["doc_id"].isna()
    out["id"] = batch["doc_id"].fillna(0).astype("int64")
    out["row"] = batch["row"]
    out["rows"] = 1
    return out


def _run_builder(bits: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with working("exact_dedup"):
            run = TaskContext.get().partitionId()
            held, waiting, count = np.empty(0, ENTRY), [], 0
            for batch in batches:
                if len(batch):
                    waiting.append(_entries(batch))
                    count += len(batch)
                if count > len(held) + 100_000:
                    held, waiting, count = merge_runs([held, *waiting]), [], 0
            held = merge_runs([held, *waiting])
            buckets = (held["d0"] >> np.uint64(64 - bits)).astype("int64") if bits else np.zeros(len(held), "int64")
            cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
            for start, piece in zip(cuts, np.split(held, cuts[1:]), strict=False):
                yield pd.DataFrame({"bucket": [buckets[start]], "run": [run], "entries": [piece.tobytes()]})

    return build


def _merge_round(key, runs: pd.DataFrame) -> pd.DataFrame:
    merged = merge_runs([np.frombuffer(x, ENTRY) for x in runs["entries"]])
    return pd.DataFrame({"bucket": [key[0]], "run": [key[1]], "entries": [merged.tobytes()]})


def _last_round(key, runs: pd.DataFrame) -> pd.DataFrame:
    """The last merge of a bucket: its entries of two or more rows, unpacked."""
    run = merge_runs([np.frombuffer(x, ENTRY) for x in runs["entries"]])
    run = run[run["rows"] > 1]
    shas = np.stack([run[f"d{i}"] for i in range(4)], axis=1).astype(">u8").tobytes()
    ids = pd.array(run["id"], dtype="Int64")
    ids[run["nul"] == 1] = pd.NA
    return pd.DataFrame(
        {
            "g_sha": [shas[i : i + 32] for i in range(0, len(shas), 32)],
            "g_keep_id": ids,
            "g_keep_row": run["row"],
            "g_size": run["rows"],
        }
    )


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sha, length and a row number, written once to the shared folder."""
    text = normalised(column(docs, text_col, "string"))
    table = docs.select(
        column(docs, id_col, "long").alias("doc_id"),
        F.struct(
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.octet_length(text).cast("long").alias("length")
        ).alias("d"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stash(table.select("doc_id", "d.sha", "d.length", "row"), "digests")


def duplicate_groups(digests: DataFrame, fan_in: int = 4, bucket_rows: int = 250_000) -> DataFrame:
    """g_sha, g_keep_id, g_keep_row, g_size of every text with two or more rows."""
    rows = digests.count()
    bits = max(3, math.ceil(math.log2(max(1, rows / bucket_rows))))
    runs = digests.mapInPandas(_run_builder(bits), RUNS)
    left = digests.rdd.getNumPartitions()
    while left > fan_in:
        runs = runs.groupBy("bucket", (F.col("run") / fan_in).cast("long").alias("next")).applyInPandas(
            _merge_round, RUNS
        )
        left = math.ceil(left / fan_in)
    # the last round unpacks, so that no task runs two Python workers
    return runs.groupBy("bucket").applyInPandas(_last_round, "g_sha binary, g_keep_id long, g_keep_row long, g_size long")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4, hot_rows: int | None = None
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, sha."""
    digests = digest_table(docs, id_col, text_col)
    groups = stash(duplicate_groups(digests, fan_in), "groups")
    rows = digests.count()
    hot_rows = hot_rows or max(1000, rows // 100_000)
    hot = groups.where(F.col("g_size") > hot_rows).toDF("h_sha", "h_keep_id", "h_keep_row", "h_size")
    cold = groups.where(F.col("g_size") <= hot_rows)
    found = digests.join(F.broadcast(hot), F.col("sha") == F.col("h_sha"), "left")
    # rows of hot groups get a key of their own, which matches nothing and spreads them
    key = F.when(F.col("h_sha").isNull(), F.col("sha")).otherwise(F.col("row").cast("string").cast("binary"))
    found = found.withColumn("key", key).join(cold, F.col("key") == F.col("g_sha"), "left")
    grouped = F.col("h_sha").isNotNull() | F.col("g_sha").isNotNull()
    keep_row = F.coalesce("h_keep_row", "g_keep_row")
    return found.select(
        "doc_id",
        F.when(F.col("h_sha").isNotNull(), F.col("h_keep_id"))
        .when(F.col("g_sha").isNotNull(), F.col("g_keep_id"))
        .otherwise(F.col("doc_id"))
        .alias("keep_id"),
        F.coalesce("h_size", "g_size", F.lit(1).cast("long")).alias("group_size"),
        (~grouped | (F.col("row") == keep_row)).alias("kept"),
        "sha",
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: those that go are looked up, not those that stay."""
    rows = exact_dedup(docs, id_col, text_col).where("group_size > 1")
    keys = rows.groupBy(F.col("doc_id").alias("k_id"), F.col("sha").alias("k_sha")).agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    found = stash(keys.where(~F.col("stays") | (F.col("n") > 1)).select("k_id", "k_sha", "stays"), "not-kept")
    return without_listed(docs, column(docs, id_col, "long"), digest(column(docs, text_col, "string")), found)
