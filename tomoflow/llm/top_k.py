"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's components are cut into ``slices`` slices; a query has one score list a
slice, the inner products of that slice, spread over the blocks of candidates.

1. Every task reads the first slice only and gathers, per query, the k best entries of
   its part of that score list.  The k best of all tasks are resolved to whole scores;
   the lowest of these is a safe cutoff, as k candidates reach it.
2. The cutoff goes out with the queries.  A score that reaches it has at least one
   slice score of cutoff / slices or more, so these entries are sufficient: all others
   are dropped where they are.  After the first slice candidates go that can't reach the cutoff
   by the norms of their other components, so the cutoff saves the work on these.  Slice
   scores are 64-bit floats; the thresholds are lowered by a bound of their rounding errors.
3. The entries that remain are resolved in integers, those below the cutoff drop out,
   and the k best of each query are its result.

The query set is part of the table and grows with it, so nothing of it is broadcast:
queries and candidates are packed into full blocks.  Candidate blocks are dealt to
``slots`` slots once; a query block is copied to every slot, and blocks meet in an
equi-join on (length of the vectors, slot), a merge join that spills a slot's candidates.  A task
meets a query block with all its candidates before the next one, so it holds one block of
either side and k entries of that block's queries: its work and memory a pair of blocks are the
same however many queries there are.

Scores and cutoffs are exact integers, cut to the range of a long.

Defined results
  * vectors that are null or hold null or non-finite components, and null ids, take no
    part; components beyond the range of a long are cut to it.
  * only vectors of equal length are compared; vectors without components score 0.
  * rows that repeat an id are vectors of their own: each is a candidate of all other
    rows, and each has its own k rows as a query.
  * a query row is never its own candidate; with fewer than k candidates all are
    returned; equal scores: smaller id first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomoflow.llm.common import column, stash

SLICES = 4
BLOCK_ROWS = 2048
LONG = 2**63 - 1
BLOCKS = pa.schema([("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("cutoffs", pa.binary()), ("head", pa.binary()), ("tail", pa.binary())])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """row, vec_id and floor(scale * component) of the vectors that take part."""
    v = column(vectors, vector_col, "array<double>")
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), column(vectors, id_col, "long").alias("vec_id"), F.when(fit, F.transform(v, lambda x: F.floor(scale * x))).alias("v")
    )
    return rows.where("vec_id is not null and v is not null")


def slice_bounds(dim: int, slices: int) -> list[int]:
    return [dim * i // slices for i in range(slices + 1)]


def _packed(rows: DataFrame, slices: int, block_rows: int) -> DataFrame:
    """Blocks of vectors of one length: rows, ids, cutoffs, and the first slice apart from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        counts: dict[int, int] = {}

        def block(dim: int) -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(x) for x in zip(*held.pop(dim), strict=True)]
            cut = slice_bounds(dim, slices)[1]
            for at in range(0, counts.pop(dim), block_rows):
                row, ids, cutoffs, cells = (p[at : at + block_rows] for p in parts)
                columns = (row, ids, cutoffs, np.ascontiguousarray(cells[:, :cut]), np.ascontiguousarray(cells[:, cut:]))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], schema=BLOCKS)

        for batch in batches:
            lists = batch.column(3)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            row, ids, cutoffs = (batch.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in range(3))
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                cells = lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(mine), dim)
                held.setdefault(dim, []).append((row[mine], ids[mine], cutoffs[mine], cells))
                counts[dim] = counts.get(dim, 0) + len(mine)
                if counts[dim] >= block_rows:
                    yield from block(dim)
        for dim in list(held):
            yield from block(dim)

    return rows.select("row", "vec_id", "cutoff", "v").mapInArrow(run, "dim int, rows binary, ids binary, cutoffs binary, head binary, tail binary")


def _pairs(queries: DataFrame, candidates: DataFrame, slots: int, *cells: str) -> DataFrame:
    """Each query block next to each candidate block of the same length; of the candidates only the given cells."""
    left = candidates.select(F.col("dim").alias("c_dim"), *[F.col(c).alias(f"c_{c}") for c in ("rows", "ids", *cells)])
    left = left.withColumn("c_slot", F.pmod(F.xxhash64("c_rows"), F.lit(slots)).cast("int"))
    right = queries.select("dim", "rows", "cutoffs", *cells, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    same = (F.col("c_dim") == F.col("dim")) & (F.col("c_slot") == F.col("slot"))
    # a merge join streams the queries and spills the candidates of a slot if they are too many
    return right.join(left.hint("merge"), same).drop("c_slot", "slot", "c_dim")


def slice_scores(q: np.ndarray, c: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """slices x queries x candidates as floats, and a bound of the error of each sum of them."""
    q, c = q.astype(float), c.astype(float)
    bounds = slice_bounds(q.shape[1], slices)
    scores = np.stack([q[:, a:b] @ c[:, a:b].T for a, b in zip(bounds, bounds[1:], strict=False)])
    norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1))[None, :]
    return scores, 4e-16 * (q.shape[1] + 8) * norms


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner product of each row of q with that of c: integers, cut to the range of a long."""
    most = [int(np.abs(x.astype(float)).max(initial=0)) + 1 for x in (q, c)]
    if most[0] * most[1] * max(1, q.shape[1]) < 2**62:
        return (q * c).sum(axis=1)
    totals = [sum(a * b for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), c.tolist(), strict=True)]
    return np.array([max(-LONG - 1, min(LONG, t)) for t in totals], np.int64)


def best_entries(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each row: higher score, then smaller id."""
    order = np.lexsort((ids, ~score if score.dtype == np.int64 else -score, row))
    sorted_rows = row[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), sorted_rows[1:] != sorted_rows[:-1]]))
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


class Best:
    """The k best entries of each query of a few rows: (query row, id, row, score)."""

    def __init__(self, k: int, kind: type):
        self.k, self.held = k, (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, kind))

    def add(self, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        both = [np.concatenate(x) for x in zip(self.held, (query, ids, rows, score), strict=True)]
        stay = best_entries(both[0], both[1], both[3], self.k)
        self.held = tuple(x[stay] for x in both)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.held], ["query_row", "vec_id", "row", "score"])


#: Queries of a block that are scored at once.
FEW = 256


def by_query_block(batches: Iterator[pa.RecordBatch], k: int, kind: type, entries: Callable) -> Iterator[pa.RecordBatch]:
    """The k best entries of each query of each run of pairs with one query block.

    A task meets a query block with all its candidate blocks, one after the other, so it holds the entries
    of one block; ``entries(pair, few)`` gives those of some of its queries.
    """
    current, best = None, []
    for batch in batches:
        for i in range(len(batch)):
            (pair,) = batch.slice(i, 1).to_pylist()
            if pair["rows"] != current:
                yield from (b.batch() for b in best)
                current = pair["rows"]
                best = [Best(k, kind) for _ in range(0, len(current) // 8, FEW)]
            for at, one in enumerate(best):
                for found in entries(pair, slice(FEW * at, FEW * (at + 1))):
                    one.add(*found)
    yield from (b.batch() for b in best)


def _cells(block: dict, before: str, *names: str) -> np.ndarray:
    """The vectors of a block, their given parts side by side."""
    n = len(block[f"{before}rows"]) // 8
    return np.concatenate([np.frombuffer(block[f"{before}{c}"], "<i8").reshape(n, -1) for c in names], axis=1)


def first_entries(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1: each task's k best entries of each query in the score list of the first slice."""

    def entries(pair: dict, few: slice) -> Iterator[tuple]:
        (q_rows, c_rows), c_ids = (np.frombuffer(pair[c], "<i8") for c in ("rows", "c_rows")), np.frombuffer(pair["c_ids"], "<i8")
        scores = _cells(pair, "", "head")[few].astype(float) @ _cells(pair, "c_", "head").astype(float).T
        scores[q_rows[few, None] == c_rows[None, :]] = -np.inf
        top = min(k, len(c_rows))
        col = np.argpartition(-scores, top - 1, axis=1)[:, :top].ravel()
        row = np.repeat(np.arange(len(scores)), top)
        row, col = (x[np.isfinite(scores[row, col])] for x in (row, col))
        yield q_rows[few][row], c_ids[col], c_rows[col], scores[row, col]

    return pairs.mapInArrow(lambda batches: by_query_block(batches, k, float, entries), "query_row long, vec_id long, row long, score double")


def may_reach(q: np.ndarray, c: np.ndarray, cut: np.ndarray, first: int) -> np.ndarray:
    """Which candidates can reach the cutoff of any query, by the first ``first`` components and the norms of the others."""
    q, c = q.astype(float), c.astype(float)
    rest = np.sqrt((q[:, first:] ** 2).sum(axis=1))[:, None] * np.sqrt((c[:, first:] ** 2).sum(axis=1))[None, :]
    norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1))[None, :]
    return (q[:, :first] @ c[:, :first].T + rest >= cut - 8e-16 * (q.shape[1] + 8) * norms).any(axis=0)


def sufficient_entries(pairs: DataFrame, k: int, slices: int) -> DataFrame:
    """Phases 2 and 3: each task's k best entries of each query, of those that can reach its cutoff.

    Candidates that no query of the few can reach, whatever their other slices hold, go after
    the first slice: of them no other is worked out.
    """

    def entries(pair: dict, few: slice) -> Iterator[tuple]:
        (q_rows, c_rows), c_ids = (np.frombuffer(pair[c], "<i8") for c in ("rows", "c_rows")), np.frombuffer(pair["c_ids"], "<i8")
        cutoffs = np.frombuffer(pair["cutoffs"], "<i8")[few]
        q, c = _cells(pair, "", "head", "tail")[few], _cells(pair, "c_", "head", "tail")
        cut = np.where(cutoffs == -LONG - 1, -np.inf, cutoffs.astype(float) * (1 - 4e-16 * np.sign(cutoffs)))[:, None]
        stay = may_reach(q, c, cut, slice_bounds(q.shape[1], slices)[1])
        c, c_rows, c_ids = c[stay], c_rows[stay], c_ids[stay]
        lists, error = slice_scores(q, c, slices)
        open_ = (lists >= cut / slices - error).any(axis=0) & (lists.sum(axis=0) >= cut - error)
        row, col = np.nonzero(open_ & (q_rows[few, None] != c_rows[None, :]))
        for a in range(0, len(row), 1 << 16):
            r, cc = row[a : a + (1 << 16)], col[a : a + (1 << 16)]
            total = exact_scores(q[r], c[cc])
            reached = total >= cutoffs[r]
            yield q_rows[few][r[reached]], c_ids[cc[reached]], c_rows[cc[reached]], total[reached]

    return pairs.mapInArrow(lambda batches: by_query_block(batches, k, np.int64, entries), "query_row long, vec_id long, row long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def resolved_cutoffs(entries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_row, cutoff: the lowest whole score of a query's k entries; none where it has fewer."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, c = (batch.column(i) for i in (1, 2))
            totals = np.zeros(len(batch), np.int64)
            lengths = q.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dim)
                a, b = (x.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), dim) for x in (q, c))
                totals[mine] = exact_scores(a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals)], ["query_row", "score"])

    near = entries.join(rows.select(F.col("row").alias("c_row"), F.col("v").alias("c_v")), F.col("row") == F.col("c_row")).select("query_row", "c_v")
    both = near.join(rows.select(F.col("row").alias("q_row"), "v"), F.col("query_row") == F.col("q_row")).select("query_row", "v", "c_v")
    scores = both.mapInArrow(resolve, "query_row long, score long")
    return scores.groupBy("query_row").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("query_row", "cutoff")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    slices: int = SLICES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    rows = stash(quantised(vectors, id_col, vector_col, scale), "vectors")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nothing = F.lit(-LONG - 1).cast("long").alias("cutoff")
    candidates = stash(_packed(rows.select("*", nothing), slices, block_rows), "vector-blocks")
    queries = rows.where(is_query)
    parts = max(1, -(-queries.count() // block_rows))
    queries = stash(queries.repartition(parts, "row"), "queries")
    # phase 1: the cutoff of each query
    first = _pairs(_packed(queries.select("*", nothing), slices, block_rows), candidates, slots, "head")
    cutoffs = resolved_cutoffs(_ranked(first_entries(first, k), k), rows, k).withColumnRenamed("query_row", "cut_row")
    bounded = queries.join(cutoffs, F.col("row") == F.col("cut_row"), "left")
    bounded = bounded.select("row", "vec_id", "v", F.coalesce("cutoff", nothing).alias("cutoff")).repartition(parts, "row")
    # phases 2 and 3
    last = _pairs(stash(_packed(bounded, slices, block_rows), "query-blocks"), candidates, slots, "head", "tail")
    found = _ranked(sufficient_entries(last, k, slices), k)
    named = found.join(queries.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id")), F.col("query_row") == F.col("q_row"))
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle_sql(k: int = 10, every: int = 100) -> str:
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, c.n AS c_n, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, c_n)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
