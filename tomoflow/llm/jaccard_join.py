"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles of ``words`` (5) consecutive words; a text of
fewer words is one shingle.  Two documents are linked if the Jaccard similarity of
their sets is ``similarity`` (0.8) or more.

A run starts from a path of its own and splits the sets level by level: a set follows
from path p to path (p, t) for each of its shingles t whose hash with p falls below
1 / (similarity * size of the set).  Sets alike share their choices, so linked pairs
follow a common path as a branching process with a mean of one or more, which lives to
level d with a chance q(d); sets unlike part within a few levels.  Sets that end
on one path are a bucket and are compared, all against all.  Runs are repeated until
1 - (1 - q(d))^runs reaches ``recall`` (0.999) for a pair just at the threshold; pairs that
are more alike are found more surely, and a class holds together by any of its links.

All sets are split to the first of ``depths`` (3, 6, 12).  Buckets of more than
``split_above`` sets aren't compared: their sets are split to the next depth, with as many
runs as that depth needs, until buckets are small.  Sets that only share a passage part on
the way, however many have it.  Only what is still large at the last depth, which is sets
that are nearly all alike, is compared as it is, block by block.

A set knows its paths without looking at any other, so all levels of all runs are
computed where the text is read.  What is shuffled is path and set number; only
buckets of two or more sets go on, of buckets with the same members only one, and
only then are the sets themselves brought together.

Copies: documents with equal sets are one *node* with its number of documents, however
many there are.  Buckets are in an order, the largest first.  A pair that meets in
several buckets counts in the first of them, which each side's list of buckets tells; so
links are counted, with the copies on either side, but never listed.  Sets whose first
bucket is the same are compared there and not again: a bucket of none but such sets is
dropped, and in a large bucket the largest group of such sets is compared with the other
sets only.  Large buckets are cut into blocks of about ``block_sets`` sets, or fewer if they
hold more than ``block_shingles`` shingles, and pairs of blocks are compared in separate
tasks.  Rows of hot buckets (more than ``hot_rows``; at most rows / hot_rows of them) meet
their bucket by broadcast, those of others by a shuffled join.  Connectivity leaves a bucket as a spanning forest, and
classes are its connected components (large star, small star; written to the shared
folder in every round).

Defined results
  * a text without words has no shingle and no link; its class is its own.
  * n_links counts documents, copies included; class_id is the smallest id of the class.
  * null text counts as empty; null ids are larger than all others.
  * rows that repeat an id are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoflow.llm.common import column, id_filter, keeps, small_batches, stash, without_listed, working
from tomoflow.llm.signs import arrow_chunks

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
DEPTHS = (3, 6, 12)
BLOCK_SETS = 750
BLOCK_SHINGLES = 1_000_000
SPLIT_ABOVE = 6000
CHUNK_BYTES = 1_000_000
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BASE = 0x100000001B3
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Shingles of a set that are hashed with all its paths at a time.
STRIP = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX1
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as they are needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            cls.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
            cls.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
        return cls.up, cls.down

    @classmethod
    def forget(cls) -> None:
        cls.up = cls.down = np.ones(1, np.uint64)


keeps("jaccard_join", Powers.forget)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    inside = ~SPACE[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    begin, end = edges[::2], edges[1::2]
    up, down = Powers.to(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    word = mixed((total[end] - total[begin]) * down[begin])
    offset = np.cumsum([0, *(len(c) + 1 for c in coded)])
    first = np.searchsorted(begin, offset)
    joined = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for i in range(words):
        joined = (joined + word[i : i + len(joined)]) * MIX1
        joined ^= joined >> np.uint64(31)
    joined = mixed(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            hashes = np.sort(joined[a : b - words + 1])
            out.append(hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for w in word[a:b]:
                short = mixed(short + w)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def survival(mean: float, depth: int) -> float:
    """Chance that a branching process with Poisson offspring lives to level ``depth``."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-mean * q)
    return q


def runs_needed(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(1.0, depth)))


def chosen_paths(shingles: np.ndarray, runs: int, depth: int, similarity: float) -> np.ndarray:
    """The paths on which the set ends, of all runs."""
    paths = mixed(np.arange(1, runs + 1, dtype=np.uint64) * MIX2)
    limit = np.uint64(min(2**64 - 1, int(2**64 / (similarity * max(1, len(shingles))))))
    for _ in range(depth):
        found = []
        for at in range(0, len(shingles), STRIP):
            hashes = (shingles[at : at + STRIP][None, :] ^ paths[:, None]) * MIX1
            hashes = (hashes ^ (hashes >> np.uint64(29))) * MIX2
            found.append(hashes[hashes <= limit])
        paths = mixed(np.concatenate(found)) if found else paths[:0]
        if not len(paths):
            break
    return np.unique(paths)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    a = np.add.reduce(mixed(shingles ^ MIX2), dtype=np.uint64) if len(shingles) else np.uint64(0)
    b = np.add.reduce(mixed(shingles + MIX1), dtype=np.uint64) if len(shingles) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def digest(text: Column) -> Column:
    """Of the text as it is: shingles tell upper from lower case."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def signatures(docs: DataFrame, words: int, runs: int, depth: int, similarity: float, with_digest: bool = False) -> DataFrame:
    """doc_id, row, fingerprint, size, paths and, if asked for, digest of each document, written once."""
    kinds = [("doc_id", pa.int64()), ("row", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("size", pa.int32()), ("paths", pa.list_(pa.int64())), ("sha", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("jaccard_join"):
            for batch in batches:
                ids, rows, shas = (batch.column(i).to_pylist() for i in (0, 1, 3))
                for part, texts in arrow_chunks(batch.column(2), CHUNK_BYTES):
                    sets = shingle_sets(texts, words)
                    prints = [fingerprint(s) for s in sets]
                    paths = [chosen_paths(s, runs, depth, similarity).astype(np.int64) if len(s) else [] for s in sets]
                    columns = [ids[part], rows[part], [p[0] for p in prints], [p[1] for p in prints], [len(s) for s in sets], paths, shas[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text", (digest(F.col("text")) if with_digest else F.lit(None)).cast("binary").alias("sha"))
    return stash(rows.mapInArrow(run, "doc_id long, row long, f1 long, f2 long, size int, paths array<long>, sha binary"), "signatures")


def of_nodes(docs: DataFrame, nodes: DataFrame, words: int, made: Callable[[np.ndarray], bytes]) -> DataFrame:
    """node and ``made`` of its shingles, for the given nodes, from a second reading of the texts.

    Only texts whose id passes a filter of the nodes' ids (of bounded size) are cut into
    shingles; the join by id and fingerprint removes what the filter lets through.
    """
    listed = id_filter(nodes, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("jaccard_join"):
            for batch in batches:
                hits = np.flatnonzero(listed.may_hold(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)))
                ids, texts_ = batch.column(0).take(pa.array(hits)), batch.column(1).take(pa.array(hits))
                for part, texts in arrow_chunks(texts_, CHUNK_BYTES):
                    sets = shingle_sets(texts, words)
                    prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                    own = ids.slice(part.start, part.stop - part.start)
                    yield pa.RecordBatch.from_arrays([own, pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([made(s) for s in sets], pa.binary())], ["s_id", "s_f1", "s_f2", "made"])

    sets = docs.select("doc_id", "text").mapInArrow(run, "s_id long, s_f1 long, s_f2 long, made binary")
    same = (F.col("f1") == F.col("s_f1")) & (F.col("f2") == F.col("s_f2")) & F.col("doc_id").eqNullSafe(F.col("s_id"))
    # rows that repeat an id and its set give the node once
    return nodes.join(sets, same).dropDuplicates(["node"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections (sets x sets)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    spread = np.diff(np.append(first, len(tokens)))
    kept = np.repeat(spread > 1, spread)
    owner, spread = owner[kept], spread[spread > 1]
    out = np.zeros((n, n), np.float32)
    step = max(1, (1 << 22) // n)
    stops = np.cumsum(spread)
    for a in range(0, len(spread), step):
        b = min(len(spread), a + step)
        begin = stops[a - 1] if a else 0
        matrix = np.zeros((n, b - a), np.float32)
        matrix[owner[begin : stops[b - 1]], np.repeat(np.arange(b - a), spread[a:b])] = 1
        out += matrix @ matrix.T
    return out


def compare(sets, copies, lists, blocks, bucket: tuple[int, int], similarity: float):
    """Links of a bucket: (places with links, copies linked to each, root of each in the bucket's forest)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets).astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= similarity * union - 1e-9
    np.fill_diagonal(linked, False)
    if blocks is not None:  # two blocks of a large bucket: only pairs across
        linked &= blocks[:, None] != blocks[None, :]
    if not linked.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    # a pair counts in the first bucket that both sides have: the largest, then the smallest number
    counted = np.zeros((n, n), bool)
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True) if n <= 8 else ():
        counted[i, j] = counted[j, i] = min(lists[i] & lists[j]) == bucket
    if n > 8:
        smaller = {b for s in lists for b in s if b < bucket}
        member = np.array([[b in s for b in smaller] for s in lists], np.float32).reshape(n, len(smaller))
        counted = linked & (member @ member.T == 0)
    amount = counted @ copies
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        if np.array_equal(new, label):
            break
        label = new
    touched = np.flatnonzero(linked.any(axis=1))
    return touched, amount[touched], label[touched]


def _verified(members: DataFrame, similarity: float) -> DataFrame:
    """node, root (a node of its forest in one bucket), links: from members sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("jaccard_join"):
            held, key = [], None
            out: tuple[list, list, list] = ([], [], [])

            def close() -> None:
                if len(held) > 1:
                    nodes = np.array([r["node"] for r in held], np.int64)
                    blocks = np.array([r["block"] for r in held]) if key[1] != key[2] else None
                    lists = [{(-one["n"], one["bucket"]) for one in r["buckets"]} for r in held]
                    touched, amount, label = compare(
                        [np.frombuffer(r["shingles"], np.uint64) for r in held],
                        np.array([r["copies"] for r in held], np.int64),
                        lists,
                        blocks,
                        (-held[0]["n"], key[0]),
                        similarity,
                    )
                    for column_, values in zip(out, (nodes[touched], nodes[label], amount), strict=True):
                        column_.extend(values.tolist())

            def rows() -> pa.RecordBatch:
                batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["node", "root", "links"])
                for c in out:
                    c.clear()
                return batch

            for batch in batches:
                for row in (r for at in range(0, len(batch), 200) for r in batch.slice(at, 200).to_pylist()):
                    this = (row["bucket"], row["low"], row["high"])
                    if this != key:
                        close()
                        held, key = [], this
                    held.append(row)
                if len(out[0]) > 100_000:
                    yield rows()
            close()
            yield rows()

    return members.mapInArrow(run, "node long, root long, links long")


def _with_least(edges: DataFrame, least: DataFrame, hot_rows: int) -> DataFrame:
    """``edges`` (u, v) with m, the least neighbour of u (columns k, m, n of ``least``).

    Hubs of more than ``hot_rows`` edges (at most edges / hot_rows of them) are
    broadcast; their edges get keys of their own in the shuffled join.
    """
    hot = least.where(F.col("n") > hot_rows).select(F.col("k").alias("hot_k"), F.col("m").alias("hot_m"))
    cold = least.where(F.col("n") <= hot_rows).select("k", F.col("m").alias("cold_m"))
    spread = edges.join(F.broadcast(hot), F.col("u") == F.col("hot_k"), "left")
    key = F.when(F.col("hot_k").isNull(), F.col("u")).otherwise(-1 - F.col("v"))  # rows are numbered from 0
    found = spread.withColumn("key", key).join(cold, F.col("key") == F.col("k"), "left")
    return found.select("u", "v", F.coalesce("hot_m", "cold_m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, for nodes with edges."""
    edges = edges.where("node <> root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct()
    edges = stash(edges, "edges")
    before, hot_rows = None, max(1000, edges.count() // 100_000)
    while True:
        # large star: larger neighbours of a node move to its smallest one
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "k")
        large = _with_least(both, least, hot_rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours, and the node, move to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "k")
        small = _with_least(large, least, hot_rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small.union(least.select("k", "m")).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    roots = edges.select(F.col("v").alias("u")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))


def _with_bucket(rows: DataFrame, buckets: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` (with a ``bucket``) next to the columns of their bucket (b, n, ...), those without one left out.

    Hot buckets are broadcast, so that no key of the shuffled join has more than ``hot_rows`` rows.
    """
    hot = buckets.where(F.col("n") > hot_rows)
    by_bucket = F.col("bucket") == F.col("b")
    near = rows.join(F.broadcast(hot), by_bucket)
    others = rows.join(F.broadcast(hot.select("b")), by_bucket, "left_anti")
    return near.union(others.join(buckets.where(F.col("n") <= hot_rows), by_bucket))


def _without_repeats(members: DataFrame, block_sets: int, block_shingles: int, hot_rows: int) -> DataFrame:
    """Members of the buckets (node, bucket, n, size) that still have pairs to compare.

    With the number of blocks for the largest group of sets that share another first
    bucket (``many_blocks``; ``among_many`` marks its sets) and for the others.
    """
    first = members.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("less"), "bucket")).alias("f"))
    tagged = members.join(first.select(F.col("node").alias("f_node"), F.col("f.bucket").alias("first")), F.col("node") == F.col("f_node")).drop("f_node", "n")
    elsewhere = F.col("first") != F.col("bucket")
    groups = tagged.groupBy("bucket", F.when(elsewhere, F.col("first")).alias("first")).agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    most = F.max(F.when(F.col("first").isNotNull(), F.struct("c", "first", "s")))
    sized = groups.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum("s").alias("s"), most.alias("m"))
    many, many_s = F.coalesce("m.c", F.lit(0)), F.coalesce("m.s", F.lit(0))
    large = F.col("n") > block_sets
    heavy = F.col("s") > 2 * block_shingles

    def blocks(count, shingles):
        return F.greatest(F.ceil(count / block_sets), F.ceil(shingles / block_shingles)).cast("int")

    cut = sized.where(many < F.col("n")).select(
        F.col("bucket").alias("b"),
        "n",
        F.when(large | heavy, blocks(F.col("n") - many, F.col("s") - many_s)).otherwise(1).alias("few_blocks"),
        F.when(large | heavy, blocks(many, many_s)).otherwise(0).alias("many_blocks"),
        F.col("m.first").alias("many_first"),
    )
    rows = _with_bucket(tagged, stash(cut, "bucket-blocks"), hot_rows)
    among = (F.col("many_blocks") > 0) & F.coalesce(F.col("first") == F.col("many_first"), F.lit(False))
    return rows.select("node", "bucket", "n", "few_blocks", "many_blocks", among.alias("among_many"))


def buckets_of(paths: DataFrame, hot_rows: int) -> DataFrame:
    """node, size, bucket and its n, for buckets of two or more nodes (node, size, bucket); of those with the same members one."""
    sized = paths.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y")
    )
    buckets = stash(sized.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("b")).select("b", "n"), "buckets")
    return stash(_with_bucket(paths, buckets, hot_rows).select("node", "size", "bucket", "n"), "members")


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    depths: tuple[int, ...] = DEPTHS,
    block_sets: int = BLOCK_SETS,
    block_shingles: int = BLOCK_SHINGLES,
    split_above: int = SPLIT_ABOVE,
    hot_rows: int | None = None,
    with_digest: bool = False,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_shingles, first_of_class; sha of the text if asked for."""
    small_batches(docs.sparkSession)
    docs = docs.select(column(docs, id_col, "long").alias("doc_id"), F.coalesce(column(docs, text_col, "string"), F.lit("")).alias("text"))
    sigs = signatures(docs, words, runs_needed(recall, depths[0]), depths[0], similarity, with_digest)
    total = sigs.count()
    hot_rows = hot_rows or max(1000, total // 100_000)
    # nodes: documents with equal sets; the first one, by id, stands for them
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = sigs.where("size > 0").groupBy("f1", "f2", "size").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = stash(groups.select("f1", "f2", "copies", F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id")), "nodes")

    paths = sigs.join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi")
    paths = stash(paths.select(F.col("row").alias("node"), "size", F.explode("paths").alias("bucket")), "paths")
    members = buckets_of(paths, hot_rows)
    for depth in depths[1:]:
        # what is in large buckets is split further; the small ones are compared
        wide = members.where(F.col("n") > split_above).select("node").distinct()
        wide = stash(nodes.join(wide.withColumnRenamed("node", "w_node"), F.col("node") == F.col("w_node")).select("node", "doc_id", "f1", "f2"), "wide")
        if not wide.limit(1).count():
            break
        runs = runs_needed(recall, depth)
        deeper = of_nodes(docs, wide, words, lambda s: np.append(chosen_paths(s, runs, depth, similarity), np.uint64(len(s))).tobytes())  # noqa: B023

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
                counts = [len(x) - 1 for x in lists]
                columns = (np.repeat(batch.column(0).to_numpy(), counts), np.repeat([x[-1] for x in lists], counts).astype(np.int32), np.concatenate([x[:-1] for x in lists] or [[]]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "size", "bucket"])

        split = stash(deeper.select("node", "made").mapInArrow(unpacked, "node long, size int, bucket long"), "paths")
        members = members.where(F.col("n") <= split_above).union(buckets_of(split, hot_rows))
    members = _without_repeats(members, block_sets, block_shingles, hot_rows)
    one = F.struct("bucket", "n", "few_blocks", "many_blocks", "among_many")
    lists = members.groupBy("node").agg(F.collect_list(one).alias("in"))
    wanted = nodes.join(lists.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"))
    wanted = stash(wanted.select("node", "doc_id", "f1", "f2", "copies", F.col("in").alias("buckets")), "wanted")
    sets = of_nodes(docs, wanted, words, lambda s: s.tobytes()).select("node", "copies", "buckets", F.col("made").alias("shingles"))

    # pairs of blocks of the large buckets; one block of the others
    short = F.transform("buckets", lambda x: F.struct(x["bucket"].alias("bucket"), x["n"].alias("n")))
    placed = sets.select("node", "copies", "shingles", short.alias("buckets"), F.explode("buckets").alias("one"))
    few, many = F.col("one.few_blocks"), F.col("one.many_blocks")
    number = F.xxhash64("node")
    block = F.when(F.col("one.among_many"), few + F.pmod(number, F.greatest(many, F.lit(1)))).otherwise(F.pmod(number, few)).cast("int")
    last = F.when(F.col("one.among_many"), few).otherwise(few + many).cast("int") - 1
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    placed = placed.select(
        F.col("one.bucket").alias("bucket"), F.col("one.n").alias("n"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "buckets", "shingles"
    )
    placed = placed.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = stash(_verified(placed, similarity), "links")

    classes = components(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = classes.join(nodes.select(F.col("node").alias("n_node"), "doc_id"), F.col("node") == F.col("n_node"))
    rooted = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head"))
    headed = classes.join(rooted.withColumnRenamed("root", "r_root"), F.col("root") == F.col("r_root"))
    headed = headed.select(F.col("node").alias("h_node"), F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("head_row"))
    known = nodes.join(headed, F.col("node") == F.col("h_node"), "left").join(links.withColumnRenamed("node", "k_node"), F.col("node") == F.col("k_node"), "left")
    known = known.where("copies > 1 or h_node is not null").select(
        "f1",
        "f2",
        "copies",
        F.when(F.col("h_node").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("head_row", "node").alias("head_row"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    known = stash(known, "known")

    # back to the documents: nodes with many copies (at most rows / hot_rows) are broadcast
    hot = known.where(F.col("copies") > hot_rows).drop("copies").toDF("h1", "h2", "h_class", "h_head", "h_links")
    cold = known.where(F.col("copies") <= hot_rows).drop("copies").toDF("c1", "c2", "c_class", "c_head", "c_links")
    rows = sigs.select("doc_id", "row", "f1", "f2", "size", "sha")
    rows = rows.join(F.broadcast(hot), (F.col("f1") == F.col("h1")) & (F.col("f2") == F.col("h2")) & (F.col("size") > 0), "left")
    alone = F.col("h1").isNotNull() | (F.col("size") == 0)
    rows = rows.withColumn("k1", F.when(alone, F.col("row")).otherwise(F.col("f1"))).withColumn("k2", F.when(alone, F.lit(None)).otherwise(F.col("f2")))
    rows = rows.withColumn("k2", F.coalesce("k2", F.col("row"))).join(cold, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    own = F.coalesce("h_head", "c_head")
    return rows.select(
        "doc_id",
        F.when(F.col("h1").isNotNull(), F.col("h_class")).when(F.col("c1").isNotNull(), F.col("c_class")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("h_links", "c_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("size").alias("n_shingles"),
        (own.isNull() | (own == F.col("row"))).alias("first_of_class"),
        *(["sha"] if with_digest else []),
    )


def keep_one_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns.

    Rows are told by id and text, so null or repeated ids let no near copy through; of rows
    that repeat both, one stays.  Texts without words are classes of their own and all stay.
    """
    classes = jaccard_classes(docs, id_col, text_col, **options, with_digest=True)
    keys = classes.groupBy(F.col("doc_id").alias("k_id"), F.col("sha").alias("k_sha")).agg(
        F.max("first_of_class").alias("stays"), (F.max("n_shingles") > 0).alias("worded"), F.count(F.lit(1)).alias("n")
    )
    # rows that go, and rows that repeat another and of which one stays; all others never meet them
    found = stash(keys.where(~F.col("stays") | (F.col("worded") & (F.col("n") > 1))).select("k_id", "k_sha", "stays"), "not-kept")
    return without_listed(docs, column(docs, id_col, "long"), digest(F.coalesce(column(docs, text_col, "string"), F.lit(""))), found)
