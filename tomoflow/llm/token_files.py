"""Token files: byte-level BPE ids, compressed shard by shard by Re-Pair.

Documents are range-partitioned and sorted by id, encoded, each closed by the end id,
and cut into shards of about ``shard_ids`` ids; a document is never split.  Re-Pair
runs inside a shard: in every round the frequent id pairs are replaced by new
nonterminals, until no pair occurs ``least`` (8) times; a shorter shard than ``SHARD_IDS``
(500,000) has fewer repeats to find.  Pairs never reach over the end
of a document, so that the symbols of each document stand alone.

A round replaces all pairs above a threshold at once, which halves round by round
from a quarter of the highest count to ``least``; of overlapping occurrences every
second one counts, from left to right.

File format, version 1, little endian.  A file is one row (part, shard, n_docs,
n_ids, payload) of a Parquet table, so that any store Spark writes to holds it.
The payload:
    8 bytes   magic "TFREPAIR"
    6 uint32  version, first nonterminal, documents, rules, symbols, ids
    int64     ids of the documents        (documents)
    uint8     1 where an id is null       (documents)
    uint32    end of each document in the symbols, then in the ids  (2 x documents)
    uint32    left and right side of each rule                      (2 x rules)
    uint32    expansion length of each rule                         (rules)
    uint32    symbols                                               (symbols)
A document is read without its shard's others: its symbols lie between two ends, and
the expansion lengths say where each symbol's ids go.

Encoding goes through tiktoken with the ranks of the same vocabulary, whose ids equal
those of the tokenizers library (tested) at a fifth of the time; the special token's
string is cut out of the text first, as that library does.

Defined results: null text is empty (only the end id); documents without an id come
first; rows that repeat an id are written one after the other, in order of the MD5 of
their texts.  Ranges may begin within the rows of one id, or of one text, so that many
rows without an id, or with the same one, are spread like any others.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomoflow.llm.common import column, small_batches

MAGIC = b"TFREPAIR"
END_ID = 2
SHARD_IDS = 500_000
LEAST = 8
FILES = "part long, shard long, n_docs long, n_ids long, payload binary"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    if ranks_path not in _ENCODINGS:
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODINGS[ranks_path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    return _ENCODINGS[ranks_path]


def encode_text(own: tiktoken.Encoding, text: str) -> np.ndarray:
    """The text's ids; the special token's string counts as the special token."""
    return own.encode_to_numpy(text, allowed_special="all").astype(np.uint32)


#: Bits of the hash table in which a round counts its pairs.
TABLE_BITS = 18


def _places(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place of each pair in the hash table."""
    mixed = left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)
    return (mixed >> np.uint32(32 - TABLE_BITS)).astype(np.intp)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << np.uint64(32) | right


def re_pair(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, ends of the documents in them, and rules (left, right) in order.

    ``ends``: end of each document in ``ids``.  Nonterminal ``first + i`` is rule i.
    Pairs are counted by their place in a hash table first; only those at places that
    reach the threshold are sorted, and counted exactly.
    """
    x = ids.astype(np.uint32)
    last = np.zeros(len(x), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    n_rules, threshold = 0, None
    nowhere = 1 << TABLE_BITS
    slots = np.zeros(nowhere + 1, np.int32)
    while len(x) > 1:
        places = _places(x[:-1], x[1:])
        places[last[:-1]] = nowhere  # no pair over the end of a document
        counts = np.bincount(places, minlength=nowhere + 1)
        counts[nowhere] = 0
        if threshold is None:
            threshold = max(least, int(counts.max()) // 4)
        at = np.flatnonzero((counts >= threshold)[places])
        replaced = 0
        if len(at):
            keys = _pairs(x[at], x[at + 1])
            ordered = np.sort(keys)
            starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            often = np.diff(np.append(starts, len(ordered)))
            chosen = ordered[starts][often >= threshold]
            # of pairs with one place the most frequent; the others wait for the next round
            chosen = chosen[np.argsort(-often[often >= threshold], kind="stable")]
            spots = _places((chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32))
            _, one = np.unique(spots, return_index=True)
            chosen, spots = chosen[one], spots[one]
            slots[spots] = np.arange(1, len(chosen) + 1, dtype=np.int32)
            slot = slots[places[at]]
            slots[spots] = 0
            if len(chosen):
                hit = (slot > 0) & (chosen[slot - 1] == keys)
                at, slot = at[hit], slot[hit]
        if len(at) and len(chosen):
            # in a stretch of consecutive occurrences every second one is replaced
            begins = np.concatenate([[True], np.diff(at) > 1])
            stretch = at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
            odd = (at - stretch) % 2 == 0
            at, slot = at[odd], slot[odd]
            used, inverse = np.unique(slot, return_inverse=True)
            pairs = chosen[used - 1]
            rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
            x[at] = (first + n_rules + inverse).astype(np.uint32)
            n_rules += len(used)
            last[at] = last[at + 1]
            stay = np.ones(len(x), bool)
            stay[at + 1] = False
            x, last, replaced = x[stay], last[stay], len(at)
        if threshold == least and not replaced:
            break
        threshold = max(least, threshold // 2)
    sizes = np.flatnonzero(last) + 1
    symbol_ends = np.zeros(len(ends), np.int64)
    filled = np.diff(ends, prepend=0) > 0
    symbol_ends[filled] = sizes
    symbol_ends = np.maximum.accumulate(symbol_ends)
    return x, symbol_ends, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids that each rule stands for."""
    lengths: list[int] = []
    for left, right in rules.tolist():
        lengths.append(sum(lengths[s - first] if s >= first else 1 for s in (left, right)))
    return np.array(lengths, np.int64)


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of every rule's expansion, and all expansions end to end."""
    flat: list[np.ndarray] = []
    for left, right in rules.tolist():
        sides = [flat[s - first] if s >= first else np.array([s], np.uint32) for s in (left, right)]
        flat.append(np.concatenate(sides))
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    return lengths, np.concatenate(flat) if flat else np.empty(0, np.uint32)


def expand(symbols: np.ndarray, first: int, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    if not len(symbols):
        return np.empty(0, np.uint32)
    rule = symbols.astype(np.int64) - first
    is_rule = rule >= 0
    starts = np.concatenate([[0], np.cumsum(lengths)])
    size = np.ones(len(symbols), np.int64)
    size[is_rule] = lengths[rule[is_rule]]
    # one table: expansions first, then the plain symbols themselves
    begin = np.empty(len(symbols), np.int64)
    begin[is_rule] = starts[:-1][rule[is_rule]]
    plain = symbols[~is_rule]
    begin[~is_rule] = len(flat) + np.arange(len(plain))
    stops = np.cumsum(size)
    places = np.arange(stops[-1]) + np.repeat(begin - (stops - size), size)
    return np.concatenate([flat, plain])[places]


def pack(doc_ids: list, ids: np.ndarray, ends: np.ndarray, first: int) -> bytes:
    symbols, symbol_ends, rules = re_pair(ids, ends, first)
    lengths = expansion_lengths(rules, first)
    nulls = np.array([d is None for d in doc_ids], "u1")
    head = np.array([1, first, len(doc_ids), len(rules), len(symbols), len(ids)], "<u4")
    parts = [
        np.array([0 if d is None else d for d in doc_ids], "<i8"),
        nulls,
        symbol_ends.astype("<u4"),
        ends.astype("<u4"),
        rules.astype("<u4"),
        lengths.astype("<u4"),
        symbols.astype("<u4"),
    ]
    return MAGIC + head.tobytes() + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """Reader of one payload; ``ids(i)`` decodes a single document."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("no token file")
        version, self.first, docs, rules, symbols, self.n_ids = (int(v) for v in np.frombuffer(payload, "<u4", 6, 8))
        if version != 1:
            raise ValueError(f"token file of unknown version {version}")
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        ids = take("<i8", docs)
        nulls = take("u1", docs)
        self.doc_ids = [None if null else int(i) for i, null in zip(ids, nulls, strict=True)]
        self.symbol_ends, self.ends = take("<u4", docs), take("<u4", docs)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.symbols = take("<u4", symbols)
        own, self.flat = expansions(self.rules, self.first)
        if not np.array_equal(own, self.lengths):
            raise ValueError("token file with wrong expansion lengths")

    def ids(self, i: int) -> np.ndarray:
        start = self.symbol_ends[i - 1] if i else 0
        return expand(self.symbols[start : self.symbol_ends[i]], self.first, self.lengths, self.flat)

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.first, self.lengths, self.flat)


def write_token_files(
    docs: DataFrame,
    path: str,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode all documents in ascending order of id and write their files under ``path``."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        own = encoding(ranks_path, pattern)
        first = SPECIAL_ID + 1
        end = np.array([end_id], np.uint32)
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids, pieces, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = pack(doc_ids, np.concatenate(pieces), np.cumsum(sizes), first)
            row = {"part": [part], "shard": [shard], "n_docs": [len(doc_ids)], "n_ids": [held], "payload": [payload]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode_text(own, text.as_py())
                if held and held + len(ids) >= shard_ids:
                    yield close()
                    doc_ids, pieces, sizes, held, shard = [], [], [], 0, shard + 1
                doc_ids.append(doc_id)
                pieces += [ids, end]
                sizes.append(len(ids) + 1)
                held += len(ids) + 1
        if held:
            yield close()

    rows = docs.select(
        column(docs, id_col, "long").alias("doc_id"), F.coalesce(column(docs, text_col, "string"), F.lit("")).alias("text")
    )
    parts = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # equal rows may change places; their numbers only spread them
    order = [F.col("doc_id").asc_nulls_first(), F.md5(F.col("text").cast("binary")).asc()]
    numbered = rows.withColumn("place", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(parts, *order, F.col("place").asc()).sortWithinPartitions(*order)
    ranged.select("doc_id", "text").mapInArrow(run, FILES).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = read_token_files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["payload"])
                ids, ends = file.all_ids().astype("<u4"), file.ends.astype(np.int64)
                if len(ids) != file.n_ids:
                    raise ValueError("token file whose ids are not as many as it says")
                data, starts = memoryview(ids).cast("B"), np.concatenate([[0], ends[:-1]])
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int64()),
                        pa.array([row["shard"]] * n, pa.int64()),
                        pa.array(file.doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array([zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    # ids before each file: parts first, then the shards within a part
    sizes = files.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shard_start"))
    starts = starts.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    rows = files.select("part", "shard", "payload").mapInArrow(
        run, "part long, shard long, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
