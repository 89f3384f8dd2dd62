"""Language-model scoring by context-tree weighting over bytes.

A text is the sequence of its words, joined by one blank, A-Z in lower case, closed by
one end sign (byte 0); the model codes its bytes.  A byte is eight binary decisions;
each decision node (the bits before it) has a context tree over the bytes that come
before, up to ``depth`` of them.  A tree node holds the counts of both bits, with the
Krichevsky-Trofimov estimate P_kt, and its weighted probability

    P_w = P_kt / 2 + (product of the children's P_w) / 2     (P_kt at a leaf).

A bit is predicted by the mix of the estimates at all depths of its context, each by
the posterior weight of its node.  The path ends at the deepest context that training
texts have; the mix of a text's bytes is its probability.

The work is laid out by *grams*: context bytes, the latest first, and the next byte, in
one 64-bit key, so that sorted grams are the tree in depth-first order.  No table of
grams is held as a whole anywhere; all of them grow with the texts.

1. Texts are cut into *chunks* of about ``CHUNK_TEXT`` bytes.  Every chunk counts its
   distinct grams, dealt to buckets by a hash of the three latest context bytes, in more
   buckets than there are shuffle partitions.  Grams of texts that aren't trained on
   count 0: they are looked up, but nothing is learnt from them.
2. A bucket merges its grams and weighs the trees from the deepest contexts up to those
   of three bytes.  The trees below each latest byte take over from there, up to the
   roots of the 255 decisions, which alone go to the driver.
3. The same way back: below each latest byte the mix of the depths up to three, then in
   each bucket the probability of every gram, which goes back to the chunks that have it,
   without the gram: buckets answer in the order in which chunks cut their grams.
4. A chunk cuts its grams again and adds up the probabilities of its texts.

A context that training texts have once is a leaf (``SPLIT`` = 2).  This loses nothing:
all contexts below have the same single event, so their estimates and P_w are its own.
There is no other threshold, and none depends on the size of the data.

Defined results
  * null text is empty: its code is that of the end sign.
  * no training text: every bit costs one bit.
  * rows are independent; repeated rows get equal scores; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import lgamma
from zlib import compress, decompress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoflow.llm.common import column, stash, working

DEPTH = 6
#: A gram, context and next byte, is one key of 64 bits, and 255 in its earliest byte marks what is left out.
MOST_DEPTH = 7
#: Occurrences that a context needs to have contexts below it.
SPLIT = 2
#: Bytes of text that are cut into grams at once, and those of a chunk.
CHUNK_BYTES = 2_000_000
CHUNK_TEXT = 16_000_000
HALF = np.log(0.5)
BYTE = np.uint64(8)
#: Context bytes that decide a gram's bucket.
LATEST = 3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def grams_of(codes: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the texts' bytes, and the number of grams of each text."""
    sizes = np.array([len(c) + 1 for c in codes], np.int64)
    lead = b"\0" * depth
    data = np.frombuffer(b"".join([lead + c + b"\0" for c in codes]), np.uint8)
    key = np.zeros(len(data), np.uint64)
    for back in range(1, depth + 1):
        key <<= BYTE
        key[back:] |= data[:-back]
    key <<= BYTE
    key |= data
    starts = np.concatenate([[0], np.cumsum(sizes + depth)])[:-1]
    mine = np.ones(len(data), bool)
    mine[(starts[:, None] + np.arange(depth)).ravel()] = False
    return key[mine], sizes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: they compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _values(planes: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _split(places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each place, with the positions that have it."""
    order = np.argsort(places, kind="stable")
    cuts = np.flatnonzero(np.diff(places[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(places))[: len(cuts)], strict=True):
        yield int(places[order[a]]), order[a:b]


def pruned(keys: np.ndarray, counts: np.ndarray, depth: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams with what lies below unsplit contexts added up.

    Contexts of up to LATEST bytes count as split.  Bytes beyond the depth that is kept
    become 255, which no text has: below a leaf they are never looked at, and below a
    split context they stand for the contexts that training texts don't have.
    """
    filled, open_ = keys.copy(), np.ones(len(keys), bool)
    for d in range(min(LATEST, depth), depth + 1):
        context = keys >> np.uint64(8 * (depth - d + 1))
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), context[1:] != context[:-1]]))
        total = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))) if len(keys) else counts
        for closing, kept in ((open_ & (total == 0), d - 1), (open_ & (total > 0) & (total < threshold), d)):
            beyond = sum(255 << 8 * (depth - i) for i in range(kept, depth))
            filled[closing] |= np.uint64(beyond)
            open_ &= ~closing
    return summed(filled, counts)


def buckets_of(docs: DataFrame) -> int:
    return 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 61


def place_of(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each (the up to LATEST latest bytes of a) context."""
    return (((contexts * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


CHUNKS = "chunk long, row long, doc_id long, held_out boolean, text binary, place int, grams binary, counts binary"
CHUNK_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]


def cut_in_chunks(docs: DataFrame, held_out: Column, id_col: str, text_col: str, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """The texts (chunk, row, doc_id, held_out, text: words, deflated), and the grams of each chunk by bucket.

    Both are written at once, so that the rows of a chunk stay its rows.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"contexts have 1 to {MOST_DEPTH} bytes, not {depth}")
    buckets, latest = buckets_of(docs), np.uint64(8 * (depth + 1 - min(LATEST, depth)))
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def made(n: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, CHUNK_KINDS, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64))
        held, waiting, size, length = empty, [], 0, 0
        codes, room = {True: [], False: []}, {True: 0, False: 0}

        def merge():
            parts = [held, *waiting]
            return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

        def flush(learn: bool) -> None:
            nonlocal held, waiting, size
            keys, n = distinct(grams_of(codes[learn], depth)[0])
            codes[learn], room[learn] = [], 0
            waiting.append((keys, n if learn else np.zeros(len(n), np.int64)))
            size += len(keys)
            if size > max(len(held[0]), 500_000):
                held, waiting, size = merge(), [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, size, length, chunk
            for learn in (True, False):
                if codes[learn]:
                    flush(learn)
            keys, counts = merge()
            held, waiting, size, length = empty, [], 0, 0
            for place, at in _split(place_of(keys >> latest, buckets)):
                yield made(1, chunk=[chunk], place=[place], grams=[_planes(keys[at])], counts=[_planes(counts[at])])
            chunk += 1

        with working("lm_scoring"):
            for batch in batches:
                rows, ids, out = (batch.column(i).to_pylist() for i in range(3))
                chunks, words = [], []
                for text, held_back in zip(batch.column(3), out, strict=True):
                    words.append(b" ".join(words_of(text.as_py())))
                    chunks.append(chunk)
                    learn = held_back is False
                    codes[learn].append(words[-1])
                    room[learn] += len(words[-1]) + 1
                    length += len(words[-1]) + 1
                    if room[learn] >= CHUNK_BYTES:
                        flush(learn)
                    if length >= CHUNK_TEXT:
                        yield from close()
                if words:
                    yield made(len(words), chunk=chunks, row=rows, doc_id=ids, held_out=out, text=[compress(w, 1) for w in words])
            if length:
                yield from close()

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        column(docs, id_col, "long").alias("doc_id"),
        held_out.alias("held_out"),
        column(docs, text_col, "string").alias("text"),
    )
    both = stash(rows.mapInArrow(cut, CHUNKS), "chunks")
    texts = both.where(F.col("place").isNull()).select("chunk", "row", "doc_id", "held_out", "text")
    return texts, both.where(F.col("place").isNotNull()).select("chunk", "place", "grams", "counts")


def shorter(keys: np.ndarray) -> np.ndarray:
    """The grams without their earliest context byte."""
    return ((keys >> np.uint64(16)) << BYTE) | (keys & np.uint64(255))


class Tree:
    """Tables of grams by depth below one set of latest bytes.

    ``rows[d]``: grams of depth d (context of d bytes, next byte) whose context's parent
    occurs ``threshold`` times and whose context training texts have; ``up[d]``: the row
    of depth d - 1 each belongs to; ``final[d]``: grams that are looked up at depth d;
    ``grams[d]``: all grams of depth d.  Contexts of fewer than ``least`` bytes have
    contexts below them however often they occur here.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, threshold: int, least: int = 0):
        self.depth = depth
        tables = {depth: (keys, counts)}
        for d in range(depth - 1, 0, -1):
            k, c = tables[d + 1]
            tables[d] = summed(shorter(k), c)
        self.grams = {d: t[0] for d, t in tables.items()}
        self.rows, self.counts, self.up, self.final, self.leaf = {}, {}, {}, {}, {}
        for d in range(1, depth + 1):
            k, c = tables[d]
            parent = shorter(k)
            if d == 1:
                inside, at = np.ones(len(k), bool), (k & np.uint64(255)).astype(np.int64)
            else:
                above = self.rows[d - 1]
                at = np.minimum(np.searchsorted(above, parent), max(0, len(above) - 1))
                inside = (above[at] == parent) & ~self.leaf[d - 1][at] if len(above) else np.zeros(len(k), bool)
            k, c, at = k[inside], c[inside], at[inside]
            begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] >> BYTE) != (k[:-1] >> BYTE)]))
            total = np.repeat(np.add.reduceat(c, begins), np.diff(np.append(begins, len(k)))) if len(k) else c
            seen = total > 0
            if d > 1:
                self.final[d - 1][at[~seen]] = True
            k, c, at, total = k[seen], c[seen], at[seen], total[seen]
            self.rows[d], self.counts[d], self.up[d] = k, c, at
            self.leaf[d] = (total < threshold) & (d >= least) if d < depth else np.ones(len(k), bool)
            self.final[d] = self.leaf[d].copy()

    def entries(self) -> int:
        return int(sum(f.sum() for f in self.final.values()))

    def nodes(self, d: int, bit: int):
        """Of decision ``bit``: node of each row, counts (nodes x 2), first row of each node, the row's bit."""
        k = self.rows[d]
        node_key = k >> np.uint64(8 - bit)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), node_key[1:] != node_key[:-1]]))
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
        which = ((k >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        counts = np.bincount(2 * number + which, weights=self.counts[d], minlength=2 * len(first)).reshape(-1, 2)
        return number, counts, first, which

    def weigh(self, bit: int, given: np.ndarray | None = None):
        """(node numbers, counts, first rows, bits, log P_kt, log P_w) by depth.

        ``given``: log P_w of the deepest rows' nodes, by bit, where there are trees below.
        """
        out, below = {}, None
        for d in range(self.depth, 0, -1):
            number, counts, first, which = self.nodes(d, bit)
            kt = log_kt(counts)
            weighted = kt.copy() if given is None or d < self.depth else given[first, bit]
            if d < self.depth and len(first):
                child_first, child_weighted = below
                parents = number[self.up[d + 1][child_first]]
                product = np.bincount(parents, weights=child_weighted, minlength=len(first))
                split = ~self.leaf[d][first]
                weighted[split] = np.logaddexp(HALF + kt[split], HALF + product[split])
            out[d] = (number, counts, first, which, kt, weighted)
            below = (first, weighted)
        return out


@cache
def _lgamma_table() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1024)
    return np.array([lgamma(i + 0.5) - lgamma(0.5) for i in n]), np.array([lgamma(i + 1.0) for i in n])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(counts: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of each row's two counts."""
    half, whole = _lgamma_table()

    def at(table: np.ndarray, n: np.ndarray, shift: float, less: float) -> np.ndarray:
        out = table[np.minimum(n, 1023).astype(np.int64)]
        big = n > 1023
        if big.any():
            out[big] = _stirling(n[big] + shift) - less
        return out

    a, b = counts[:, 0], counts[:, 1]
    return at(half, a, 0.5, lgamma(0.5)) + at(half, b, 0.5, lgamma(0.5)) - at(whole, a + b, 1.0, 0.0)


def estimate(counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The estimate of bit ``which`` after the counts of its row."""
    return (counts[np.arange(len(which)), which] + 0.5) / (counts.sum(axis=1) + 1)


class Roots:
    """The root of each of the 255 decisions: weight of its own estimate, and counts."""

    def __init__(self, by_byte: np.ndarray, children: list[np.ndarray]):
        self.by_byte = by_byte
        self.counts, self.weight = [], []
        for bit in range(8):
            counts = by_byte.reshape(1 << bit, 2, -1).sum(axis=2).astype(float)
            kt = log_kt(counts)
            weighted = np.logaddexp(HALF + kt, HALF + children[bit])
            self.counts.append(counts)
            self.weight.append(np.exp(HALF + kt - weighted))

    def mix(self, byte: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each byte: the root's estimate, its share of the mix, and the share left."""
        node, which = byte >> (8 - bit), (byte >> (7 - bit)) & 1
        own = estimate(self.counts[bit][node], which)
        weight = self.weight[bit][node]
        return own, weight * own, 1 - weight

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """Mix and share left of each byte, by bit."""
        by_bit = [self.mix(np.arange(256), bit)[1:] for bit in range(8)]
        return np.stack([m for m, _ in by_bit], axis=1), np.stack([s for _, s in by_bit], axis=1)

    def alone(self) -> np.ndarray:
        """log10 probability of each byte by the roots' estimates alone."""
        byte = np.arange(256)
        return sum(np.log10(self.mix(byte, bit)[0]) for bit in range(8))


def probabilities(tree: Tree, roots: Roots) -> dict[int, np.ndarray]:
    """log10 probability of each gram, by depth, for the path that ends there."""
    return follow(tree, *roots.state())[0]


def follow(tree: Tree, mixed_by: np.ndarray, left_by: np.ndarray, start: int = 1, given: np.ndarray | None = None):
    """Probabilities as above from depth ``start`` on, and the state of the deepest rows.

    A state is, by row and bit, the mix of the estimates so far and the share that is
    left for deeper contexts; ``mixed_by`` and ``left_by`` are those of depth start - 1.
    """
    out = {d: np.zeros(len(tree.rows[d])) for d in range(start, tree.depth + 1)}
    last = np.empty((2, len(tree.rows[tree.depth]), 8))
    for bit in range(8):
        levels = tree.weigh(bit, given)
        mixed, left = mixed_by[:, bit], left_by[:, bit]
        for d in range(start, tree.depth + 1):
            number, counts, first, which, kt, weighted = levels[d]
            mixed_here, left_here = mixed[tree.up[d]], left[tree.up[d]]
            own = estimate(counts[number], which)
            out[d] += np.log10(mixed_here + left_here * own)
            weight = np.exp(np.minimum(0.0, HALF + kt - weighted))[number]
            mixed, left = mixed_here + left_here * weight * own, left_here * (1 - weight)
        last[0, :, bit], last[1, :, bit] = mixed, left
    return out, last


def of_all_grams(tree: Tree, found: dict[int, np.ndarray], above: np.ndarray, start: int) -> np.ndarray:
    """log10 probability of each of the deepest grams, by the deepest context that training texts have.

    ``above``: that of all grams of depth start - 1 (at depth 0, of the 256 bytes).
    """
    for d in range(start, tree.depth + 1):
        grams = tree.grams[d]
        parents = shorter(grams)
        here = above[parents.astype(np.int64) if d == 1 else np.searchsorted(tree.grams[d - 1], parents)]
        here[np.searchsorted(grams, tree.rows[d])] = found[d]
        above = here
    return above


class Model:
    """Sorted gram tables by depth, with log10 probabilities."""

    def __init__(self, depth: int, tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.depth, self.tables = depth, tables

    def score(self, codes: list[bytes]) -> np.ndarray:
        """log10 probability of each text, end sign included."""
        keys, sizes = grams_of(codes, self.depth)
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        found = np.zeros(len(first), np.float32)
        todo, unique = np.arange(len(first)), ordered[first]
        for d in range(self.depth, -1, -1):
            table, values = self.tables[d]
            if not len(table) or not len(todo):
                continue
            k = unique[todo]
            k = ((k >> np.uint64(8 * (self.depth - d + 1))) << BYTE) | (k & np.uint64(255))
            at = np.minimum(np.searchsorted(table, k), len(table) - 1)
            hit = table[at] == k
            found[todo[hit]] = values[at[hit]]
            todo = todo[~hit]
        each = np.empty(len(keys))
        each[order] = np.repeat(found, np.diff(np.append(first, len(keys))))
        return np.add.reduceat(each, np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([_values(x, "<u8") for x in rows["grams"]])
    return summed(keys, np.concatenate([_values(x, "<i8") for x in rows["counts"]]))


UPPER = "latest int, grams binary, counts binary, weights binary"
STATES = "place int, grams binary, found binary, mixed binary, share binary"


def score_chunks(texts: DataFrame, grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """row, score: log10 probability of each text of ``cut_in_chunks``, end sign included."""
    buckets, cut = buckets_of(texts), min(LATEST, depth)
    latest = np.uint64(8 * (depth + 1 - cut))

    def weigh(key, rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(*_merged(rows), depth, SPLIT, cut)
        # rows of contexts that training texts lack keep weight 0, count 0: they change nothing above
        keys = tree.grams[cut]
        counts, weights = np.zeros(len(keys), np.int64), np.zeros((len(keys), 8))
        at = np.searchsorted(keys, tree.rows[cut])
        counts[at] = tree.counts[cut]
        for bit in range(8):
            number, _, _, _, _, weighted = tree.weigh(bit)[cut]
            weights[at, bit] = weighted[number]
        out = [(b, keys[i].tobytes(), counts[i].tobytes(), weights[i].tobytes()) for b, i in _split((keys >> np.uint64(8 * cut)).astype(np.int64))]
        return pd.DataFrame(out, columns=["latest", "grams", "counts", "weights"])

    upper = stash(grams.groupBy("place").applyInPandas(weigh, UPPER), "upper-grams").groupBy("latest")

    def top(rows: pd.DataFrame) -> tuple[Tree, np.ndarray]:
        """The tree of contexts up to ``cut`` bytes, and the weights of its deepest rows."""
        keys, counts = (np.concatenate([np.frombuffer(x, k) for x in rows[c]]) for c, k in (("grams", "<u8"), ("counts", "<i8")))
        weights = np.concatenate([np.frombuffer(x).reshape(-1, 8) for x in rows["weights"]])
        order = np.argsort(keys)
        tree = Tree(keys[order], counts[order], cut, 1)
        return tree, weights[order][np.searchsorted(keys[order], tree.rows[cut])]

    def root_parts(key, rows: pd.DataFrame) -> pd.DataFrame:
        tree, given = top(rows)
        byte = (tree.rows[1] & np.uint64(255)).astype(np.int64)
        by_byte = np.bincount(byte, weights=tree.counts[1], minlength=256).astype(np.int64)
        children = np.zeros(255)
        for bit in range(8):
            _, _, first, _, _, weighted = tree.weigh(bit, given)[1]
            np.add.at(children, (1 << bit) - 1 + (byte[first] >> (8 - bit)), weighted)
        return pd.DataFrame({"by_byte": [by_byte.tobytes()], "children": [children.tobytes()]})

    collected = upper.applyInPandas(root_parts, "by_byte binary, children binary").collect()
    by_byte = sum((np.frombuffer(r["by_byte"], np.int64) for r in collected), np.zeros(256, np.int64))
    children = sum((np.frombuffer(r["children"]) for r in collected), np.zeros(255))
    roots = Roots(by_byte, [children[(1 << bit) - 1 : (2 << bit) - 1] for bit in range(8)])

    def states(key, rows: pd.DataFrame) -> pd.DataFrame:
        tree, given = top(rows)
        p, last = follow(tree, *roots.state(), given=given)
        keys, found = tree.grams[cut], of_all_grams(tree, p, roots.alone(), 1)
        state = np.zeros((2, len(keys), 8))
        state[:, np.searchsorted(keys, tree.rows[cut])] = last
        out = [(b, keys[i].tobytes(), found[i].tobytes(), state[0, i].tobytes(), state[1, i].tobytes()) for b, i in _split(place_of(keys >> BYTE, buckets))]
        return pd.DataFrame(out, columns=["place", "grams", "found", "mixed", "share"])

    def answer(asked: pd.DataFrame, upper_states: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"chunk": [], "place": [], "values": []})
        keys, counts = _merged(asked)
        tree = Tree(keys, counts, depth, SPLIT, cut)
        above, found = (np.concatenate([np.frombuffer(x, k) for x in upper_states[c]]) for c, k in (("grams", "<u8"), ("found", "<f8")))
        order = np.argsort(above)
        found = found[order]
        at = order[np.searchsorted(above[order], tree.rows[cut])]
        mixed, left = (np.concatenate([np.frombuffer(x).reshape(-1, 8) for x in upper_states[c]])[at] for c in ("mixed", "share"))
        p = follow(tree, mixed, left, cut + 1)[0]
        values = of_all_grams(tree, p, found, cut + 1).astype("<f4")
        out = []
        for chunk, place, one in zip(asked["chunk"], asked["place"], asked["grams"], strict=True):
            out.append((chunk, place, _planes(values[np.searchsorted(keys, _values(one, "<u8"))])))
        return pd.DataFrame(out, columns=["chunk", "place", "values"])

    below = upper.applyInPandas(states, STATES)
    answers = grams.groupBy("place").cogroup(below.groupBy("place")).applyInPandas(answer, "chunk long, place int, values binary")

    def add_up(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        with working("lm_scoring"):
            parts, waiting, size = [], [], 0
            for text in mine["text"]:
                waiting.append(decompress(text))
                size += len(waiting[-1]) + 1
                if size >= CHUNK_BYTES:
                    parts.append(waiting)
                    waiting, size = [], 0
            parts.append(waiting)
            pieces = (distinct(grams_of(p, depth)[0])[0] for p in parts if p)
            keys = reduce(lambda a, b: distinct(np.concatenate([a, b]))[0], pieces)
            order = np.argsort(place_of(keys >> latest, buckets), kind="stable")
            values = np.empty(len(keys), np.float32)
            values[order] = np.concatenate([_values(x, "<f4") for x in answers.sort_values("place")["values"]])
            none = (np.empty(0, np.uint64), np.empty(0, np.float32))
            model = Model(depth, dict.fromkeys(range(depth), none) | {depth: (keys, values)})
            return pd.DataFrame({"row": mine["row"], "score": np.concatenate([model.score(p) for p in parts if p])})

    mine = texts.select("chunk", "row", "text").groupBy("chunk")
    return mine.cogroup(answers.groupBy("chunk")).applyInPandas(add_up, "row long, score double")
