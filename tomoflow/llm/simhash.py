"""Near-duplicate detection by SimHash fingerprints and pigeonhole blocks.

A text's fingerprint has a bit set where over half of the 64-bit hashes of its shingles (three
words, repeats included) have it.  Texts are linked if their fingerprints differ in at most
``distance`` (2) bits.

Fingerprints are cut into ``blocks`` (5) blocks of 12 or 13 bits.  ``distance`` differing bits
touch at most ``distance`` blocks, so two linked fingerprints have ``blocks - distance`` (3)
blocks in common.  For each choice of so many blocks (10) a fingerprint has a key of 38 or 39
bits, fingerprints meet in a join on it, and their Hamming distance is verified.

What is joined are distinct fingerprints: copies are one row before anything is paired,
however many they are.  Keys are counted first, with partial counts where the rows are:

  one fingerprint        the key is dropped; most are
  up to ``most`` (32)    the pairs of the key are verified: at most most / 2 a row
  more                   near copies by the thousand, or short texts, would be paired by the
                         square.  Their fingerprints meet halfway instead: each goes to itself
                         and to its 64 neighbours at one bit.  Two that differ in at most two
                         bits share such a place, and all at one place differ in at most two,
                         so each is tied to the smallest there: 65 rows a fingerprint, at most
                         65 at a place.  No link is lost; no task holds a group.

(For other distances than 2 the places are all values within distance // 2 bits, and an odd
distance is verified at the place.)

Classes are the connected components of the links (large star, small star, in rounds that are
written to the shared folder).  Documents learn their class by fingerprint; fingerprints of
very many documents are joined by broadcast, at most ``hot_share`` of them, so a third
of all documents with one fingerprint stays spread.

Defined results
  * null texts count as empty; without a word the fingerprint is 0, linked like any other.
  * a text of one or two words has one shingle, all of it.
  * component_id is the smallest id reachable; null ids never are, if there is another.
  * rows that repeat an id are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoflow.llm.common import column, small_batches, stash
from tomoflow.llm.jaccard_join import components

WORDS, DISTANCE, BLOCKS, MOST, SEED = 3, 2, 5, 32, 42
#: Hashes whose bits are counted at once.
CHUNK = 1 << 14
#: Fingerprints of more than this share of all documents are joined by broadcast: 10,000 rows at most.
HOT_SHARE = 1e-4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(data: bytes, words: int = WORDS) -> Iterator[bytes]:
    """Runs of ``words`` words, joined by a blank; all of a shorter text."""
    found = data.translate(_LOWER).split()
    if len(found) <= words:
        return iter([b" ".join(found)] if found else [])
    return map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bits that over half of the shingles' hashes have, as a signed number of 64 bits."""
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles(data, words)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp of each row."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(data.as_py(), words, seed) for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    text = F.coalesce(column(docs, text_col, "string"), F.lit("")).cast("binary")
    return docs.select(column(docs, id_col, "long").alias("doc_id"), text.alias("data")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Bits of each choice of blocks that two linked fingerprints may have in common."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(own, blocks - distance)]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """choice, key, fp: one row for each choice of blocks."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])
    return fps.select("fp", F.posexplode(keys).alias("choice", "key"))


def verified_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """node, root: pairs that share a key and differ in few bits, the smaller one as root."""
    left, right = (rows.select("choice", "key", F.col("fp").alias(name)) for name in ("root", "node"))
    differing = F.bit_count(F.col("root").bitwiseXOR(F.col("node")))
    met = left.join(right, ["choice", "key"]).where((F.col("root") < F.col("node")) & (differing <= distance))
    return met.select("node", "root")


def halfway_links(fps: DataFrame, distance: int) -> DataFrame:
    """node, root: links of fingerprints that meet at a place within half the distance of both."""
    reach = -(-distance // 2)
    flips = [signed(sum(1 << b for b in bits)) for n in range(reach + 1) for bits in combinations(range(64), n)]
    places = F.array(*[F.lit(f) for f in flips])
    there = fps.select("fp", F.explode(places).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
    if distance % 2 == 0:
        met = there.groupBy("place").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        return met.select(F.explode("fps").alias("node"), F.array_min("fps").alias("root")).where("node <> root")
    left, right = (there.select("place", F.col("fp").alias(name)) for name in ("root", "node"))
    differing = F.bit_count(F.col("root").bitwiseXOR(F.col("node")))
    return left.join(right, "place").where((F.col("root") < F.col("node")) & (differing <= distance)).select("node", "root")


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """node, root: links of distinct fingerprints that connect what is within ``distance``."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("distance must be below the number of blocks")
    rows = keyed(fps, block_masks(blocks, distance))
    counts = stash(rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "block-keys")
    met = stash(rows.join(counts, ["choice", "key"]), "block-rows")
    pairs = verified_pairs(met.where(F.col("n") <= most), distance)
    crowded = met.where(F.col("n") > most).select("fp").distinct()
    return pairs.union(halfway_links(crowded, distance))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """doc_id, fp, component_id of each row."""
    rows = stash(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    fps = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_docs")), "distinct-fingerprints")
    roots = stash(components(links(fps.select("fp"), distance, blocks, most)), "components")
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n_docs", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stash(named.join(least, "root").select(F.col("fp").alias("own_fp"), "n_docs", "component_id"), "classes")
    hot = F.col("n_docs") > F.greatest(F.lit(100.0), F.lit(HOT_SHARE * rows.count()))
    hot_classes = classes.where(hot)
    often = F.broadcast(hot_classes.select(F.col("own_fp").alias("hot_fp"), F.col("component_id").alias("hot_component")))
    split = rows.join(often, F.col("fp") == F.col("hot_fp"), "left")
    spread = split.where("hot_fp is not null").select("doc_id", "fp", F.col("hot_component").alias("component_id"))
    others = split.where("hot_fp is null").join(classes.where(~hot), F.col("fp") == F.col("own_fp")).select("doc_id", "fp", "component_id")
    return spread.union(others)


def as_hex(fp: Column) -> Column:
    """16 lower-case digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
