"""Phrase collocations by pivot partitioning, as in MG-FSM.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and
tabs into words.  Phrases are runs of 2 to ``longest`` (4) words within a piece; those that occur
``least`` (30) times or more in their language are candidates.

1. Words are counted by language, tasks first.  Of words that occur ``least`` times a table of
   levels (a quarter of an octave of their counts) is made, one byte a slot, slots by hash.
   It goes to all tasks: it grows with the frequent words up to ``most_slots`` (64 MB) and stays
   there; a slot that words share has the highest level.  A word of an empty slot is infrequent.
2. Words are in an order: level, then hash.  A phrase belongs to its first word that is lowest
   in it - the *pivot*, up to a quarter of an octave and to shared slots its rarest word.
   Any order gives each phrase one owner, so counts are exact whatever the slots hold; the
   levels only keep frequent words from being pivots.
3. Each word of a text, as a pivot, has a fragment: itself and at most three words on either
   side, ended at an end of the piece, at a word below the pivot and, on the left, at the pivot
   itself.  Infrequent words end every fragment.  Equal fragments are counted together in
   the task that reads the texts, before anything moves.
4. Fragments go to the partition of their pivot and are sorted by it.  There the phrases that
   hold the pivot are counted, some whole pivots at a time, shorter ones first: what is too
   rare isn't made longer.  A pivot of more than ``salt`` occurrences is spread over several
   salts, by fragment, so that a task never holds more; only its phrases are summed once more.
5. A candidate of a occurrences, cut after k words into parts of l and r, scores
   floor(2000000 * a / (l + r)) at its lowest cut; products are decimals of 38 digits.  A
   candidate inside a longer one with 80 % or more of its occurrences is dropped.  The first
   ``top`` (2000) of each language are ranked; tasks pass no more than these on.

A text is read in chunks of about ``chunk_bytes`` that end where a piece ends.

Defined results
  * null text counts as empty; null language as ``und``.
  * overlapping occurrences count; rows that repeat are counted as often as they are there.
  * equal scores: more occurrences first, then the phrase by its bytes.
  * an empty table gives an empty result.  Only language and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomoflow.llm.common import column, small_batches, stash

LEAST, LONGEST, TOP = 30, 4, 2000
#: Score of a phrase whose parts never occur without it.
SCALE = 1_000_000
#: A candidate goes if a longer one has so many hundredths of its occurrences.
WITHIN = 80


@dataclass(frozen=True)
class Bounds:
    """What a task or a partition holds; results don't depend on it."""

    #: occurrences of a pivot for each of its salts
    salt: int = 1 << 18
    #: slots of the table of levels for each frequent word, and of the largest table
    slots_a_word: int = 16
    most_slots: int = 1 << 26
    #: text that is cut into words at once
    chunk_bytes: int = 1 << 22
    #: fragments and words that a task holds before it passes them on
    held_fragments: int = 400_000
    held_words: int = 300_000
    #: fragments that are mined at once; more, if a pivot's salt has more
    mined_fragments: int = 150_000


#: A-Z lower-cased, tabs as blanks, every end of a piece as a full stop.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b",;:!?\n\x0b\x0c\r" else b for b in range(256))


def pieces(data: bytes, chunk_bytes: int) -> Iterator[bytes]:
    """Chunks of the text, prepared: words and full stops between blanks; a chunk ends where a piece ends."""
    data = data.translate(_PLAIN)
    at = 0
    while at < len(data):
        stop = len(data) if len(data) - at <= chunk_bytes else data.find(b".", at + chunk_bytes)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].replace(b".", b" . ")
        at = stop


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(column(docs, lang_col, "string"), F.lit("und"))
    text = F.coalesce(column(docs, text_col, "string"), F.lit("")).cast("binary")
    return docs.select(lang.alias("lang"), text.alias("data"))


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[str, bytes]]:
    """Language and prepared text: whole texts joined to chunks, long ones apart."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for chunk in pieces(data.as_py(), chunk_bytes):
                held.setdefault(lang, []).append(chunk)
                sizes[lang] += len(chunk)
                if sizes[lang] >= chunk_bytes:
                    yield lang, b" . ".join(held.pop(lang))
                    del sizes[lang]
    for lang, chunks in held.items():
        yield lang, b" . ".join(chunks)


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """lang, word, n: occurrences of every word of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                words = pa.array(list(own), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), words, pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for lang, chunk in _chunks(batches, bounds.chunk_bytes):
            own = counts.setdefault(lang, Counter())
            own.update(chunk.split())
            own.pop(b".", None)
            if sum(map(len, counts.values())) > bounds.held_words:
                yield from flushed()
        yield from flushed()

    made = _texts(docs, lang_col, text_col).mapInArrow(run, "lang string, word binary, n long")
    return made.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


class Levels:
    """Level of a word by the slot of its hash; 0: infrequent."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @staticmethod
    def of_count(n: np.ndarray) -> np.ndarray:
        return np.minimum(255, 1 + 4 * np.log2(np.maximum(1, n))).astype(np.uint8)

    def key(self, h: int) -> int:
        """Where a word stands in the order: level, then hash; 0 if infrequent."""
        level = int(self.slots[h & (len(self.slots) - 1)])
        return level << 56 | h >> 8 if level else 0


def salts(level: np.ndarray, salt: int) -> np.ndarray:
    """Number of salts of a pivot by its level: the next power of two of occurrences over ``salt``."""
    octaves = np.ceil((level.astype(float) + 1) / 4 - np.log2(salt))
    return (1 << np.maximum(0, octaves).astype(np.int64)).astype(np.int64)


def word_levels(frequent: DataFrame, bounds: Bounds = Bounds()):
    """Broadcast slots of the words (lang, word, n): made in tasks, the higher level of two stays."""
    size = min(1 << 12, bounds.most_slots)
    n_words = frequent.count()
    while size < min(bounds.most_slots, bounds.slots_a_word * n_words):
        size *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(size, np.uint8)
        for batch in batches:
            words = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            at = np.fromiter((word_hash(lang, word) & (size - 1) for lang, word in words), np.int64, len(batch))
            np.maximum.at(slots, at, Levels.of_count(batch.column(2).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([slots.tobytes()], pa.binary())], ["slots"])

    slots = np.zeros(size, np.uint8)
    parts = frequent.select("lang", F.col("word").cast("binary").alias("word"), "n").coalesce(4).mapInArrow(fill, "slots binary")
    for row in parts.toLocalIterator():
        np.maximum(slots, np.frombuffer(row["slots"], np.uint8), out=slots)
    return frequent.sparkSession.sparkContext.broadcast(slots)


class Words(dict):
    """Numbers of the words of one language that a task has met; infrequent words and ends of pieces are 0."""

    def __init__(self, lang: str, levels: Levels):
        super().__init__({b".": 0})
        self.lang, self.levels = lang, levels
        self.words, self.keys_ = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        key = self.levels.key(word_hash(self.lang, word))
        self[word] = number = len(self.words) if key else 0
        if key:
            self.words.append(word)
            self.keys_.append(key)
        return number


def fragments_of(ids: np.ndarray, keys: np.ndarray, reach: int) -> np.ndarray:
    """One row a pivot: its number in the middle, its neighbours' beside it, 0 beyond the fragment."""
    n = len(ids)
    wide = np.concatenate([np.zeros(reach, ids.dtype), ids, np.zeros(reach, ids.dtype)])
    order = keys[wide]
    own = order[reach : reach + n]
    rows = np.zeros((n, 2 * reach + 1), np.int32)
    rows[:, reach] = ids
    for side in (-1, 1):
        open_ = own > 0
        for step in range(1, reach + 1):
            at = reach + side * step
            near = order[at : at + n]
            open_ = open_ & (near > own if side < 0 else near >= own)
            rows[:, at] = np.where(open_, wide[at : at + n], 0)
    return rows[(own > 0) & ((rows[:, reach - 1] > 0) | (rows[:, reach + 1] > 0))]


def counted(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of n."""
    made, _, total = grouped(rows, n)
    return made, total


def grouped(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the place of each row among them, and the sums of n."""
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = (h ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    if not (rows == rows[first[place]]).all():  # two rows of one hash
        made, place = np.unique(rows, axis=0, return_inverse=True)
        place = place.ravel()
    else:
        made = rows[first]
    # sums below 2^53 are exact as doubles; a task holds no more occurrences than that
    return made, place, np.bincount(place, n, len(made)).astype(np.int64)


def _joined(rows: np.ndarray, words: pa.Array) -> pa.Array:
    """The words of each row, joined by blanks; 0 is none."""
    parts = [words.take(pa.array(rows[:, c])) for c in range(rows.shape[1])]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()), null_handling="skip")


def fragments(docs: DataFrame, levels, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """lang, pivot, salt, salts, before, words, n: each task's distinct fragments of each pivot."""
    reach = longest - 1
    names = ["lang", "pivot", "salt", "salts", "before", "words", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Levels(levels.value)
        known: dict[str, Words] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def combined(lang: str) -> int:
            rows, n = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            held[lang] = [counted(rows, n)]
            return len(held[lang][0][0])

        def flushed(lang: str) -> Iterator[pa.RecordBatch]:
            combined(lang)
            ((rows, n),) = held.pop(lang)
            vocabulary = known.pop(lang)
            words = pa.array([None, *vocabulary.words[1:]], pa.binary())
            level = (np.array(vocabulary.keys_, np.uint64) >> np.uint64(56)).astype(np.int64)
            for at in range(0, len(rows), 50_000):
                few = rows[at : at + 50_000]
                joined = _joined(few, words)
                of = salts(level[few[:, reach]], bounds.salt)
                mixed = few.astype(np.int64) @ (2 * np.arange(few.shape[1]) + 1) if (of > 1).any() else np.zeros(len(few), np.int64)
                before = (few[:, :reach] > 0).sum(axis=1).astype(np.int32)
                columns = [pa.array([lang] * len(few), pa.string()), words.take(pa.array(few[:, reach])), pa.array(mixed % of, pa.int64()), pa.array(of), pa.array(before), joined, pa.array(n[at : at + 50_000])]
                yield pa.RecordBatch.from_arrays(columns, names)

        for lang, chunk in _chunks(batches, bounds.chunk_bytes):
            own = known.setdefault(lang, Words(lang, table))
            tokens = chunk.split()
            ids = np.fromiter(map(own.__getitem__, tokens), np.int32, len(tokens))
            del tokens
            rows = fragments_of(ids, np.array(own.keys_, np.uint64), reach)
            held.setdefault(lang, []).append(counted(rows, np.ones(len(rows), np.int64)))
            if sum(len(r) for r, _ in held[lang]) > bounds.held_fragments and combined(lang) > bounds.held_fragments // 2 or len(own) > bounds.held_words:
                yield from flushed(lang)
        for lang in list(held):
            yield from flushed(lang)

    return _texts(docs, lang_col, text_col).mapInArrow(run, "lang string, pivot binary, salt long, salts long, before int, words binary, n long")


def _places(before: np.ndarray, words: pa.Array, reach: int) -> tuple[np.ndarray, pa.Array]:
    """One row a fragment with the numbers of its words, the pivot in the middle and 0 beyond the fragment; and the words."""
    lists = pc.split_pattern(words, b" ")
    flat = lists.flatten().dictionary_encode()
    lengths = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(before)), lengths)
    begins = np.cumsum(lengths) - lengths
    column = np.arange(len(row)) - np.repeat(begins - reach + before, lengths)
    out = np.zeros((len(before), 2 * reach + 1), np.int32)
    out[row, column] = flat.indices.to_numpy() + 1
    return out, pa.concat_arrays([pa.array([None], pa.binary()), flat.dictionary])


def mined(rows: np.ndarray, lang: np.ndarray, n: np.ndarray, whole: np.ndarray, least: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases that hold the pivots, with their counts: numbers of words (first the language's), n, whether counted wholly.

    Shorter phrases first: where a pivot is counted ``whole``, none is made longer that is too rare.
    """
    frequent = {(0, 0): np.ones(len(rows), bool)}
    for size in range(1, reach + 1):
        for a in range(size + 1):
            b = size - a
            mine = (rows[:, reach - a] > 0) & (rows[:, reach + b] > 0)
            for shorter in ((a - 1, b), (a, b - 1)):
                if min(shorter) >= 0:
                    mine = mine & frequent[shorter]
            at = np.flatnonzero(mine)
            phrases = np.column_stack([lang[at], rows[at, reach - a : reach + b + 1]])
            made, place, total = grouped(phrases, n[at])
            complete = np.zeros(len(made), bool)
            complete[place] = whole[at]
            ok = ~complete | (total >= least)
            frequent[a, b] = np.zeros(len(rows), bool)
            frequent[a, b][at] = ok[place]
            yield made[ok], total[ok], complete[ok]


def owned_phrases(found: DataFrame, least: int = LEAST, longest: int = LONGEST, bounds: Bounds = Bounds()) -> DataFrame:
    """lang, phrase, n: phrases that occur ``least`` times or more, counted at their pivots."""
    reach = longest - 1
    names = ["lang", "phrase", "n", "complete"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            whole = table["salts"].to_numpy() == 1
            langs = table["lang"].combine_chunks().dictionary_encode()
            words = table["words"].combine_chunks()
            rows, vocabulary = _places(table["before"].to_numpy(), words, reach)
            for phrases, n, complete in mined(rows, langs.indices.to_numpy(), table["n"].to_numpy(), whole, least, reach):
                if len(phrases):
                    own = langs.dictionary.take(pa.array(phrases[:, 0]))
                    yield pa.RecordBatch.from_arrays([own, _joined(phrases[:, 1:], vocabulary), pa.array(n), pa.array(complete)], names)

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            """What is held up to the last change of pivot, or all."""
            table = pa.Table.from_batches(held)
            stop = len(table)
            if not last:
                keys = [table[c].combine_chunks() for c in ("pivot", "lang", "salt")]
                same = np.ones(stop - 1, bool)
                for key in keys:
                    same &= pc.equal(key.slice(1), key.slice(0, stop - 1)).to_numpy(zero_copy_only=False)
                changes = np.flatnonzero(~same)
                if not len(changes):
                    return
                stop = int(changes[-1]) + 1
            held[:] = table.slice(stop).to_batches()
            yield from done(table.slice(0, stop))

        size, limit = 0, bounds.mined_fragments
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > limit:
                yield from ready(False)
                size = sum(map(len, held))
                limit = max(bounds.mined_fragments, 2 * size)
        if held:
            yield from ready(True)

    routed = found.repartition("pivot", "lang", "salt").sortWithinPartitions("pivot", "lang", "salt")
    local = routed.mapInArrow(run, "lang string, phrase binary, n long, complete boolean")
    local = stash(local.select("lang", F.col("phrase").cast("string").alias("phrase"), "n", "complete"), "owned-phrases")
    spread = local.where("NOT complete").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return local.where("complete").select("lang", "phrase", "n").union(spread)


def _decimal(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, k, l, r, score of each candidate's lowest cut."""
    parts = F.split("phrase", " ")
    cuts = F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k")
    rows = candidates.select("lang", "phrase", F.col("n").alias("a"), parts.alias("parts"), cuts)
    first, rest = F.array_join(F.slice("parts", 1, F.col("k")), " "), F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts") - F.col("k")), " ")
    rows = rows.select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        own = counts.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p"), F.col("n").alias(name))
        rows = rows.join(own, (F.col("lang") == F.col("p_lang")) & (F.col(part) == F.col("p"))).drop("p_lang", "p", part)
    exact = F.expr(f"cast({2 * SCALE} as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = rows.withColumn("score", exact).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("at"))
    return lowest.select("lang", "phrase", "a", "at.k", "at.l", "at.r", "at.score")


def within_longer(candidates: DataFrame) -> DataFrame:
    """lang, phrase, longer: for runs of words inside longer candidates, most occurrences of these."""
    parts = F.split("phrase", " ")
    size = F.size("parts")
    rows = candidates.select("lang", parts.alias("parts"), "n").where(size > 2)
    lengths = rows.select("lang", "parts", "n", F.explode(F.sequence(F.lit(2), size - 1)).alias("words"))
    begins = lengths.select("lang", "parts", "n", "words", F.explode(F.sequence(F.lit(1), size - F.col("words") + 1)).alias("begin"))
    inner = begins.select("lang", F.array_join(F.slice("parts", F.col("begin"), F.col("words")), " ").alias("phrase"), "n")
    return inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", bounds: Bounds = Bounds()
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language."""
    small_batches(docs.sparkSession, 500)
    words = stash(word_counts(docs, lang_col, text_col, bounds), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    levels = word_levels(frequent, bounds)
    candidates = stash(owned_phrases(fragments(docs, levels, longest, lang_col, text_col, bounds), least, longest, bounds), "candidates")
    counts = frequent.select("lang", F.col("word").alias("phrase"), "n").union(candidates)
    inside = within_longer(candidates).select(F.col("lang").alias("i_lang"), F.col("phrase").alias("i_phrase"), "longer")
    met = candidates.join(inside, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")), "left")
    covered = F.coalesce(100 * _decimal(F.col("longer")) >= WITHIN * _decimal(F.col("n")), F.lit(False))
    rows = scored(met.where(~covered).select("lang", "phrase", "n"), counts)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = best.join(totals.select(F.col("lang").alias("t_lang"), "n"), F.col("lang") == F.col("t_lang"))
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
runs AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS p FROM f WHERE size > 1),
inner_ AS (
  SELECT lang, array_to_string(p[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, p, a, m, unnest(generate_series(1, size - m + 1)) AS i FROM c, (VALUES (2), (3)) s(m) WHERE m < size) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {WITHIN} * a),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(p[1:k], ' ') AS first_, array_to_string(p[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM kept)),
scores AS (
  SELECT c.lang, c.phrase, a, k, x.n AS l, y.n AS r, ({2 * SCALE}::HUGEINT * a // (x.n::HUGEINT + y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_ JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
