"""Fill-in-the-middle transformation by bit-parallel operations on big integers.

A text is cut into tokens: a word with the white space before it, or white space that ends
the text.  Its UTF-8 bytes become one big integer with a bit a byte: ``bytes.translate``
turns bytes into digits 0 and 1 of a class, ``int(digits, 2)`` into a mask.  White space is
ASCII, so classes of bytes are classes of code points.

    end of a word   word & ~(word >> 1)         a byte of a word before a byte of none
    end of text     the last bit, if white space ends the text
    n               bit_count of both

The prefix ends after the a-th end, the middle after the b-th.  The a-th set bit is found by
recursive halving: bit_count of the lower half tells in which half it is, and the halves'
lengths add up to twice the text's.  Code points are counted by a mask of the bytes that
begin one.  No token is ever listed: a text costs a few passes of its length and eight or so
bits of memory a byte, however long it is.

A document draws from its own id alone (h1 to h4, the first groups of a SHA-256), so results
depend on neither order nor partitions, and a lost task gives the same rows again.  Nothing is
shuffled.

Forms
  plain   the text
  psm     <P>prefix<S>suffix<M>middle
  spm     <S>suffix<P>prefix<M>middle
``restored`` gives the exact text back from output and form.

Defined results
  * null text counts as empty; an empty text is plain and has no tokens.
  * a text that holds a sentinel itself stays plain, so that restoring can't be misled.
  * a null id draws as an empty one; rows that repeat an id draw alike.
  * only the id's and the text's column are read, so further columns can't clash.
  * bytes that are no UTF-8 are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoflow.llm.common import column, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred texts, so many are transformed, and of a hundred of these so many begin with the suffix.
FIM_RATE, SPM_RATE = 50, 80

_SPACES = bytes([*range(9, 14), 32])
#: Digits of a byte's class: part of a word; first byte of a code point.
_WORD = bytes(48 + (b not in _SPACES) for b in range(256))
_FIRST = bytes(48 + (b & 0xC0 != 0x80) for b in range(256))


def mask(data: bytes, digits: bytes) -> int:
    """Bit i tells whether byte i is of the class."""
    return int(data[::-1].translate(digits), 2) if data else 0


def token_ends(data: bytes) -> int:
    """Bit i tells whether a token ends with byte i."""
    if not data:
        return 0
    word = mask(data, _WORD)
    return word & ~(word >> 1) | 1 << len(data) - 1


def ranked_bit(bits: int, rank: int) -> int:
    """Place of the set bit number ``rank`` (from 1)."""
    place, size = 0, bits.bit_length()
    while size > 1:
        half = size // 2
        low = bits & (1 << half) - 1
        below = low.bit_count()
        if rank <= below:
            bits, size = low, half
        else:
            bits, size, rank, place = bits >> half, size - half, rank - below, place + half
    return place


def cut(data: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of tokens, and the bytes at which prefix and middle end."""
    ends = token_ends(data)
    n = ends.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first = ranked_bit(ends, a) + 1 if a else 0
    return n, first, (first if a == b else ranked_bit(ends, b) + 1)


def transformed(data: bytes, h: tuple[int, int, int, int], fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> tuple:
    """n, form, code points of prefix and middle (None if plain), output."""
    sentinels = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    if not data or h[2] % 100 >= fim_rate or any(s in data for s in sentinels):
        return token_ends(data).bit_count(), "plain", None, None, data
    n, a, b = cut(data, h[0], h[1])
    p, s, m = sentinels
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    out = [s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle]
    return n, form, mask(prefix, _FIRST).bit_count(), mask(middle, _FIRST).bit_count(), b"".join(out)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the id's SHA-256, as numbers."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row."""
    small_batches(docs.sparkSession, 500)
    doc_id = column(docs, id_col, "long")
    text = F.coalesce(column(docs, text_col, "string"), F.lit("")).cast("binary")
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            rows = (transformed(data.as_py(), own, fim_rate, spm_rate) for data, own in zip(batch.column(1), h, strict=True))
            parts = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p, t.type) for p, t in zip(parts, list(kinds)[1:], strict=True))], schema=kinds)

    drawn = [h.alias(f"h{i}") for i, h in enumerate(draws(doc_id, seed), 1)]
    rows = docs.select(doc_id.alias("doc_id"), text.alias("data"), *drawn)
    made = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: pieces between the sentinels, back in order."""

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(output, MIDDLE, 1)
        opening = F.substring_index(F.substring_index(head, second, 1), first, -1)
        return opening, F.substring_index(head, second, -1), F.substring_index(output, MIDDLE, -1)

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    suffix_first, prefix_then, _ = pieces(SUFFIX, PREFIX)
    psm = F.concat(prefix, middle, suffix)
    spm = F.concat(prefix_then, middle, suffix_first)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the output and of the text restored from it, in place of the output."""
    own = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256")
    back = F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", own, back)


def oracle_sql(seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> str:
    space, word = r"\x20\x09-\x0D", r"^\x20\x09-\x0D"
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[{space}]*[{word}]+|[{space}]+') AS tokens,
         sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (
  SELECT *, len(tokens) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
         ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {fim_rate} THEN 'plain'
              WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid,
         array_to_string(tokens[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
              ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""
