"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words are laid out as a trie and visited depth first.  Each node holds one
state: the last token of the BPE encoding of its prefix.  A prefix's last token is
the one vocabulary token t that ends there and may follow the last token of the
prefix without t, so a node is worked out from its ancestors' states alone, a shared
prefix is encoded once, and a word's ids are read off by walking back from its end.

Two tokens may stand side by side if no merge ever joins symbols across their
border.  The symbols next to the border are known for every moment of the merging:
the right spine of the left token and the left spine of the right one, each symbol
from its own rank until its parent's.  A merge of two of them that falls into both
lifetimes would cross the border (equal ranks go from left to right).

The trie is kept as its words in sorted order: the sorted list is the depth-first
order, and the states of the current path are a stack that is cut back to the length
shared with the word before.  Words that a worker has met are kept, up to
``MEMO_WORDS``, beyond that only those of the texts at hand; the vocabulary is read from
``tokenizer_path`` by each worker, or given as its text where executors don't have the file.

Text handling follows the vocabulary file: special tokens' strings are cut out of
the raw text first, then NFC, white space to a blank, lower case sign by sign, and
the file's pattern; decoding joins the tokens by blanks, as there is no decoder.
Texts with signs whose class depends on the Unicode version are normalised and split
into words by the tokenizers library, so that they are cut as it cuts them.

Defined results: null text is empty and gives no ids and an empty decoded text; a
null id is kept; rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoflow.llm.common import column, keeps, small_batches, working
from tomoflow.llm.signs import arrow_chunks

MEMO_WORDS = 100_000
#: Pairs of tokens whose neighbourhood a worker remembers.
MEMO_PAIRS = 100_000
#: Texts of about so many bytes are encoded together.
CHUNK_BYTES = 1_000_000
END = "</w>"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Signs outside of these ranges may be letters in one Unicode version and none in another.
UNSETTLED = regex.compile(r"[^\x00-\u0557\u2000-\u208E\u3040-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3]")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself, or the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    signs, free = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in signs:
            signs[b], free = chr(free), free + 1
    return [signs[b] for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and the test whether two tokens may be neighbours."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        # tokens from their last sign to their first, those of word ends apart; "" holds the id
        self.inner_ends: dict = {}
        self.word_ends: dict = {}
        for token, i in self.ids.items():
            node, signs = (self.word_ends, token[: -len(END)]) if token.endswith(END) else (self.inner_ends, token)
            for sign in reversed(signs):
                node = node.setdefault(sign, {})
            node[""] = i
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole, both = self.ids[left + right], (self.ids[left], self.ids[right])
            self.merge[both] = rank
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, both
        self.spines: tuple[dict, dict] = ({}, {})
        self.neighbours: dict[int, bool] = {}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.signs = byte_signs()
        self.bytes_of = {sign: b for b, sign in enumerate(self.signs)}
        self.text = text

    @cached_property
    def library(self) -> tokenizers.Tokenizer:
        """Made for the first text that needs it."""
        return tokenizers.Tokenizer.from_str(self.text)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii() or not UNSETTLED.search(text):
            return WORDS.findall(normalise(text))
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[sign] for sign in word).decode() for word, _ in cut]

    def spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(symbol, rank it is made at, rank it is merged at) on the token's outer edge."""
        known = self.spines[side].get(token)
        if known is None:
            known, symbol, until = [], token, float("inf")
            while True:
                made = self.rank.get(symbol, -1)
                known.append((symbol, made, until))
                if symbol not in self.parts:
                    break
                symbol, until = self.parts[symbol][side], made
            self.spines[side][token] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.neighbours.get(key)
        if known is None:
            known = True
            for a, a_made, a_until in self.spine(left, 1):
                for b, b_made, b_until in self.spine(right, 0):
                    rank = self.merge.get((a, b))
                    if rank is not None and a_made < rank < a_until and b_made < rank <= b_until:
                        known = False
            if len(self.neighbours) >= MEMO_PAIRS:
                self.neighbours.clear()
            self.neighbours[key] = known
        return known

    def last_token(self, path: str, stop: int, ends: dict, states: list[int]) -> int:
        """The last token of the encoding of path[:stop]; ``ends``: the tokens it may be."""
        node, at, found = ends, stop, []
        while at:
            at -= 1
            node = node.get(path[at])
            if node is None:
                break
            token = node.get("")
            if token is not None:
                found.append((at, token))
        neighbours = self.neighbours
        for start, token in reversed(found):
            if start == 0:
                return token
            known = neighbours.get(states[start] << 20 | token)
            if known or known is None and self.may_follow(states[start], token):
                return token
        raise ValueError(f"the vocabulary can't spell {path[:stop]!r}")

    def encode_words(self, words) -> dict[str, list[int]]:
        """Ids of each distinct word, by a depth-first walk of the words' trie."""
        signs = self.signs
        spelled = sorted(("".join([signs[b] for b in w.encode("utf-8", "replace")]), w) for w in words)
        out: dict[str, list[int]] = {}
        states, path = [0], ""
        for spelling, word in spelled:
            inner = len(spelling) - 1  # the last sign carries the end mark and is no inner node
            shared = min(len(os.path.commonprefix([path, spelling])), inner, len(states) - 1)
            del states[shared + 1 :]
            for stop in range(shared + 1, inner + 1):
                states.append(self.last_token(spelling, stop, self.inner_ends, states))
            path = spelling
            ids, stop = [self.last_token(spelling, inner + 1, self.word_ends, states)], inner + 1
            stop -= len(self.tokens[ids[0]]) - len(END)
            while stop:
                ids.append(states[stop])
                stop -= len(self.tokens[ids[-1]])
            ids.reverse()
            out[word] = ids
        return out


def normalise(text: str) -> str:
    """NFC and lower case sign by sign (no final sigma); white space is dropped later."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class Encoder:
    """Encodes texts, keeping what it knows of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.packed: dict[str, bytes] = {}
        self.spelled: dict[str, str] = {}

    def pieces(self, text: str) -> list:
        """Words, and special tokens as their ids."""
        v = self.vocabulary
        if v.special_pattern is None or "<|" not in text:
            return v.words(text)
        out, at = [], 0
        for hit in v.special_pattern.finditer(text):
            out += v.words(text[at : hit.start()])
            out.append(v.specials[hit[0]])
            at = hit.end()
        return out + v.words(text[at:])

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Little-endian 32-bit ids, and the decoded text, of each text."""
        split = [self.pieces(t) for t in texts]
        distinct = set().union(*split)
        new = distinct - self.packed.keys()
        if new:
            if len(self.packed) + len(new) > MEMO_WORDS:
                known = distinct & self.packed.keys()
                self.packed = {w: self.packed[w] for w in known}
                self.spelled = {w: self.spelled[w] for w in known}
            tokens = self.vocabulary.tokens
            ids_of = {i: [i] for i in new if isinstance(i, int)}
            ids_of |= self.vocabulary.encode_words([w for w in new if isinstance(w, str)])
            for word, ids in ids_of.items():
                self.packed[word] = np.array(ids, "<i4").tobytes()
                self.spelled[word] = " ".join([tokens[i] for i in ids])
        packed, spelled = self.packed.__getitem__, self.spelled.__getitem__
        return [b"".join(map(packed, s)) for s in split], [" ".join(map(spelled, s)) for s in split]


_ENCODERS: dict[str, Encoder] = {}
keeps("word_bpe", _ENCODERS.clear)


def encoder(text: str | None, path: str | None) -> Encoder:
    key = path or str(hash(text))
    if key not in _ENCODERS:
        if text is None:
            with open(path, encoding="utf-8") as file:
                text = file.read()
        _ENCODERS[key] = Encoder(Vocabulary(text))
    return _ENCODERS[key]


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    return " ".join(vocabulary.tokens[i] for i in ids)




def encode_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    tokenizer_text: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, ids, decoded."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("word_bpe"):
            own = encoder(tokenizer_text, tokenizer_path)
            for batch in batches:
                doc_ids = batch.column(0)
                for part, texts in arrow_chunks(batch.column(1), CHUNK_BYTES):
                    packed, decoded = own.encode(texts)
                    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
                    flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(part.start, part.stop - part.start), ids, pa.array(decoded, pa.string())],
                        ["doc_id", "ids", "decoded"],
                    )

    rows = docs.select(
        column(docs, id_col, "long").alias("doc_id"), F.coalesce(column(docs, text_col, "string"), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
