"""SimHash near-dedup, fill-in-the-middle and collocations against plain loops over small tables."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomoflow.llm import collocations, fill_in_middle, simhash

SMALL = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, fp string, n long, word string, key long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def table(spark, rows):
    """Rows (doc_id, text, lang) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], KIND)


BASE = "The quick brown fox jumps over the lazy dog and runs away from all the noise of the town "
LONG = BASE * 3000
ODD = [
    (1, None, "en"),
    (2, "", None),
    (3, " \t\r\n", "en"),
    (4, "One", "de"),
    (5, "one", "de"),
    (6, "one Two", "de"),
    (7, "one two three", "de"),
    (8, LONG, "en"),
    (9, LONG + "more words at the end", "en"),
    (None, LONG, "en"),
    (8, "a second row of this id", "en"),
    (10, "naïve café 　 \x1c ÀÉ 日本語 \U0001f600", "fr"),
    (11, "NAÏVE café 　 \x1c ÀÉ 日本語 \U0001f600", "fr"),
    (12, "<P> a text <S> with marks <M>", "en"),
    (13, "<P", "en"),
    (14, "ends with <", "en"),
]


# --- SimHash ---------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=2):
    """Smallest id of each row's component, over all pairs of fingerprints; rows are (id, fingerprint)."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= distance:
            root[find(b)] = find(a)
    ids = defaultdict(list)
    for i, p in prints:
        ids[find(p)].append(i)
    return [(i, p, min((x for x in ids[find(p)] if x is not None), default=None)) for i, p in prints]


def as_rows(result):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in result.collect()), key=str)


def test_simhash_of_odd_rows(spark):
    got = as_rows(simhash.near_duplicates(table(spark, ODD).repartition(3)))
    assert got == sorted(plain_components([(i, plain_fingerprint(t)) for i, t, _ in ODD]), key=str)
    assert simhash.near_duplicates(table(spark, [])).collect() == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_simhash_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert as_rows(simhash.near_duplicates(docs)) == sorted(plain_components(prints), key=str)


@pytest.mark.parametrize("most", [2, 32])
@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_connect_all_that_is_near(spark, distance, most):
    """Clouds of fingerprints around few centres, chains among them, whether keys are crowded or not."""
    rng = random.Random(distance)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    found = simhash.links(fps, distance, blocks=5, most=most).collect()
    root = {v: v for v in values}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in found:
        a, b = r.node % (1 << 64), r.root % (1 << 64)
        root[find(a)] = find(b)
        assert (a ^ b).bit_count() <= distance
    got = defaultdict(set)
    for v in values:
        got[find(v)].add(v)
    want = defaultdict(set)
    for p, _, c in plain_components([(v, v) for v in values], distance):
        want[c].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_shared_blocks_hold_for_every_pair():
    """Pigeonhole: whatever bits differ, one choice of blocks is equal."""
    masks = simhash.block_masks()
    for bits in itertools.combinations(range(64), 2):
        flip = sum(1 << b for b in bits)
        assert any(flip & m == 0 for m in masks)
    assert len(masks) == 10 and all(m.bit_count() in (38, 39) for m in masks)


def test_a_crowded_key_makes_rows_in_proportion(spark):
    """2000 fingerprints that share a block: no row for each pair."""
    fps = spark.range(2000).select(F.expr("id * 3").cast("long").alias("fp"))
    assert simhash.links(fps).count() < 70 * 2000


# --- fill in the middle ----------------------------------------------------------------


def plain_fim(doc_id, text):
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x1cabé　\U0001f600", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_by_bits(text, h1, h2):
    tokens = TOKEN.findall(text)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    assert fill_in_middle.cut(text.encode(), h1, h2) == (len(tokens), len("".join(tokens[:a]).encode()), len("".join(tokens[:b]).encode()))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 2**200))
def test_ranked_bits(bits):
    places = [i for i in range(bits.bit_length()) if bits >> i & 1]
    assert [fill_in_middle.ranked_bit(bits, r) for r in range(1, len(places) + 1)] == places


def test_fill_in_middle(spark):
    rows = [r for i in range(60) for r in [(100 + i, f"  Words é {i} <in> <P \n a\ttext <S{'>' * (i % 2)} and its end{' ' * (i % 3)}", "en")]] + ODD
    made = fill_in_middle.fill_in_middle(table(spark, rows).repartition(3))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(str(tuple(r)[:6]) for r in back) == sorted(str((i, *plain_fim(i, t or ""))) for i, t, _ in rows)
    assert sorted(str((r.doc_id, r.back)) for r in back) == sorted(str((i, t or "")) for i, t, _ in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(table(spark, [])).collect() == []


def test_rates_are_parameters(spark):
    rows = [(i, "some words of a text", "en") for i in range(40)]
    forms = {p: {r.form for r in fill_in_middle.fill_in_middle(table(spark, rows), fim_rate=p[0], spm_rate=p[1]).collect()} for p in ((0, 80), (100, 0), (100, 100))}
    assert forms == {(0, 80): {"plain"}, (100, 0): {"psm"}, (100, 100): {"spm"}}


# --- collocations ----------------------------------------------------------------------


def plain_collocations(rows, least=30, top=2000, longest=4):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p for p, n in f.items() if len(p) > 1 and n >= least}
        longer = Counter()
        for p in candidates:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], f[p])
        found = []
        for p in candidates:
            a = f[p]
            if 100 * longer[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def corpus(seed=3, docs=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "naïve", "état", "in", "a", "日本", "zip\x1cped", "<", "it's", *[f"w{i}" for i in range(25)]]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\x0b"]) for _ in range(60))
        text += " new York City, the the the the the. State of the art! state of the Art"
        rows.append((i, text, rng.choice(["en", "fr", None])))
    return rows


def found_rows(result):
    return sorted(tuple(r) for r in result.collect())


@pytest.mark.parametrize("salt", [16, 1 << 15])
def test_collocations(spark, salt):
    """Counts and ranks by plain loops, with pivots that are spread over salts and without."""
    bounds = collocations.Bounds(salt=salt)
    rows = corpus() + ODD
    got = collocations.collocations(table(spark, rows).repartition(5), bounds=bounds)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found_rows(got) == plain_collocations(rows)
    assert found_rows(collocations.collocations(table(spark, rows), least=5, top=7, bounds=bounds)) == plain_collocations(rows, 5, 7)
    assert collocations.collocations(table(spark, [])).collect() == []


def test_counts_are_exact_whatever_the_slots_hold(spark):
    """Hardly any slots, small chunks and memories: phrases have other owners and the same counts."""
    bounds = collocations.Bounds(salt=64, most_slots=4, chunk_bytes=200, held_fragments=50, held_words=10, mined_fragments=20)
    rows = corpus(4)
    assert found_rows(collocations.collocations(table(spark, rows).repartition(2), least=10, bounds=bounds)) == plain_collocations(rows, 10)
    frequent = collocations.word_counts(table(spark, rows), bounds=bounds).where("n >= 10")
    levels = collocations.word_levels(frequent, bounds)
    assert len(levels.value) == 4 and (levels.value > 0).all()
    assert collocations.fragments(table(spark, rows), levels, bounds=bounds).where("salts > 1 and salt > 0").count() > 0


def test_fragments_give_each_run_once():
    """Each run of up to four words within a piece of frequent words has one owner."""
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        keys = np.array([0, *rng.choices(range(1, 9), k=6)], np.uint64)  # words may share a key
        ids = np.array([rng.randrange(7) for _ in range(rng.randrange(1, 30))], np.int32)
        want = Counter(tuple(ids[i : i + n].tolist()) for n in (2, 3, 4) for i in range(len(ids) - n + 1) if ids[i : i + n].all())
        got = Counter()
        for row in collocations.fragments_of(ids, keys, 3).tolist():
            before, after = sum(x > 0 for x in row[:3]), sum(x > 0 for x in row[4:])
            got.update(tuple(row[3 - a : 4 + b]) for a in range(before + 1) for b in range(after + 1) if 1 <= a + b <= 3)
        assert got == want


def test_scores_pass_64_bits(spark):
    big = 3 * 10**17
    counts = spark.createDataFrame([("en", "a", big + 3), ("en", "b", big + 4), ("en", "a b", big)], "lang string, phrase string, n long")
    row = collocations.scored(counts.where("phrase = 'a b'"), counts).first()
    assert row.score == 2_000_000 * big // (2 * big + 7)
