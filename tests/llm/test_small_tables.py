"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tomoflow.llm import context_tree, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, token_files, top_k, toxicity, url_filter, word_bpe
from tomoflow.llm.common import remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, size int, path string, score string, kept int"
EN = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer who wanted to keep his chickens safe this night "
DE = "der schnelle braune Fuchs springt über den faulen Hund und läuft vor dem wütenden Bauern davon der seine Hühner schützen wollte "
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))


def table(spark, rows):
    rows = [(i, t, lang, s, None if t is None else len(t), 1, 2, "p", "s", 3) for i, t, lang, s in rows]
    return spark.createDataFrame(rows, DOCS)


ROWS = [
    (0, EN * 3, "en", "b"),
    (1, EN * 3 + "tonight", "en", "b"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, EN.replace(" ", "\n\t") * 3, "en", "a"),
    (5, DE * 2, "de", "a"),
    (6, DE * 2, "de", None),
    (6, DE * 2, "de", None),
    (7, LONG, None, "c"),
    (None, DE * 2, "de", "c"),
    (None, None, "de", "c"),
    (8, " \n ", "en", "a"),
    (9, "one two", "en", "a"),
    (10, "one two", "en", "a"),
    (11, "123 456 !!", None, "a"),
    (12, "<|endoftext|> Σίσυφος ΑΣ x<|startoftext|>y 🙂 \u088f\u1c89", "el", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs, fan_in=2, hot_rows=2).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, t, _, _ in ROWS:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest()].append(i)
    for sha, ids in groups.items():
        mine = [r for r in got if bytes(r.sha) == sha]
        keep = min(ids, key=lambda i: (i is None, i or 0))
        assert {r.keep_id for r in mine} == {keep} and {r.group_size for r in mine} == {len(ids)}
        assert [r.doc_id for r in mine if r.kept] == [keep]
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    first = {sha: min(ids, key=lambda i: (i is None, i or 0)) for sha, ids in groups.items()}
    assert sorted(str((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).digest())) for r in kept.collect()) == sorted(str((i, sha)) for sha, i in first.items())


def shingles(text):
    w = words(text)
    return frozenset([" ".join(w[k : k + 5]) for k in range(len(w) - 4)] or ([" ".join(w)] if w else []))


def test_jaccard_join_against_all_pairs(spark, empty):
    rng = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(400)]
    rows = list(ROWS)
    base = [list(rng.choice(vocabulary, 120)) for _ in range(6)]
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = "edit" + str(rng.integers(0, 10**6))
        rows.append((100 + i, " ".join(w), "en", "a"))
    docs = table(spark, rows).repartition(3)
    for options in ({}, {"block_sets": 3, "hot_rows": 1}, {"split_above": 6, "block_sets": 4, "block_shingles": 300, "hot_rows": 5}):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_links, r.class_id) for r in jaccard_join.jaccard_classes(docs, **options).collect()), key=str)
        sets = [shingles(t) for _, t, _, _ in rows]
        links = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
        group = list(range(len(rows)))
        for _ in rows:
            group = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(rows))]
        ids = defaultdict(list)
        for i, g in enumerate(group):
            ids[g].append(rows[i][0])
        want = []
        for i, (doc, _, _, _) in enumerate(rows):
            first = min(ids[group[i]], key=lambda x: (x is None, x or 0))
            want.append((doc is None, doc or 0, len(links[i]), first))
        # recall is 0.99 a pair at the threshold: counts may miss a link, classes don't here
        assert sorted((w[:2], w[3]) for w in map(lambda x: (x[0], x[1], x[2], -1 if x[3] is None else x[3]), want)) == sorted((g[:2], g[3]) for g in map(lambda x: (x[0], x[1], x[2], -1 if x[3] is None else x[3]), got))
        found, real = sum(g[2] for g in got), sum(w[2] for w in want)
        assert 0.99 * real <= found <= real
    assert jaccard_join.jaccard_classes(empty).count() == 0
    assert jaccard_join.keep_one_of_class(docs).columns == docs.columns


def test_sets_that_share_a_passage_are_split_apart(spark, monkeypatch):
    """A passage that all have fills buckets; they are split until few unlike sets are compared, and no link is lost."""
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = [f"o{i}x{k}" for k in range(int(rng.integers(30, 60)))]
        rows.append((i, " ".join(passage + own), "en", "a"))
        if i % 10 == 0:
            own[3] = "edit"
            rows.append((1000 + i, " ".join(passage + own), "en", "a"))
    docs = table(spark, rows).repartition(3)
    sets = {i: shingles(t) for i, t, _, _ in rows}
    want = {a: {b for b in sets if b != a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in sets}
    compared = {}
    plain = jaccard_join._verified

    for above in (6000, 20):
        def counted(members, similarity, above=above):
            compared[above] = members.groupBy("bucket", "low", "high").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
            return plain(members, similarity)

        monkeypatch.setattr(jaccard_join, "_verified", counted)
        got = {r.doc_id: r for r in jaccard_join.jaccard_classes(docs, split_above=above).collect()}
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got.values())
        assert all(r.n_links <= len(want[i]) for i, r in got.items()) and found >= 0.9 * sum(map(len, want.values()))
        assert all(got[1000 + i].class_id == i for i in range(0, 300, 10) if got[i].n_links)
    assert compared[20] < compared[6000] / 4, compared


def test_ids_beyond_floats_pass_the_filter(spark):
    from tomoflow.llm.common import split_by_id

    big = 2**62 + 1
    rows = spark.createDataFrame([(big + i,) for i in range(50)] + [(None,)], "id long").repartition(2)
    maybe, clear = split_by_id(rows, F.col("id"), rows.where(f"id >= {big + 40} or id is null"), "id")
    assert {r.id for r in maybe.collect()} >= {big + i for i in range(40, 50)} | {None}
    assert maybe.count() + clear.count() == 51 and clear.count() > 30


def test_one_row_of_each_class_stays(spark):
    rows = [(None, "only this text is like no other one here", "en", "a"), (None, EN * 3, "en", "a"), (None, EN * 3 + "tonight", "en", "a")]
    rows += [(7, DE * 2, "de", "a"), (7, DE * 2, "de", "a"), (7, DE * 2 + "heute", "de", "a"), (7, EN * 3, "en", "a"), (7, (DE * 2).upper(), "de", "a")]
    rows += [(9, " ", "en", "a"), (9, " ", "en", "a"), (9, None, "en", "a")]
    got = [(r.doc_id, r.text) for r in jaccard_join.keep_one_of_class(table(spark, rows).repartition(3)).collect()]
    assert sum((t or "").startswith("only") for _, t in got) == 1
    assert sum((t or "").startswith(EN) for _, t in got) == 1
    assert sum((t or "").startswith(DE) for _, t in got) == 1
    assert sum(t == (DE * 2).upper() for _, t in got) == 1
    assert sorted((i, t or "") for i, t in got if not (t or "").strip()) == [(9, ""), (9, " "), (9, " ")]


def test_shingle_sets_match_plain_ones():
    texts = ["", "a", "a b c d", "a b c d e", "a b c d e f a b c d e", "ä\x0bö\x1cü x\ty z ", LONG]
    sets = jaccard_join.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert np.isin(sets[3], sets[4]).all()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double, dim int")


def brute_top_k(rows, every, k):
    """Every row's vector is one candidate, repeated ids included; whole numbers, cut to the range of a long."""
    fit = [(i, [max(-(2**63), min(2**63 - 1, math.floor(1024 * float(np.float32(x))))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (q, v) in enumerate(fit):
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i) for b, (i, w) in enumerate(fit) if a != b and len(w) == len(v))[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(want)


def found_top_k(spark, rows, every, k, **options):
    got = top_k.top_k(vectors(spark, [(i, v, 1, 1.0, 2) for i, v in rows]), F.col("vec_id") % every == 0, k=k, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=9)]) for i in range(150)]
    rows += [(i, [0.5] * 9) for i in range(150, 210)]
    rows += [(300, None), (400, [float("nan")] * 9), (500, [None] * 9), (600, [float("inf")] * 9), (None, [1.0] * 9), (700, [1.0, 2.0]), (701, [1.0, 2.0]), (800, []), (801, [])]
    rows += [(0, rows[0][1]), (0, [3.0] * 9), (7, [float(x) for x in rng.normal(size=9)]), (40, rows[40][1])]
    assert found_top_k(spark, rows, 10, 5, block_rows=40) == brute_top_k(rows, 10, 5)
    assert found_top_k(spark, [], 10, 5) == []
    assert found_top_k(spark, [(0, [1e17, 1.0]), (1, [-1e17, 3.0])], 10, 5) == [(0, 1, 1, -(2**63))]


@pytest.mark.parametrize("size", [1e4, 2e5, 1e9, 1e15])
def test_top_k_is_exact_where_floats_are_not(spark, size):
    """Scores above 2^53 and beyond a long, many of them equal or one apart at the cutoff."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=8) * size
    rows = [(i, [float(x) for x in base + rng.integers(-1, 2, 8)]) for i in range(120)]
    rows += [(200 + i, [float(x) for x in -base]) for i in range(5)] + [(300 + i, rows[i % 3][1]) for i in range(40)]
    assert found_top_k(spark, rows, 25, 10, block_rows=32) == brute_top_k(rows, 25, 10)


def test_url_filter(spark):
    rows = [
        (1, "https://WWW.Example.com/en/x?q"),
        (2, "http://example.com/en/"),
        (3, "http://a.b.example.com/en#f"),
        (4, None),
        (None, "no scheme"),
        (5, "x://example.net/fr/1"),
        (5, "x://example.net/fr/1"),
        (6, "x://net/es/"),
        (7, "x://" + "a." * 5000 + "com/" + "p" * 5000),
        (8, "x://notexample.com?/en/"),
        (9, "x://"),
        (10, "x://comet.org/es/"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "p", "v") for i, u in rows], "page_id long, url string, host string, path string, verdict string")

    def brute(url, rules):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    more = url_filter.RULES + [(f"site{i}.example.org", f"/{i}/", "block") for i in range(3000)]
    for rules in (url_filter.RULES, more, []):
        got = url_filter.judge_urls(pages, url_filter.rules_table(spark, rules), max_blocks=16).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *brute(u, rules))) for i, u in rows)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_url_filter_with_a_long_list(spark):
    """A list of 200,000 rules; the filter lets few urls through that aren't listed."""
    rules = spark.range(200_000).select(F.concat(F.lit("h"), "id", F.lit(".example.org")).alias("r_host"), F.lit("/a/").alias("r_path"), F.lit("block").alias("r_verdict"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://x.h"), F.col("id") * 199, F.lit(".example.org/a/b")).alias("url"))
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: "block" if i * 199 < 200_000 else "allow" for i in range(2000)}
    filled = url_filter.bloom_blocks(rules, "r_host", 1 << 13)
    other = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("k"))
    assert url_filter.maybe_listed(other, "k", filled, 1 << 13).count() < 200
    assert url_filter.maybe_listed(rules, "r_host", filled, 1 << 13).count() == 200_000


def test_toxicity(spark, docs, empty):
    insults = ["grumbo", "zlatty", "vorkel"]
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(EN.split(), 40))
        toxic = i % 5 == 0
        if toxic:
            for k in rng.integers(0, 40, 3):
                w[int(k)] = str(rng.choice(insults))
        rows.append((i, " ".join(w) + ".", "en", "a"))
        labels.append((i, 1, int(toxic)))
    schema = "doc_id long, quality int, toxic int"
    labelled = table(spark, rows)
    field = toxicity.train(labelled.where(remainder(F.col("doc_id"), 4) != 2), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], schema))
    scored = {r.doc_id: r for r in toxicity.score_documents(labelled, field).collect()}
    assert all((scored[i].score >= 0.3) == bool(t) for i, _, t in labels)
    text = rows[0][1]
    assert scored[0].spans and all(any(x in text[s.start : s.end] for x in insults) for s in scored[0].spans)
    assert toxicity.score_documents(docs, field).count() == len(ROWS)
    assert toxicity.score_documents(empty, field).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, toxicity.train(empty, spark.createDataFrame([], schema))).collect()} == {0.0}


def test_rare_toxic_words_are_learnt_and_near_copies_count_once():
    rng = np.random.default_rng(21)
    common, toxic_words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}lo" for i in range(300)], ["grumbo"] * 30 + ["zlatty"]
    texts, labels = [], []
    for i in range(2400):
        w = list(rng.choice(common, 40))
        if i % 2:
            w[int(rng.integers(0, 40))] = "grumbo" if i % 160 != 1 else "zlatty"
        texts.append(" ".join(w))
        labels.append(bool(i % 2))
    copied = list(rng.choice(common, 60))
    for i in range(40):  # near copies of one toxic text with a harmless name in it
        w = [*copied, "grumbo", "annabel"]
        w[i] = "other"
        texts.append(" ".join(w))
        labels.append(True)
    field = toxicity.fit(texts, np.array(labels))
    scores = field.score([" ".join(common[5:30]) + " zlatty", " ".join(common[40:60]) + " annabel", " ".join(common[10:50])])[0]
    assert scores[0] >= 0.3 and scores[1] < 0.3 and scores[2] < 0.3, scores


def plain_toxicity(field, text):
    """A document's score with plain loops: features, forward-backward in each chain, logistic function."""
    mask, factor = (1 << 64) - 1, 0x9E3779B97F4A7C15
    chain, chains, last = [], [], None
    for found in re.finditer(r"[^\W\d_]+", text):
        if last is not None and (len(chain) == toxicity.CHAIN or re.search(r"[.!?\n]", text[last : found.start()])):
            chains.append(chain)
            chain = []
        chain.append("".join(x.lower() for x in found[0]))
        last = found.end()
    chains = [c for c in [*chains, chain] if c]
    marginals = []
    for words_ in chains:
        odds = []
        for word in words_:
            state, total = 0xCBF29CE484222325, field.bias
            for k, sign in enumerate(word, 1):
                state = (state ^ ord(sign)) * factor & mask
                state ^= state >> 29
                if k in toxicity.BEGINNINGS:
                    total += float(field.weights[((state + k) * factor & mask) >> 46])
            odds.append(math.exp(total + float(field.weights[((state + 1000) * factor & mask) >> 46])))
        n, links, start = len(odds), np.exp(field.links), np.exp(field.start)
        forward, backward = [None] * n, [np.ones(2)] * n
        for t in range(n):
            forward[t] = (start if t == 0 else forward[t - 1] @ links) * np.array([1, odds[t]])
            forward[t] = forward[t] / forward[t].sum()
        for t in range(n - 2, -1, -1):
            backward[t] = links @ (backward[t + 1] * np.array([1, odds[t + 1]]))
            backward[t] = backward[t] / backward[t].sum()
        marginals += [float((f * b)[1] / (f * b).sum()) for f, b in zip(forward, backward)]
    top = sorted(marginals, reverse=True)[:2] + [0.0, 0.0]
    x = np.array([math.log1p(sum(marginals)), top[0], top[1], 1.0])
    return 1 / (1 + math.exp(-float(x @ field.logistic)))


def test_toxicity_scores_against_plain_loops(spark, docs):
    rng = np.random.default_rng(22)
    field = toxicity.Field()
    field.weights[:-1] = rng.normal(size=toxicity.BUCKETS)
    field.links, field.start, field.logistic = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=4)
    got = sorted((str(r.doc_id), round(r.score, 5)) for r in toxicity.score_documents(docs, field).collect())
    want = sorted((str(i), round(plain_toxicity(field, t or ""), 5)) for i, t, _, _ in ROWS)
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-4 for g, w in zip(got, want)), (got, want)


def test_samples_are_bounded_by_distinct_texts(spark, monkeypatch):
    """Rows that repeat an id, or have none, don't let more than the bound into a training sample."""
    rows = [(1, f"{EN} same id {i}", "en", "a") for i in range(300)] + [(None, f"{DE} ohne {i}", "de", "a") for i in range(300)] + [(2, EN, "en", "a")] * 200
    docs = table(spark, rows).repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")

    def fit(texts, toxic):
        field = toxicity.Field()
        field.constant = float(len(texts))
        return field

    monkeypatch.setattr(toxicity, "fit", fit)
    field = toxicity.train(docs, labels, sample_docs=50)
    assert field.constant == 50
    model = language_id.train(docs, docs_per_lang=20)
    assert model.langs == ["de", "en"] and model.logp.shape == (language_id.BINS, 2)


def plain_language(texts, trained, bins, penalty):
    """Languages and scores with plain loops: triple counts, word scores, Viterbi."""
    mask = (1 << 32) - 1

    def words_(text):
        return [m[0] for m in re.finditer(r"[^\W\d_]+", text)]

    def triple(a, b, c):
        h = b * 0x9E3779B1 & mask
        h ^= a * 0x85EBCA77 & mask
        h ^= c * 0xC2B2AE3D & mask
        h ^= h >> 15
        return (h * 0x27D4EB2F & mask) >> 8

    def triples_(word):
        codes = [0, *(ord(x.lower()) for x in word), 0]
        return [triple(*codes[k - 1 : k + 2]) % bins for k in range(1, len(codes) - 1)]

    langs = sorted({lang for _, lang in trained})
    counts, scripts = defaultdict(Counter), defaultdict(Counter)

    def script(sign):
        return next((name for name, a, b in language_id.SCRIPTS if a <= ord(sign) <= b), "other")

    for text, lang in trained:
        for word in words_(text):
            counts[lang].update(triples_(word))
            scripts[lang].update(script(x) for x in word)
    out = []
    for text in texts:
        best, letters, path = None, [], []
        for word in words_(text):
            score = []
            for lang in langs:
                total = sum(counts[lang].values())
                score.append(sum(math.log((counts[lang][b] + 0.1) / (total + 0.1 * bins)) for b in triples_(word)))
            here = script(word[0])
            if not any(scripts[lang][here] for lang in langs):
                score = [0.0] * len(langs)
            share = [scripts[lang][here] / max(1, sum(scripts[lang].values())) for lang in langs]
            if any(x >= 0.01 for x in share):
                score = [s if x >= 0.01 else s - 1e6 for s, x in zip(score, share)]
            score = [s - max(score) for s in score]
            score = [s if s < -1e5 else max(s, language_id.FLOOR) for s in score]
            letters.append(len(word))
            if best is None:
                best, path = score, [[k] for k in range(len(langs))]
            else:
                came = [max(range(len(langs)), key=lambda j: best[j] - penalty * (j != k)) for k in range(len(langs))]
                best, path = [best[j] - penalty * (j != k) + score[k] for k, j in enumerate(came)], [path[j] + [k] for k, j in enumerate(came)]
        if best is None:
            out.append(("und", 0.0))
            continue
        labels = path[max(range(len(langs)), key=best.__getitem__)]
        held = [sum(n for n, k in zip(letters, labels) if k == lang) for lang in range(len(langs))]
        out.append((langs[held.index(max(held))], max(held) / sum(held)))
    return out


def test_language_id_against_plain_loops(spark, docs):
    other = "быстрая рыжая лиса прыгает через ленивую собаку и убегает "
    rows = [(i, [EN, DE, other][i % 3] + f" n{chr(97 + i % 26)}", ["en", "de", "ru"][i % 3], "a") for i in range(45)]
    bins = 1 << 12
    model = language_id.train(table(spark, rows), bins=bins)
    texts = [t or "" for _, t, _, _ in ROWS] + [EN + other, DE[:60] + EN + DE]
    both = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_documents(both, model).collect()}
    want = plain_language(texts, [(t, lang) for _, t, lang, _ in rows], bins, language_id.SWITCH_PENALTY)
    assert all(got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-9 for i, w in enumerate(want)), (got, want)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    field = toxicity.Field()
    field.links, field.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    emission, begins = rng.normal(size=7), np.array([0, 4])
    got = field.marginals(emission, begins)
    for a, b in ((0, 4), (4, 7)):
        weights = np.zeros(2 ** (b - a))
        tags = [[(n >> i) & 1 for i in range(b - a)] for n in range(len(weights))]
        for n, t in enumerate(tags):
            weights[n] = np.exp(field.start[t[0]] + sum(field.links[x, y] for x, y in zip(t, t[1:])) + sum(emission[a + i] * y for i, y in enumerate(t)))
        want = (weights[:, None] * np.array(tags)).sum(axis=0) / weights.sum()
        assert np.allclose(got[a:b], want)


def test_mixing(docs, empty):
    got = mixing.mix(docs, shard_words=50, block_words=4).collect()
    assert len(got) == len(ROWS)
    sizes = defaultdict(int)
    for _, t, _, s in ROWS:
        sizes[s] += len(words(t))
    # targets by resharing until no source is above its cap
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        level = rest / max(1e-9, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in names:
        mine = [r for r in got if r.source == s]
        target = 2 * sizes[s] if s in capped else level * weight[s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 4 * 3 + 0.02 * target
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(docs.repartition(5), shard_words=50, block_words=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs, shard_words=50, block_words=4)
    assert mixed.columns == docs.columns
    # each document as often as the mix has it; rows that repeat an id, a source and a size alike
    copies = defaultdict(list)
    for r in got:
        copies[str((r.doc_id, r.source, r.size))].append(r.whole_copies)
    seen = Counter(str((r.doc_id, r.source, len(words(r.text)))) for r in mixed.collect())
    for key, each in copies.items():
        assert seen[key] == max(each) * len(each), (key, each)


def test_mixed_documents_are_those_of_the_mix(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), "en", "abcd"[min(3, i % 7)]) for i in range(900)]
    docs = table(spark, rows).repartition(4)
    for options in ({}, {"shard_words": 300, "block_words": 5}, {"shard_words": 2000, "share": 0.7}):
        want = Counter({r.doc_id: r.whole_copies for r in mixing.mix(docs, **options).collect() if r.whole_copies})
        assert Counter(r.doc_id for r in mixing.mixed_documents(docs, **options).collect()) == want


def test_sainte_lague_against_one_seat_at_a_time(spark):
    rng = np.random.default_rng(4)
    for parties in (1, 7, 40):
        weights = [float(w) for w in rng.integers(0, 1000, parties)] + [5e6]
        seats = 523
        won = [0] * len(weights)
        for _ in range(seats):
            best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        table_ = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "party int, weight double, seats long")
        got = {r.party: r.won for r in mixing.sainte_lague(table_, [], "party", "weight", "seats").collect()}
        assert got == dict(enumerate(won))


def test_context_tree_against_sequences():
    """Weights and predictions against the recursion written out, on a tiny alphabet and depth 2."""
    train, other = [b"abcabcabd", b"abab"], [b"abx"]
    depth = 2
    keys, n = context_tree.distinct(context_tree.grams_of(train, depth)[0])
    held = context_tree.distinct(context_tree.grams_of(other, depth)[0])[0]
    keys, n = context_tree.summed(np.concatenate([keys, held]), np.concatenate([n, np.zeros(len(held), np.int64)]))
    tree = context_tree.Tree(keys, n, depth, 1)
    by_byte = np.bincount((tree.rows[1] & np.uint64(255)).astype(int), weights=tree.counts[1], minlength=256)
    children = []
    for bit in range(8):
        _, _, first, _, _, weighted = tree.weigh(bit)[1]
        byte = (tree.rows[1] & np.uint64(255)).astype(int)
        children.append(np.bincount(byte[first] >> (8 - bit), weights=weighted, minlength=1 << bit))
    roots = context_tree.Roots(by_byte, children)
    p = context_tree.probabilities(tree, roots)
    tables = {0: (np.arange(256, dtype=np.uint64), roots.alone())} | {d: (tree.rows[d][f], p[d][f]) for d, f in tree.final.items()}
    model = context_tree.Model(depth, tables)

    seen = Counter()  # (context, latest byte first; decision; bit)
    for text in train:
        data = b"\0\0" + text + b"\0"
        for i in range(2, len(data)):
            for d in range(3):
                context = data[i - d : i][::-1]
                for bit in range(8):
                    seen[context, (1 << bit) + (data[i] >> (8 - bit)), (data[i] >> (7 - bit)) & 1] += 1
    contexts = {c for c, _, _ in seen}

    def kt(c, u):
        return context_tree.log_kt(np.array([[seen[c, u, 0], seen[c, u, 1]]], float))[0]

    def weighted(c, u):
        if len(c) == depth:
            return kt(c, u)
        inner = sum(weighted(c + bytes([b]), u) for b in range(256) if c + bytes([b]) in contexts)
        return np.logaddexp(np.log(0.5) + kt(c, u), np.log(0.5) + inner)

    def plain(text):
        data, total = b"\0\0" + text + b"\0", 0.0
        for i in range(2, len(data)):
            for bit in range(8):
                u, y, value = (1 << bit) + (data[i] >> (8 - bit)), (data[i] >> (7 - bit)) & 1, None
                for d in (2, 1, 0):
                    c = data[i - d : i][::-1]
                    if c not in contexts:
                        continue
                    own = (seen[c, u, y] + 0.5) / (seen[c, u, 0] + seen[c, u, 1] + 1)
                    if value is None:
                        value = own
                    else:
                        w = np.exp(np.log(0.5) + kt(c, u) - weighted(c, u))
                        value = w * own + (1 - w) * value
                total += np.log10(value)
        return total

    for text in train + other:
        assert abs(float(model.score([text])[0]) - plain(text)) < 1e-4


@pytest.mark.parametrize("threshold", [1, 3, 20, 1000])
def test_pruned_grams_give_the_same_tables(threshold):
    rng = np.random.default_rng(8)
    texts = [bytes(rng.choice(list(b"abc d"), 400).tolist()) for _ in range(6)]
    depth = 5
    keys, n = context_tree.distinct(context_tree.grams_of(texts[:4], depth)[0])
    held = context_tree.distinct(context_tree.grams_of(texts[4:], depth)[0])[0]
    keys, n = context_tree.summed(np.concatenate([keys, held]), np.concatenate([n, np.zeros(len(held), np.int64)]))
    small = context_tree.pruned(keys, n, depth, threshold)
    assert len(small[0]) <= len(keys) and small[1].sum() == n.sum()
    a, b = (context_tree.Tree(*g, depth, threshold) for g in ((keys, n), small))
    roots = context_tree.Roots(np.bincount((keys & np.uint64(255)).astype(int), weights=n, minlength=256), [np.zeros(1 << k) - 1e4 for k in range(8)])
    p, q = context_tree.probabilities(a, roots), context_tree.probabilities(b, roots)
    for d in range(1, depth + 1):
        assert np.array_equal(a.rows[d][a.final[d]], b.rows[d][b.final[d]])
        assert np.allclose(p[d][a.final[d]], q[d][b.final[d]])


def test_lm_scoring(docs, empty):
    held = remainder(F.col("doc_id"), 10) == 0
    got = lm_scoring.score_documents(docs, held, head_words=3).collect()
    assert len(got) == len(ROWS)
    tokens = Counter()

    def out(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0

    def split(t):
        return [w.encode().lower() for w in words(t)] + [b""]

    for i, t, _, _ in ROWS:
        if not out(i):
            tokens.update(split(t))
    n, v = sum(tokens.values()), len(tokens)
    want = []
    for i, t, _, _ in ROWS:
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t))
        want.append((str(i), out(i), len(split(t)), sum(tokens[w] > 0 for w in split(t)), n, round(base, 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_documents(empty, held).count() == 0


def whole_tree_scores(texts, trained, depth=context_tree.DEPTH):
    """Scores of texts by one tree of all grams that splits every context."""
    codes = [t.encode() for t in texts]
    learnt = context_tree.distinct(context_tree.grams_of([c for c, t in zip(codes, trained) if t], depth)[0])
    every = context_tree.distinct(context_tree.grams_of(codes, depth)[0])[0]
    keys, n = context_tree.summed(np.concatenate([learnt[0], every]), np.concatenate([learnt[1], np.zeros(len(every), np.int64)]))
    tree = context_tree.Tree(keys, n, depth, 1)
    byte = (tree.rows[1] & np.uint64(255)).astype(int)
    children = [np.zeros(1 << bit) for bit in range(8)]
    for bit in range(8):
        _, _, first, _, _, weighted = tree.weigh(bit)[1]
        np.add.at(children[bit], byte[first] >> (8 - bit), weighted)
    roots = context_tree.Roots(np.bincount(byte, weights=tree.counts[1], minlength=256), children)
    p = context_tree.probabilities(tree, roots)
    tables = {d: (tree.rows[d][tree.final[d]], p[d][tree.final[d]]) for d in p}
    tables[0] = (np.arange(256, dtype=np.uint64), roots.alone())
    return context_tree.Model(depth, tables).score(codes)


@pytest.mark.parametrize("size", [2_000, 5_000_000])
def test_lm_scoring_loses_no_context(spark, size):
    """The tables grow with the texts: no bound cuts rare contexts, however many grams there are."""
    rng = np.random.default_rng(3)
    signs = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789-+=/", np.uint8)
    texts = [rng.choice(signs, size // 20).tobytes().decode() for _ in range(20)]
    rare = [rng.choice(signs, 400).tobytes().decode() for _ in range(5)]
    texts += rare + rare + [f"{a} {b}" for a, b in zip(rare, rare[1:])]
    held = [i % 4 == 0 for i in range(20)] + [False] * 10 + [True] * 4
    rows = spark.createDataFrame(list(zip(range(len(texts)), texts, held)), "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(rows, F.col("held")).collect()}
    want = whole_tree_scores(texts, [not h for h in held])
    assert len(got) == len(texts)
    assert all(abs(got[i] - w) <= 1e-5 * abs(w) for i, w in enumerate(want)), [(got[i], w) for i, w in enumerate(want)]


def test_language_id(spark, docs, empty):
    rows = [(i, (EN if i % 2 else DE) + f"n{i}", "en" if i % 2 else "de", "a") for i in range(40)]
    model = language_id.train(table(spark, rows))
    got = {r.doc_id: r for r in language_id.identify_documents(docs, model).collect()}
    assert got[0].lang_pred == "en" and got[5].lang_pred == "de" and 0.9 < got[0].score <= 1
    assert got[2].lang_pred == got[3].lang_pred == got[11].lang_pred == "und" and got[3].score == 0 and got[3].spans == []
    assert got[12].lang_pred in ("en", "de")
    mixed = table(spark, [(1, EN + DE, None, "a")])
    spans = language_id.identify_documents(mixed, model).first().spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].end - len(EN)) < 12
    assert language_id.identify_documents(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify_documents(docs, language_id.train(empty)).collect()} == {"und"}
    kept = language_id.known_language(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 11").count() == 0 and kept.where("doc_id = 0").count() == 1


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(7)
    first = np.array([0, 5, 5, 9])
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    labels = language_id.label_words(scores, first, 0.7)
    for a, b in zip(first[:-1], first[1:]):
        def value(path):
            return sum(scores[a + i, x] for i, x in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))

        paths = [[(n // 3**i) % 3 for i in range(b - a)] for n in range(3 ** (b - a))]
        assert abs(value(labels[a:b].tolist()) - max(map(value, paths))) < 1e-5


def test_word_bpe_equals_the_library(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = word_bpe.encode_documents(docs, path)
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in rows.collect())
    want = []
    for i, t, _, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert word_bpe.encode_documents(empty, path).count() == 0
    one = word_bpe.digests(rows).where("doc_id = 0").first()
    ids = library.encode(ROWS[0][1], add_special_tokens=False).ids
    assert one.n_tokens == len(ids) and one.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranks, path = public_tokenizers.path("byte_bpe_50k.tiktoken"), str(tmp_path / "files")
    token_files.write_token_files(docs, path, ranks, public_tokenizers.PATTERN, shard_ids=2000)
    order = sorted(range(len(ROWS)), key=lambda k: (ROWS[k][0] is not None, ROWS[k][0] or 0, hashlib.md5((ROWS[k][1] or "").encode()).hexdigest()))
    want, start = [], 0
    for k in order:
        ids = library.encode(ROWS[k][1] or "", add_special_tokens=False).ids + [2]
        want.append((str(ROWS[k][0]), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(spark, path).collect()]
    assert sorted(got) == sorted(want)
    for row in token_files.read_token_files(spark, path).collect():
        file = token_files.TokenFile(bytes(row.payload))
        whole, ends = file.all_ids(), file.ends
        for i in range(len(ends)):
            assert np.array_equal(file.ids(i), whole[(ends[i - 1] if i else 0) : ends[i]])
    path = str(tmp_path / "none")
    token_files.write_token_files(empty, path, ranks, public_tokenizers.PATTERN)
    assert token_files.read_documents(spark, path).count() == 0


def test_rows_of_one_id_are_spread(spark, tmp_path):
    """Rows without an id, and copies of one row, are dealt to several files, in order."""
    rows = [(None, f"{EN} {i % 7}", "en", "a") for i in range(400)] + [(5, DE, "de", "a")] * 400
    path = str(tmp_path / "spread")
    token_files.write_token_files(table(spark, rows).repartition(3), path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    parts = [r.n_docs for r in token_files.read_token_files(spark, path).collect()]
    assert len(parts) >= 4 and max(parts) < 400
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_documents(spark, path).collect())
    assert [i for _, i, _ in got] == [None] * 400 + [5] * 400
    assert [s for s, _, _ in got] == [sum(n for _, _, n in got[:k]) for k in range(800)]


def plain_re_pair(ids, ends, first, least):
    """The most frequent pair, one at a time, until none occurs ``least`` times."""
    docs = [list(map(int, ids[a:b])) for a, b in zip([0, *ends[:-1]], ends)]
    rules = []
    while True:
        seen = Counter()
        for d in docs:
            i = 0
            while i + 1 < len(d):
                seen[d[i], d[i + 1]] += 1
                i += 2 if i + 2 < len(d) and d[i] == d[i + 1] == d[i + 2] else 1
        if not seen or max(seen.values()) < least:
            return docs, rules
        pair = max(seen, key=seen.get)
        for k, d in enumerate(docs):
            out = []
            for s in d:
                if out and (out[-1], s) == pair:
                    out[-1] = first + len(rules)
                else:
                    out.append(s)
            docs[k] = out
        rules.append(pair)


def test_re_pair_goes_to_the_end_and_compresses_like_the_plain_one():
    rng = np.random.default_rng(13)
    phrases = [rng.integers(0, 300, int(rng.integers(3, 12))) for _ in range(60)]
    docs = [np.concatenate([phrases[min(59, int(rng.exponential(12)))] for _ in range(int(rng.integers(1, 40)))]) for _ in range(150)]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs])
    symbols, symbol_ends, rules = token_files.re_pair(ids, ends, 1000, least=8)
    left = Counter()
    for a, b in zip([0, *symbol_ends[:-1]], symbol_ends):
        pairs = list(zip(symbols[a:b].tolist(), symbols[a + 1 : b].tolist()))
        left.update(pairs)
    assert max(left.values()) < 8
    plain, plain_rules = plain_re_pair(ids, ends, 1000, 8)
    size, plain_size = len(symbols) + 3 * len(rules), sum(map(len, plain)) + 3 * len(plain_rules)
    assert plain_size < 0.5 * len(ids) and size <= 1.1 * plain_size, (len(ids), size, plain_size)


def test_re_pair_round_trips():
    rng = np.random.default_rng(9)
    for ids in (np.zeros(5000, np.uint32), rng.integers(0, 3, 5000).astype(np.uint32), np.arange(10, dtype=np.uint32)):
        ends = np.array([0, 3, 3, len(ids) // 2, len(ids)])
        symbols, symbol_ends, rules = token_files.re_pair(ids, ends, 100, least=4)
        lengths, flat = token_files.expansions(rules, 100)
        assert np.array_equal(token_files.expand(symbols, 100, lengths, flat), ids)
        assert np.array_equal(lengths, token_files.expansion_lengths(rules, 100))
        for i, e in enumerate(ends):
            part = symbols[: symbol_ends[i]]
            assert len(token_files.expand(part, 100, lengths, flat)) == e
