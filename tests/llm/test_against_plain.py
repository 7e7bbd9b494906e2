"""Language identification, the classifier, links, rules and personal data against plain versions; very long texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stallbook.llm import bpe, decontaminate, kneser_ney, langid, ledger, pii, simhash, suffixes, urls

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


# ---- language identification ------------------------------------------------------------------------------------

def plain_buckets(text):
    signs = [0, *(ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text), 0, 0]
    for p in range(len(text) + 1):
        value = 0
        for k in range(3):
            value = ((value + signs[p + k]) * 0x9E3779B1 + k + 1) % 2**32
            yield ((value ^ (value >> 15)) * 0x85EBCA77 % 2**32 >> 16) % langid.BUCKETS


def plain_languages(train, rows):
    counts, documents = defaultdict(Counter), Counter()
    for lang, text in train:
        counts[lang].update(plain_buckets(text))
        documents[lang] += 1
    out = []
    for text in rows:
        if text is None or not any(c.isalpha() for c in text) or not counts:
            out.append(("und", 0.0))
            continue
        found = Counter(plain_buckets(text))
        sums = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + 0.5 * langid.BUCKETS
            sums[lang] = math.log(documents[lang] / sum(documents.values())) + sum(n * math.log((counts[lang][b] + 0.5) / total) for b, n in found.items())
        best = max(sums, key=lambda x: (sums[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())))
    return out


def languages(spark, train, rows):
    model = langid.train(spark.createDataFrame(train, "lang string, text string"))
    found = langid.predict(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model)
    return [(r.lang_pred, r.score) for r in found.orderBy("doc_id").collect()]


def test_languages_against_dictionaries(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(60).collect()
    train, rows = [(d.lang, d.text) for d in docs[:40]], [d.text for d in docs[40:]] + ["Élan", "🙂 É", "12 !", "", None, "ẞß ǅ ﬁ"]
    got, expected = languages(spark, train, rows), plain_languages(train, rows)
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert np.allclose([g[1] for g in got], [e[1] for e in expected], atol=1e-9)


def test_equal_languages_and_nothing_learned(spark):
    train = [("b", "one two"), ("a", "one two")]
    assert languages(spark, train, ["two"]) == [("a", pytest.approx(0.5))]
    assert languages(spark, [], ["two", None]) == [("und", 0.0), ("und", 0.0)]


# ---- the classifier ---------------------------------------------------------------------------------------------

def units(text):
    raw = text.encode("utf-16-le")
    return [0, 0, 0, *(raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2))]


def plain_model(texts):
    """Probability of a symbol after three, by the formulas of interpolated modified Kneser-Ney smoothing."""
    counts = {4: Counter()}
    for text in texts:
        s = units(text)
        counts[4].update(tuple(s[i - 3:i + 1]) for i in range(3, len(s)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    steps, totals, rests = {}, {}, {}
    for k in range(1, 5):
        n1, n2, n3, n4 = (sum(c == n for c in counts[k].values()) for n in (1, 2, 3, 4))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            steps[k] = [min(max(x, 0.0), i) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]
        else:
            steps[k] = [0.5, 0.75, 1.0]
        totals[k], rests[k] = Counter(), Counter()
        for g, n in counts[k].items():
            totals[k][g[:-1]] += n
            rests[k][g[:-1]] += steps[k][min(n, 3) - 1]
    known = {}

    def chance(g):
        if g in known:
            return known[g]
        k = len(g)
        below = 1.0 / 65536 if k == 1 else chance(g[1:])
        total = totals[k].get(g[:-1])
        if total is None:
            p = below
        else:
            n = counts[k].get(g, 0)
            own = max(n - steps[k][min(n, 3) - 1], 0.0) / total if n else 0.0
            p = own + rests[k][g[:-1]] / total * below
        known[g] = p
        return p

    return chance


def plain_classify(rows, trusted, held, quantile=kneser_ney.QUANTILE):
    chance = plain_model([t for d, _, t in rows if d in trusted and d not in held and t is not None])
    found = {}
    for key in set(rows):
        s = units(key[2] or "")
        logp = [float(np.float32(math.log(chance(tuple(s[i - 3:i + 1]))))) for i in range(3, len(s))]
        marks = [int(np.rint(np.float32(-kneser_ney.STEPS) * np.float32(x))) for x in logp]
        windows = sorted(sum(marks[i:i + 6]) for i in range(len(marks) - 5))
        found[key] = (len(logp), sum(logp), windows[math.ceil(0.99 * len(windows)) - 1] if windows else None)
    limits = {}
    for group in {None, *(("lang", lang) for _, lang, _ in rows)}:
        own = [v for (d, lang, _), v in found.items() if d in held and v[0] and (group is None or group == ("lang", lang))]
        if not own:
            continue
        mean = -sum(v[1] for v in own) / sum(v[0] for v in own)
        at = lambda values, q: sorted(values)[max(math.ceil(q * len(values) - 1e-9), 1) - 1]
        drawn = [math.ceil((-v[1] + 200 * mean) / (v[0] + 200) * 1000) for v in own]
        worst = [v[2] for v in own if v[2] is not None]
        limits[group] = mean, at(drawn, quantile) / 1000, at(worst, quantile) if worst else None
    out = {}
    for key, (n, total, worst) in found.items():
        own, every = limits.get(("lang", key[1])), limits.get(None)
        mean, limit, window = (x if x is not None else y for x, y in zip(own or every, every, strict=True))
        kept = n > 0 and math.ceil((-total + 200 * mean) / (n + 200) * 1000) / 1000 <= limit and (worst is None or window is None or worst <= window)
        out[key] = (n, math.exp(-total / n) if n else None, worst, kept)
    return out


@pytest.mark.parametrize("quantile", [kneser_ney.QUANTILE, 0.7])
def test_classifier_against_dictionaries(spark, monkeypatch, quantile):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    docs = docs.union(spark.createDataFrame([(10_001, "en", None), (10_002, "xx", "the 🙂😀"), (10_003, "xx", ""), (None, "de", "und die 🙂 der"), (10_005, "en", "ab")], "doc_id long, lang string, text string"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    ids = spark.createDataFrame([(t,) for t in trusted], "d long")
    held = {r.d for r in ids.where(F.pmod(F.xxhash64("d"), F.lit(kneser_ney.FOLDS)) == 0).collect()}
    expected = plain_classify([(r.doc_id, r.lang, r.text) for r in docs.collect()], trusted, held, quantile)
    texts = {(r.key): (r.doc_id, r.lang, r.text) for r in docs.withColumn("key", kneser_ney.row_key("doc_id", "lang", "text")).collect()}
    for shard in (kneser_ney.SHARD_ROWS, 5000):
        monkeypatch.setattr(kneser_ney, "SHARD_ROWS", shard)
        got = kneser_ney.classify(docs, labels, quantile).collect()
        assert len(got) == len(expected)
        for r in got:
            n, perplexity, worst, kept = expected[texts[r.key]]
            assert (r.n_chars, r.kept) == (n, kept) and (perplexity is None) == (r.perplexity is None)
            assert perplexity is None or math.isclose(perplexity, r.perplexity, rel_tol=1e-5)
            assert worst is None or math.isclose(math.exp(worst / 60), r.window_perplexity, rel_tol=1e-9)
    assert 0.02 < sum(not e[3] for e in expected.values()) / len(expected) < 0.6


def test_surprise_does_not_saturate():
    assert kneser_ney.worst_windows(np.full(6, 6000, np.uint16), np.array([0, 6])).to_pylist() == [36000]


def test_characters_beyond_sixteen_bits_are_told_apart():
    import pyarrow as pa

    one, two = (kneser_ney.grams(pa.array([x]))[0] for x in ("🙂", "😂"))
    assert len(one) == len(two) == 2 and one[-1] != two[-1]


# ---- rules ------------------------------------------------------------------------------------------------------

def test_words_of_every_script_have_letters(spark):
    texts = ["यह एक लंबा वाक्य है " * 20, "这是 一个 很长 的 句子 " * 20, "هذه جملة طويلة جدا هنا " * 20, "123 456 -- 789 .. " * 20]
    rows = ledger.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.failed >> 6 & 1 for r in rows] == [0, 0, 0, 1]


def test_windows_under_one_hash_are_told_apart(spark):
    texts = ["a b c x a b d y a b c z a b d", "a a a a a", "a b c d e f", "p q r p q r", "a b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.filter(F.split("text", " "), lambda w: w != "").alias("w"))

    def plain(text):
        w = text.split()
        seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        return len({i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)})

    for hashed in (F.xxhash64, lambda *w: F.lit(0).cast("long"), lambda a, b, c: F.shiftleft(F.pmod(F.xxhash64(a, b, c), F.lit(2)), 40)):
        got = {r.text: r.n for r in df.select("text", ledger.repeated_words(F.col("w"), hashed).alias("n")).collect()}
        assert got == {t: plain(t) for t in texts}


# ---- personal data ----------------------------------------------------------------------------------------------

def test_context_decides_where_no_checksum_does(spark):
    rows = ["GB82 WEST 1234 5698 7654 32 AND THEN call", "DE89370400440532013000X", "passport no. X1234567 of", "order 12345678 of",
            'api_key = "abcDEF123456789xyz00"', "word abcDEF123456789xyz00 word", "social security 078-05-1120."]
    found = pii.find_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    got = [[(s.kind, r.text[s.start:s.end]) for s in r.pii_spans if not s.base] for r in found]
    assert got == [[("iban", "GB82 WEST 1234 5698 7654 32")], [], [("number", "X1234567")], [], [("secret", "abcDEF123456789xyz00")], [], [("number", "078-05-1120")]]
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert clean[0] == "[IBAN] AND THEN call" and clean[4] == 'api_key = "[SECRET]"' and clean[5] == rows[5]


# ---- links ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("tag", [
    '<link rel="canonical" href="http://a.example.org/x/../es/1">', '<link href="../../es/1" rel="nofollow canonical">', "<link rel=canonical href='/./es/1'>",
    """<meta http-equiv="refresh" content="0; url='http://a.example.org/es/1'">""", '<meta content="0;URL=http://a.example.org/es/1" http-equiv=Refresh>',
    '<link rel="x" title="a>b"><LINK REL="Canonical" HREF="http://a.example.org/es/1">', '<link href="../../../../es/./1" rel="canonical">',
])
def test_stated_links_are_followed(spark, tag):
    rows = [(1, "http://other.net/q/r/s", f"<html><head>{tag}</head></html>"), (2, "http://a.example.org/q/r/s", f"<html><head>{tag}</head></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.alias_verdict for r in urls.judge_pages(df, [urls.Rule("block", "example.org", "/es/")]).collect()}
    assert got[2] == "block" and got[1] == ("block" if "a.example.org" in tag else None)


def test_dot_segments(spark):
    paths = {"/a/b/../c": "/a/c", "/../a": "/a", "/a/./b": "/a/b", "/a/..": "/", "/a/b/.": "/a/b/", "": "", "/": "/", "/a//b": "/a//b", "/a/...": "/a/...", "/a/../../b/": "/b/"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.q for r in df.select("p", urls.without_dots(F.col("p")).alias("q")).collect()} == paths


def test_aliases_over_several_steps(spark):
    rows = [(n, f"http://h{n}.net/", f'<link rel="canonical" href="http://h{n + 1}.net/">') for n in range(5)] + [(9, "http://h5.net/", ""), (10, "http://k.net/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge_pages(df, [urls.Rule("block", "h5.net", "/")]).collect()}
    assert all(got[n] == "block" for n in (0, 1, 2, 3, 4, 9)) and got[10] == "allow"
    allowed = {r.page_id: r.verdict for r in urls.judge_pages(df, [urls.Rule("block", "h5.net", "/"), urls.Rule("allow", "h2.net", "/")]).collect()}
    assert allowed[0] == "allow" and allowed[9] == "block"


# ---- decontamination --------------------------------------------------------------------------------------------

def test_short_items_and_keys_of_any_type(spark):
    docs = spark.createDataFrame([("a", "one Two three four five six"), ("b", "three  two"), (None, "one two"), ("c", "two\nthree"), ("d", "two threes")], "row string, text string")
    items = spark.createDataFrame([(1, "two three"), (2, "FIVE"), (3, ""), (4, None), (5, "one two three four five")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items, doc_id="row").collect())
    assert got == [("a", 1), ("a", 2), ("a", 5), ("c", 1)]


# ---- very long texts --------------------------------------------------------------------------------------------

def test_texts_longer_than_a_slice(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(20_000)]
    long = " ".join(rng.choice(vocabulary, 480_000)) + " write to ann@example.com, 🙂 seven words that are the test item"
    assert len(long) > 3 << 20
    docs = spark.createDataFrame([(1, long, "en"), (2, "short text", "en"), (3, long[-400:], "en")], DOCS)
    items = spark.createDataFrame([(7, "seven words that are the test item")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contained_items(docs, items).collect()) == [1, 3]
    at = long.index("ann@")
    assert [(s.start, s.end) for s in pii.find_spans(docs).where("doc_id = 1").first().pii_spans if s.kind == "email"] == [(at, at + 15)]
    cut = {r.doc_id: r.n_bytes - len(r.kept) for r in suffixes.remove_repeats(docs).collect()}
    assert cut == {1: len(long[-400:].encode()), 2: 0, 3: len(long[-400:].encode())}
    got = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    assert {r.doc_id: bytes(r.decoded).decode() for r in got.collect()}[1] == long
    assert ledger.ledger(docs).where("doc_id = 1").first().n_words == len(long.split())
    assert simhash.near_duplicates(docs).count() == 3
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_chars for r in kneser_ney.classify(docs, labels).collect()}[1] == len(long) + 1  # one character is two units
    model = langid.train(docs.select("lang", "text"))
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {1: "en", 2: "en", 3: "en"}
