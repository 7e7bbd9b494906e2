"""Merkle manifest, exact deduplication by block names, and phrase collocations against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallbook.llm import blocknames, collocations, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- Merkle manifest --------------------------------------------------------------------------------------------

def plain_leaf(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, i):
    for level in levels[:-1]:
        start = i // 8 * 8
        yield level[start:i], level[i + 1:start + 8]
        i //= 8


def plain_manifest(rows, change):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], plain_leaf(r)))
    trees = {lang: plain_tree([plain_leaf(r) for r in groups[lang]]) for lang in langs}
    over = plain_tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, row in enumerate(groups[lang]):
            path = [*plain_path(trees[lang], i), *plain_path(over, k)]
            folded = plain_leaf(change(row))
            for left, right in path:
                folded = sha("".join(left) + folded + "".join(right))
            out.append((row["doc_id"], trees[lang][0][i], trees[lang][-1][0], over[-1][0], sha("".join("".join(a) + "".join(b) for a, b in path)),
                        folded, folded == over[-1][0]))
    return sorted(out, key=str)


def manifest_rows(df, **more):
    return sorted((tuple(r) for r in merkle.manifest(df, FIELDS, **more).collect()), key=str)


def test_manifest_of_awkward_rows(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    lowered = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    change = lambda r: r | {"text": r["text"].lower() if r["text"] and r["doc_id"] is not None and r["doc_id"] % 2 == 0 else r["text"]}
    got = manifest_rows(docs, tampered={"text": lowered})
    assert got == plain_manifest(rows, change)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
    assert all(r.verified for r in merkle.manifest(docs, FIELDS).collect())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 700])
def test_manifest_of_many_sizes(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") != 5, F.lit("en")).alias("lang"),
                               F.col("id").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    assert manifest_rows(df) == plain_manifest([r.asDict() for r in df.collect()], lambda r: r)


def test_manifest_of_an_empty_table(spark):
    assert manifest_rows(spark.createDataFrame([], DOCS)) == []


def test_forest_keeps_every_second_level_only(spark):
    leaves = spark.range(1000).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("h"), "id")
    forest = merkle.build(leaves, ["id"])
    assert [level.count() for level in forest.levels] == [1000, 16, 1]
    levels = plain_tree([sha(str(i)) for i in range(1000)])
    assert [r.h for r in forest.levels[1].orderBy("i").collect()] == levels[2] and forest.tops.first().h == levels[-1][0]


# ---- exact deduplication ----------------------------------------------------------------------------------------

def plain_duplicates(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((doc_id, len(text or "")))
    out = []
    for plain, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0]))
        kept = [m == best for m in members]
        if sum(kept) > 1:  # rows that tie in everything
            kept = [k and i == kept.index(True) for i, k in enumerate(kept)]
        out += [(m[0], best[0], len(members), k, sha(plain)) for m, k in zip(members, kept, strict=True)]
    return sorted(out, key=str)


def found_duplicates(df, **more):
    return sorted((tuple(r) for r in blocknames.exact_duplicates(df, **more).collect()), key=str)


def test_exact_duplicates_of_awkward_rows(spark, docs):
    blank = spark.createDataFrame([(20, " \t\n", "en", "a", 3), (21, "q  r\ns " * 50, "en", "a", 1), (22, "qrs" * 50, "en", "a", 1), (23, " ", "en", "a", 1)], DOCS)
    both = docs.unionByName(blank, allowMissingColumns=True)
    assert found_duplicates(both) == plain_duplicates([(r.doc_id, r.text) for r in both.collect()])


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_names_tell_colliding_blocks_apart(spark, bits):
    """With hashes of few bits nearly all blocks collide, and the names still stand for contents one to one."""
    random.seed(bits)
    rows = [(n, "".join(random.choice("ab🙂") for _ in range(random.randint(0, 24)))) for n in range(300)]
    rows += [(1000 + n, text) for n, text in rows[:40]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = F.xxhash64("block").bitwiseAND((1 << bits) - 1) if bits < 64 else None
    assert found_duplicates(df, block=2, hashed=hashed) == plain_duplicates(rows)


def test_long_texts_that_differ_at_one_end(spark):
    long = "abcdefg hij" * 300_000  # 3 MB
    rows = [(1, long + "x"), (2, long + "y"), (3, "x" + long), (4, long + " x"), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_duplicates(df) == plain_duplicates(rows)


def test_many_copies_of_one_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("one text "), 400)).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = blocknames.exact_duplicates(rows)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 and keep_id = 0").count() == 1000


def test_exact_duplicates_of_an_empty_table(spark):
    assert found_duplicates(spark.createDataFrame([], DOCS)) == []


# ---- phrases ----------------------------------------------------------------------------------------------------

def plain_phrases(rows, least, top, percent=80):
    counts, totals = Counter(), Counter()
    small = {i: i + 32 for i in range(65, 91)}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(small)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts.update((lang, *words[i:i + n]) for i in range(len(words) - n + 1))
    found = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    around = Counter()
    for p, a in found.items():
        for n in range(2, len(p) - 1):
            for i in range(1, len(p) - n + 1):
                key = (p[0], *p[i:i + n])
                around[key] = max(around[key], a)
    out = {}
    for p, a in found.items():
        cuts = [(2_000_000 * a // (counts[p[:k + 1]] + counts[(p[0], *p[k + 1:])]), k, counts[p[:k + 1]], counts[(p[0], *p[k + 1:])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        if not (p in around and 100 * around[p] >= percent * a):
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -s) for lang, rows in out.items()
                  for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def invented(seed, n=120):
    random.seed(seed)
    words = ["the", "The", "of", "new", "york", "é", "🙂", "a", "b"] + [f"w{i}" for i in range(15)]
    joints = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b"]
    rows = []
    for _ in range(n):
        parts = [random.choice(["new york city", "out of the way", "is on", random.choice(words)]) for _ in range(random.randint(0, 40))]
        rows.append((random.choice(["en", "de", None, "und"]), "".join(x + random.choice(joints) for x in parts)))
    return rows + [("en", None), ("en", ""), ("en", ".,;"), ("fr", "is on " * 400), ("xx", "alone")]


def phrases(spark, rows, **more):
    df = spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n string, words string")
    return sorted(tuple(r) for r in collocations.collocations(df.repartition(3), **more).collect())


@pytest.mark.parametrize("more", [{}, {"chunk": 5}, {"share": 10**9}, {"chunk": 7, "share": 10}, {"top": 3}])
def test_phrases(spark, more):
    rows = invented(4)
    assert phrases(spark, rows, least=4, **more) == plain_phrases(rows, 4, more.get("top", 2000))


def test_phrases_of_long_texts_and_one_hot_pair(spark):
    random.seed(9)
    long = " ".join(random.choice(["is on", "ab", "cd", "ef.", "gh"]) for _ in range(900_000))  # over 3 MB
    bare = " ".join(random.choice(["no", "piece"]) for _ in range(300_000))  # longer than a slice, without a break
    rows = [("en", long), ("en", bare), ("en", "is on " * 5000)]
    assert phrases(spark, rows) == plain_phrases(rows, 30, 2000)


def test_phrases_of_empty_tables(spark):
    assert phrases(spark, [("en", "too few words")]) == []
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("least", [1, 4, 50])
def test_multikey_quicksort_counts_prefixes(least):
    rng = np.random.default_rng(least)
    symbols = rng.integers(0, 4, (3000, 5))
    symbols[np.cumsum(symbols == 0, axis=1) > 0] = 0
    weights = rng.integers(1, 4, 3000)
    expected = Counter()
    for row, w in zip(symbols.tolist(), weights.tolist(), strict=True):
        for d in range(1, 6):
            if row[d - 1] == 0:
                break
            expected[tuple(row[:d])] += w
    got = Counter()
    for depth, lead, size in collocations.multikey_quicksort(symbols, weights, least):
        for i, n in zip(lead.tolist(), size.tolist(), strict=True):
            assert tuple(symbols[i, :depth]) not in got
            got[tuple(symbols[i, :depth].tolist())] = n
    assert got == {p: n for p, n in expected.items() if n >= least}


def test_words_under_one_hash_stay_apart():
    data = np.frombuffer(b"ab cd ab ef cd", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])
    code, sample = collocations.same_words(data, starts, ends, np.zeros(5, np.uint64))
    assert code[0] == code[2] and code[1] == code[4] and len(set(code.tolist())) == 3 and code[sample].tolist() == [0, 1, 2]


def test_slices_cut_long_texts_between_pieces():
    texts = ["one two. three four, five six", "", "seven eight", "nine.ten.eleven " * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c", "a"]), pa.array(texts)], ["lang", "text"])
    found = Counter()
    for words, names in collocations.word_slices(iter([batch]), most=12):
        for n in range(1, 5):
            at = np.flatnonzero(words.room >= n)
            found.update((names[words.lang[i]], n, p) for i, p in zip(at.tolist(), words.spelled(at, n).to_pylist(), strict=True))
    expected = Counter()
    for lang, text in zip(["a", "b", "c", "a"], texts, strict=True):
        for piece in re.split("[.,]", text):
            w = piece.split()
            expected.update((lang, n, " ".join(w[i:i + n])) for n in range(1, 5) for i in range(len(w) - n + 1))
    assert found == expected
