"""The pipeline stage by stage on the smallest given tables and on awkward rows."""

import random

import corpus_pipeline as pipeline
import numpy as np
from stallbook.llm import jaccard, kneser_ney
from stallbook.llm.components import connected_components
from stallbook.session import written

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["quality_classifier", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    kept = written(pipeline.quality_classifier(spark, docs, FOLDER), "a")
    good = {r.doc_id for r in kneser_ney.classify(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    single = written(pipeline.near_duplicates(spark, kept, FOLDER), "b")
    assert {r.doc_id for r in single.collect()} == set(grouped([(r.doc_id, r.text) for r in kept.collect()]).values()) and single.columns == docs.columns
    clean = written(pipeline.decontamination(spark, single, FOLDER), "c")
    redacted = written(pipeline.personal_data(spark, clean, FOLDER), "d")
    assert redacted.columns == docs.columns and redacted.where("text rlike '[a-z]@[a-z]'").count() == 0 and redacted.where("n_chars <> length(text)").count() == 0
    assert pipeline.byte_bpe(spark, redacted, FOLDER).where("n_tokens > 0").count() == clean.count()


def test_awkward_rows(spark, docs):
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() <= docs.count() and stage(spark, docs.limit(0), FOLDER).count() == 0, name
        assert name == "byte_bpe" or out.columns == docs.columns
    one = [r.doc_id for r in pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    assert one.count(7) == 1 and 1 in one and 2 not in one


def test_rows_without_an_id_are_searched(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, "before " + item + " behind", "en"), (None, "clean text without any test item in it at all", "en"), (1, "clean text without any test item in it at all", "en"),
            (None, "alone and clean as well, nothing like it here", "de"), (None, "alone and clean as well, nothing like it here", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert pipeline.decontamination(spark, docs, FOLDER).count() == 4
    kept = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, FOLDER).collect()), key=str)
    assert kept == sorted([(1, rows[1][1]), (None, rows[0][1]), (None, rows[3][1])], key=str)


def test_candidates_of_near_copies_grow_with_the_group(spark):
    """One group of near copies: what is settled grows with its members, not with their pairs."""
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    sizes = []
    for n in (100, 400):
        rows = []
        for k in range(n):
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(300)] = f"x{k}"
            rows.append((k, " ".join(copy)))
        docs = spark.createDataFrame(rows, "id long, text string")
        members = jaccard.buckets(written(jaccard.prefixes(docs, 5, 80), "p"))
        first = written(jaccard.neighbours(members, 80), "n")
        parts = connected_components(first).toDF("key", "part")
        sizes.append(first.count() + jaccard.candidates(members, parts, 80).count())
        assert {r.component_id for r in jaccard.near_copies(docs.withColumnRenamed("id", "doc_id")).collect()} == {0}
    assert sizes[1] < 8 * sizes[0] and sizes[1] < 400 * 399 / 8


def grouped(rows, size=5):
    """Smallest id reachable over pairs with a similarity of 0.8, by comparing all pairs."""
    cut = lambda w: {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))}
    sets = [cut((t or "").lower().split()) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    return {d: min(e for (e, _), q in zip(rows, part) if q == p) for (d, _), p in zip(rows, part)}


def test_near_copies_against_all_pairs(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 60, 300]))]
        for k in range(8):
            copy = list(base)
            for _ in range(round(len(base) * k / 120)):
                copy[rng.randrange(len(copy))] = f"W{rng.randint(0, 400)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(200, ""), (201, None), (202, "a b"), (203, "A  b\n")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = grouped(rows)
    assert 15 < len(set(expected.values())) < 90
    for block, sample, crowd in ((4096, 16, 64), (2, 1, 3)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        assert {r.doc_id: r.component_id for r in jaccard.near_copies(table).collect()} == expected
    assert {r.doc_id for r in pipeline.near_duplicates(spark, table.selectExpr("*", "'en' lang"), FOLDER).collect()} == set(expected.values())
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    assert {r.doc_id: r.component_id for r in jaccard.near_copies(given).collect()} == grouped([(r.doc_id, r.text) for r in given.collect()])


def test_fingerprints_are_compared_first(spark, monkeypatch):
    """The stage goes through the SimHash operator, and what its fingerprints join is settled by the exact sets."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    near, far = [*base[:399], "other"], [f"v{k}" for k in range(400)]
    table = spark.createDataFrame([(1, " ".join(base), "en"), (2, " ".join(near), "en"), (3, " ".join(far), "en")], "doc_id long, text string, lang string")
    asked = []
    found = pipeline.simhash.near_duplicates
    monkeypatch.setattr(pipeline.simhash, "near_duplicates", lambda docs, **k: asked.append(k) or found(docs, **k))
    assert {r.doc_id for r in pipeline.near_duplicates(spark, table, FOLDER).collect()} == {1, 3} and asked
    # A wrong group joins nothing: its pairs are settled by the sets.
    wrong = table.selectExpr("xxhash64(doc_id) hash", "1L component_id")
    assert {r.doc_id: r.component_id for r in jaccard.near_copies(table, groups=wrong).collect()} == {1: 1, 2: 1, 3: 3}
    rows = written(jaccard.prefixes(table.selectExpr("doc_id id", "text"), 5, 80), "p")
    assert jaccard.grouped_pairs(rows, wrong).count() == 2


def test_groups_leave_no_pair_out(spark):
    """A group whose smallest set is unlike its others: pairs that it is not part of are found all the same."""
    rng, rows = random.Random(8), []
    for b in range(6):
        base = [f"w{b}_{rng.randint(0, 10**6)}" for _ in range(120)]
        rows += [(10 * b + k, " ".join([*base[:118], f"x{k}", f"y{k}"])) for k in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = written(jaccard.prefixes(table.selectExpr("doc_id id", "text"), 5, 80), "p")
    keys = dict(kept.select("id", "key").collect())
    alike = {tuple(sorted((keys[10 * b + i], keys[10 * b + j]))) for b in range(6) for i, j in ((0, 1), (0, 2), (1, 2))}
    for parts in ("1L", "doc_id % 10"):  # one group of all, and groups that cut each family in pieces
        groups = table.selectExpr("xxhash64(doc_id) hash", f"{parts} component_id")
        first = {(r.u, r.v) for r in jaccard.grouped_pairs(kept, groups).collect()}
        assert len(alike - first) > 12  # these are left to the search
        assert {r.doc_id: r.component_id for r in jaccard.near_copies(table, groups=groups).collect()} == grouped(rows)
    assert len(set(grouped(rows).values())) == 6


def test_marks_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, k, np.uint64)) for k in (1, 30, 40, 70, 500, 9000)]
    sets += [np.unique(np.concatenate((s[: len(s) * 4 // 5], rng.integers(0, 2**64, len(s) // 2, np.uint64)))) for s in sets] + [np.zeros(0, np.uint64)]
    n = np.array([len(s) for s in sets])
    marks = jaccard.set_marks(np.repeat(np.arange(len(n)), n), np.concatenate(sets), n)
    assert len(marks[0]) == marks[1].sum() and marks[1].max() == jaccard.MARK_WORDS and len(set(marks[1])) > 3
    a, b = (x.ravel() for x in np.indices((len(n), len(n))))
    apart = jaccard.bits_apart(a, b, marks)
    only_one = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (apart <= only_one).all() and (apart[a == b] == 0).all() and apart[(only_one > 5) & (n[a] < 600) & (n[b] < 600)].min() > 2


def test_near_copies_about_the_threshold_cost_their_number(spark, monkeypatch):
    """A group whose sets are nearly all about 80 % alike is joined without looking at most of its pairs."""
    rng = random.Random(4)
    base, looked = [f"w{rng.randint(0, 10**6)}" for _ in range(150)], []
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4, 6])):
            copy[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")

    def watched(df, purpose):
        kept = written(df, purpose)
        if purpose in ("neighbours", "candidates"):
            looked.append(kept.count())
        return kept

    monkeypatch.setattr(jaccard, "written", watched)
    expected = grouped(rows)
    assert 1 < len(set(expected.values())) < 250
    assert {r.doc_id: r.component_id for r in jaccard.near_copies(table).collect()} == expected
    assert sum(looked) < 3 * 300
