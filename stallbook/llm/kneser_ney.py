"""Quality classifier: an interpolated modified Kneser-Ney model of characters gives each document a perplexity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.llm.base import hash_filter, passes, slices, utf8
from stallbook.session import written

ORDER = 4
#: Rows of the scored table that are broadcast at a time (12 bytes each); the documents are scanned once per shard.
SHARD_ROWS = 1 << 21
#: One in so many trusted documents is kept from training and sets the thresholds.
FOLDS = 5
#: Documents of a language whose perplexity exceeds this share of its trusted documents are rejected.
QUANTILE = 0.995
#: A short document's mean is drawn to that of its language as if it had so many characters more.
PRIOR_CHARS = 200
#: The worst windows of a document: runs of so many symbols, at this share of all its windows ordered by surprise.
WINDOW = 6
WORST = 0.99
#: Surprise (negative log probability) of a symbol in steps of 1 / STEPS; 16 bits hold 6,553, and a probability of
#: 1 in 10^2800 is beyond what counts in 64 bits can give.
STEPS = 10
#: Bytes of text handled at a time (each takes about 50 bytes of memory), and distinct values that wait to be merged.
SLICE = 1 << 18
PENDING = 250_000
#: Symbols are UTF-16 units, so every character is told apart; unknown ones share the rest of the probability evenly.
SYMBOLS = 1 << 16


# ---- n-grams ----------------------------------------------------------------------------------------------------

def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of symbols that end at each symbol of the texts, 16 bits a symbol, and the borders of the texts.

    Three zeros stand before each text. A character beyond 16 bits is two symbols, as in UTF-16.
    """
    data, borders = utf8(column)
    before = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0))))[borders]
    points = np.frombuffer(data.tobytes().decode().encode("utf-16-le"), np.uint16).astype(np.uint64)
    n = len(borders) - 1
    places = np.arange(len(points)) + np.repeat((ORDER - 1) * np.arange(1, n + 1), np.diff(before))
    signs = np.zeros(len(points) + (ORDER - 1) * (n + 1), np.uint64)
    signs[places] = points
    value = np.zeros(len(points), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        value = (value << np.uint64(16)) | signs[places - k]
    return value, before


class _Tally:
    """Distinct values with their counts, merged now and then so that it holds little more than the distinct ones."""

    def __init__(self) -> None:
        self.values, self.counts, self.pending = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, values: np.ndarray) -> None:
        self.pending.append(np.unique(values, return_counts=True))
        if sum(len(v) for v, _ in self.pending) > max(PENDING, len(self.values) // 2):
            self.merge()

    def merge(self) -> None:
        values = np.concatenate([self.values, *(v for v, _ in self.pending)])
        counts = np.concatenate([self.counts, *(c for _, c in self.pending)])
        self.pending = []
        order = np.argsort(values)
        values, counts = values[order], counts[order]
        heads = np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1])))
        self.values, self.counts = values[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) over all texts: counted in tasks, summed by gram."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for part in slices(batches, most=SLICE):
            tally.add(grams(part.column("text"))[0])
        tally.merge()
        for k in range(0, len(tally.values), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(tally.values[k:k + 100_000].view(np.int64)), pa.array(tally.counts[k:k + 100_000])], ["gram", "n"])

    return texts.select("text").where("text is not null").mapInArrow(counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


# ---- the model --------------------------------------------------------------------------------------------------

def _last(gram: Column, k: int) -> Column:
    """The last k characters."""
    return gram.bitwiseAND((1 << 16 * k) - 1)


def _discounts(table: DataFrame) -> list[float]:
    """The three discounts of an order, from how many n-grams have the counts 1 to 4."""
    row = table.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in range(1, 5))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    return [min(max(x, 0.0), k) for k, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def log_probabilities(model: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, logp) for each wanted 4-gram: log probability of its last character after the first three.

    model: (gram, n) of the trusted text. Lower orders count in how many different characters an n-gram continues. Each
    order is a pair of joins by key: the counts of the n-grams, and the totals of their contexts; where a context was
    never seen, the order below alone decides. Tables stay in Spark and are partitioned by n-gram throughout.
    """
    tables = {ORDER: model}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy(_last(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), f"order-{k}")
    asked = {ORDER: wanted.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select(_last(F.col("gram"), k).alias("gram")).distinct()
    lower = None
    for k in range(1, ORDER + 1):
        d = _discounts(tables[k])
        n = F.col("n")
        contexts = tables[k].groupBy(F.shiftrightunsigned("gram", 16).alias("context")).agg(
            F.sum("n").alias("total"), (F.sum(_discount(n, d)) / F.sum("n")).alias("rest"))
        rows = asked[k].join(tables[k], "gram", "left").withColumn("context", F.shiftrightunsigned("gram", 16)).join(contexts, "context", "left")
        if lower is None:
            below = F.lit(1.0 / SYMBOLS)
        else:
            rows = rows.withColumn("lower", _last(F.col("gram"), k - 1)).join(lower.withColumnRenamed("gram", "lower"), "lower")
            below = F.col("below")
        own = F.when(n.isNull(), 0.0).otherwise(F.greatest(n - _discount(n, d), F.lit(0.0)) / F.col("total"))
        chance = F.when(F.col("total").isNull(), below).otherwise(own + F.col("rest") * below)
        lower = written(rows.select("gram", chance.alias("below")), f"scored-{k}")
    return lower.select("gram", F.log("below").alias("logp"))


# ---- scoring ----------------------------------------------------------------------------------------------------

class _Lookup:
    """A hash table of 64-bit keys in arrays: open addressing with at most half of the slots taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(int(2 * len(keys)).bit_length(), 4)
        size = 1 << self.bits
        self.keys, self.values, self.taken = np.zeros(size, np.uint64), np.zeros(size, np.float32), np.zeros(size, bool)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = ~self.taken[slot]
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]], self.taken[slot[put]] = keys[left[put]], values[left[put]], True
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) % size
        self.size = size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; 0 for what is not in the table."""
        out, slot, left = np.zeros(len(keys), np.float32), self._slot(keys), np.arange(len(keys))
        while len(left):
            hit = (self.keys[slot] == keys[left]) & self.taken[slot]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & self.taken[slot]
            left, slot = left[on], (slot[on] + 1) % self.size
        return out


def _lookup(shared) -> _Lookup:
    """The table of a broadcast shard, built once a worker; it goes when the worker lets go of the broadcast."""
    if not hasattr(shared, "lookup"):
        shared.lookup = _Lookup(*shared.value)
    return shared.lookup


def row_key(doc_id: str, lang: str, text: str) -> Column:
    """Rows with equal keys have equal id, language and text."""
    return F.sha2(F.concat_ws("\0", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(F.col(lang), F.lit("\1")),
                              F.coalesce(F.col(text), F.lit("\2"))), 256)


def worst_windows(surprise: np.ndarray, before: np.ndarray) -> pa.Array:
    """Of each text the sum over the window at the share WORST of its windows of WINDOW characters; null without one."""
    sums = np.concatenate(([0], np.cumsum(surprise, dtype=np.int64)))
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        own = sums[a + WINDOW:b + 1] - sums[a:max(b + 1 - WINDOW, a)]
        at = int(np.ceil(WORST * len(own))) - 1
        out.append(int(np.partition(own, at)[at]) if len(own) else None)
    return pa.array(out, pa.int64())


def sum_log_probabilities(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """(key, doc_id, lang, n_chars, logp, worst), one row per distinct row of (doc_id, lang, text).

    The scored table is cut into shards of about SHARD_ROWS by hash. Per shard the documents are scanned once; each
    takes its sum and two bytes a symbol along to the next scan, since a window needs all its symbols.
    """
    spark = docs.sparkSession
    n_shards = max(1, -(-scored.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("gram"), F.lit(n_shards))
    scored = written(scored.withColumn("shard", shard).repartition(n_shards, "shard").sortWithinPartitions("shard"), "scored") if n_shards > 1 else scored.withColumn("shard", F.lit(0))
    rows = docs.select("key", "doc_id", "lang", "text", F.lit(0.0).alias("logp"), F.lit(b"").alias("surprise"))
    for k in range(n_shards):
        table = scored.where(F.col("shard") == k).select("gram", F.col("logp").cast("float").alias("logp")).toArrow()
        shared = spark.sparkContext.broadcast((table["gram"].to_numpy().view(np.uint64), table["logp"].to_numpy()))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0, last=k == n_shards - 1) -> Iterator[pa.RecordBatch]:
            lookup = _lookup(shared)
            for part in slices(batches, most=SLICE):
                found, before = grams(part.column("text"))
                logp = lookup.get(found)
                total = np.concatenate(([0.0], np.cumsum(logp, dtype=np.float64)))
                own = total[before[1:]] - total[before[:-1]] + part.column("logp").to_numpy(zero_copy_only=False)
                surprise = np.minimum(np.rint(-STEPS * logp), 65535).astype(np.uint16)
                if not first:
                    surprise += utf8(part.column("surprise"))[0].view(np.uint16)  # each n-gram is in one shard
                ids = [part.column(c) for c in ("key", "doc_id", "lang")]
                if last:
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(np.diff(before)), pa.array(own), worst_windows(surprise, before)],
                                                     ["key", "doc_id", "lang", "n_chars", "logp", "worst"])
                else:
                    marks = [surprise[a:b].tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*ids, part.column("text"), pa.array(own), pa.array(marks, pa.binary())],
                                                     ["key", "doc_id", "lang", "text", "logp", "surprise"])

        if k < n_shards - 1:
            rows = written(rows.mapInArrow(sums, "key string, doc_id long, lang string, text string, logp double, surprise binary"), "passed")
        else:
            rows = rows.mapInArrow(sums, "key string, doc_id long, lang string, n_chars long, logp double, worst long")
    return rows.groupBy("key", "doc_id", "lang").agg(*(F.max(c).alias(c) for c in ("n_chars", "logp", "worst")))


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with one of the ids. A filter of fixed size leaves most others out before the exact join."""
    seen = docs.sparkSession.sparkContext.broadcast(hash_filter(ids.select(F.xxhash64("doc_id").alias("hash"))))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.take(pa.array(np.sort(passes(seen.value, hashes))))

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
    return rows.mapInArrow(likely, rows.schema).join(ids, "doc_id", "left_semi")


def _quantiles(steps: DataFrame, quantile: float, *by: str) -> DataFrame:
    """(by, step): the least step up to which this share of a group's counts lies."""
    total = steps.groupBy("group").agg(F.sum("count").alias("all"))
    below = steps.join(total, "group").withColumn("upto", F.expr("sum(count) over (partition by group order by step)"))
    return below.where(F.col("upto") >= F.col("all") * quantile).groupBy(*by).agg(F.min("step").alias("step"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """(key, doc_id, lang, n_chars, perplexity, threshold, drawn_perplexity, window_perplexity, window_threshold, kept).

    One row per distinct (doc_id, lang, text).

    Trusted text: documents labelled quality 1 and not toxic. Four folds of five train the model, on all their text;
    the fifth sets, per language, the quantile of perplexity beyond which documents are rejected. A language without
    trusted documents takes the threshold of all languages together; with none at all, everything with text is kept.
    The mean log probability is drawn to that of the language by PRIOR_CHARS, so that a few characters decide nothing.
    The worst windows of a document (WINDOW, WORST) are held against the same quantile of the fifth fold's worst windows,
    so that a few bad words do not vanish in the mean of a long text; a text without a window has none to fail.
    All n-grams of all documents are gathered and scored, so what moves through Spark grows with the input.

    Null and empty texts have no perplexity and are rejected. A null language is a group of its own. Null ids are
    scored but never trusted; labels with a null id, repeated or contradicting (any 0, any toxic) do not count as trusted.
    Other columns are not read; empty tables give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("quality = 1 and toxic = 0")
    trusted = written(good.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("held_out")), "trusted")
    model = written(count_grams(_among(rows, trusted.where("not held_out").select("doc_id"))), "model")
    scored = log_probabilities(model, written(count_grams(rows).select("gram"), "grams"))
    sums = written(sum_log_probabilities(rows.withColumn("key", row_key("doc_id", "lang", "text")), scored), "sums")

    held = sums.join(trusted.where("held_out").select("doc_id"), "doc_id").where("n_chars > 0").select(
        F.explode(F.array(F.struct(F.coalesce("lang", F.lit("\1"))), F.struct(F.lit("\0")))).alias("g"), "n_chars", "logp", "worst").select("g.*", "n_chars", "logp", "worst").toDF("group", "n_chars", "logp", "worst")
    # Written tables have a known size: what has a row a language is sent to the rows, not dealt with them by language.
    means = written(held.groupBy("group").agg((-F.sum("logp") / F.sum("n_chars")).alias("mean")), "means")
    drawn = (-F.col("logp") + PRIOR_CHARS * F.col("mean")) / (F.col("n_chars") + PRIOR_CHARS)
    # The quantile is read off a histogram in steps of 0.001, which is small and the same in any order of rows.
    steps = held.join(means, "group").groupBy("group", "mean", F.ceil(drawn * 1000).alias("step")).count()
    limits = written(_quantiles(steps, quantile, "group", "mean").withColumn("limit", F.col("step") / 1000).drop("step"), "limits")
    windows = held.where("worst is not null").groupBy("group", F.col("worst").alias("step")).count()
    limits = written(limits.join(_quantiles(windows, quantile, "group").toDF("group", "window_limit"), "group", "left"), "all-limits")
    every = limits.where("group = '\0'").agg(F.first("mean").alias("mean"), F.first("limit").alias("limit"), F.first("window_limit").alias("window_limit")).first()
    own = limits.where("group <> '\0'").select(F.col("group"), F.col("mean").alias("own_mean"), F.col("limit").alias("own_limit"), F.col("window_limit").alias("own_window_limit"))
    number = lambda x: F.lit(x).cast("double")
    judged = sums.withColumn("group", F.coalesce("lang", F.lit("\1"))).join(own, "group", "left").withColumns({
        "mean": F.coalesce("own_mean", number(every["mean"])), "limit": F.coalesce("own_limit", number(every["limit"])),
        "window_limit": F.coalesce("own_window_limit", number(every["window_limit"]))})
    kept = (F.col("n_chars") > 0) & F.coalesce(F.ceil(drawn * 1000) / 1000 <= F.col("limit"), F.lit(True)) & F.coalesce(F.col("worst") <= F.col("window_limit"), F.lit(True))
    return judged.select("key", "doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp(-F.col("logp") / F.col("n_chars"))).alias("perplexity"),
                         F.exp("limit").alias("threshold"), F.coalesce(F.exp(drawn), F.lit(None).cast("double")).alias("drawn_perplexity"),
                         F.exp(F.col("worst") / (STEPS * WINDOW)).alias("window_perplexity"), F.exp(F.col("window_limit") / (STEPS * WINDOW)).alias("window_threshold"), kept.alias("kept"))
