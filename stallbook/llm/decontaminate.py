"""Benchmark decontamination: which short test items are contained in which documents?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.base import LOWER, filter_bits, hash_filter, mix, passes, slices, utf8, word_hashes, words
from stallbook.session import written

SIZE = 5
PERCENT = 80


class Runs:
    """The words of some texts, and the runs of words in them."""

    def __init__(self, column: pa.Array) -> None:
        data, borders = utf8(column)
        data = LOWER[data]
        self.raw = data.tobytes()
        self.starts, self.ends, self.before = words(data, borders)
        self.each = word_hashes(data, self.starts, self.ends)

    def of_size(self, size: int, whole_texts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every run of `size` words in a text: its text, its first word and its hash. Or of the texts of that size only."""
        n_words = np.diff(self.before)
        n = (n_words == size).astype(np.int64) if whole_texts else np.maximum(n_words - size + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + self.before[text]
        value = np.zeros(len(text), np.uint64)
        for k in range(size):
            value = value * np.uint64(0x9E3779B97F4A7C15) + self.each[first + k]
        return text, first, mix(value)

    def spelled(self, first: np.ndarray, size: int) -> list[str]:
        s, e = self.starts.tolist(), self.ends.tolist()
        return [b" ".join(self.raw[s[k]:e[k]] for k in range(i, i + size)).decode() for i in first.tolist()]


def item_shingles(items: DataFrame, percent: int = PERCENT, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, shingle, hash, words, n_item, in_sketch): the distinct shingles of each item, and which its sketch holds.

    An item of fewer than `size` words is one shingle, the whole of it.

    The sketch is the MinHash of the item with one hash function: its k smallest hashes. Items are partitioned by the
    power of two below their size n; all items of a partition have k = (1 - threshold) * u + 1 for its largest size u.
    Of the n shingles of a contained item at most (1 - threshold) * n are missing, so at least one of k is there.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            runs = Runs(part.column("text"))
            for k in range(1, size + 1):
                of, first, value = runs.of_size(k, whole_texts=k < size)
                if len(of):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("item_id").take(pa.array(of)), pa.array(runs.spelled(first, k), pa.string()),
                         pa.array(value.view(np.int64)), pa.array(np.full(len(of), k, np.int32))], ["item_id", "shingle", "hash", "words"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    rows = rows.mapInArrow(cut, "item_id long, shingle string, hash long, words int").distinct()
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_set("hash")).alias("hashes"))
    largest = F.expr("shiftleft(1L, length(bin(n_item)))") - 1
    length = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    sizes = sizes.withColumn("last", F.element_at("hashes", F.least(length, F.size("hashes"))))
    return rows.join(sizes, "item_id").select("item_id", "shingle", "hash", "words", "n_item", (F.col("hash") <= F.col("last")).alias("in_sketch"))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, size: int = SIZE,
                    doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) where at least `percent` % of the distinct shingles of an item are in a document.

    Words are runs of non-blank characters, A-Z in lower case; a shingle is `size` words. One scan of the documents:
    a document that has a hash of some sketch is a candidate and sends those of its shingles that may belong to an
    item. These meet the items by their words, so a pair counts only if it shares a shingle of the item's
    sketch and then by exact containment. The filters that are broadcast are sized by the items and never exceed 16 MiB;
    where items outgrow that, more shingles pass and the join removes them. Every document is scanned whole, and the search misses no pair.

    An item of fewer than `size` words is contained where all its words stand in a row. Items and documents without
    words match nothing, nor do rows with a null id; doc_id may be of any type, so rows without one can be given a key.
    Rows that repeat an id count as one item or document. Empty tables give no rows.
    """
    spark = docs.sparkSession
    known = written(item_shingles(items, percent, size, item_id, text), "items")
    bits = filter_bits(known.count())
    everything = spark.sparkContext.broadcast(hash_filter(known, bits))
    sketches = spark.sparkContext.broadcast(hash_filter(known.where("in_sketch"), bits))
    lengths = sorted(r["words"] for r in known.select("words").distinct().collect())  # from 1 to `size`

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            runs = Runs(part.column("text"))
            for k in lengths:
                of, first, value = runs.of_size(k)
                candidate = np.zeros(part.num_rows, bool)
                candidate[of[passes(sketches.value, value)]] = True
                hits = passes(everything.value, value)
                hits = hits[candidate[of[hits]]]
                if len(hits):
                    once = np.unique(np.stack((of[hits].astype(np.uint64), value[hits])), axis=1, return_index=True)[1]
                    hits = hits[once]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(of[hits])), pa.array(runs.spelled(first[hits], k), pa.string())], ["doc_id", "shingle"])

    key = F.col(doc_id)
    rows = docs.select((key.cast("long") if docs.select(key).dtypes[0][1] in ("int", "bigint") else key).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    hits = rows.mapInArrow(scan, f"doc_id {rows.dtypes[0][1]}, shingle string").distinct()
    pairs = hits.join(known, "shingle").groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_shared"), F.first("n_item").alias("n_item"), F.max("in_sketch").alias("met"))
    return pairs.where(F.col("met") & (F.col("n_shared") * 100 >= F.col("n_item") * percent)).select("doc_id", "item_id", "n_shared", "n_item")
