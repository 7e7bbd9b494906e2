"""Exact duplicates by deterministic block naming: blocks are sorted into integer names, then pairs of names, and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.session import written

#: Characters of a block.
BLOCK = 1024


def normalised(text: Column) -> Column:
    """The text without blanks, tabs and line ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _named(contents: DataFrame, *by: str) -> DataFrame:
    """Integer names, from 1, of distinct contents: dealt by content, sorted, and numbered as they stand.

    Written, because a name must not change once it was given out.
    """
    return written(contents.distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id() + 1), "names")


def name_blocks(places: DataFrame, hashed: Column) -> DataFrame:
    """(row, at, name) of places (row, at, block): equal blocks have equal names, different ones different names.

    Blocks themselves are dealt and sorted once. Names go back to the places by the blocks' 64-bit hash; where that
    stands for two blocks or more, the blocks are named again and go back by content, under negative names.
    """
    places = places.withColumn("hash", hashed)
    names = _named(places.select("hash", "block"), "hash", "block").select("hash", "name")
    clashes = written(names.groupBy("hash").count().where("count > 1").select("hash"), "clashes")
    narrow = places.select("row", "at", "hash")
    if clashes.isEmpty():
        return narrow.join(names, "hash").select("row", "at", "name")
    plain = narrow.join(clashes, "hash", "left_anti").join(names, "hash").select("row", "at", "name")
    unclear = places.join(clashes, "hash", "left_semi")
    again = _named(unclear.select("block"), "block").withColumn("name", -F.col("name"))
    return plain.union(unclear.join(again, "block").select("row", "at", "name"))


def name_texts(docs: DataFrame, hashed: Column | None = None) -> DataFrame:
    """(row, n_blocks, name) of docs (row, blocks): equal block lists have equal (n_blocks, name), others do not.

    Per level adjacent names become pairs, and distinct pairs are sorted into the next names. Levels are the logarithm
    of the longest text's blocks; a text leaves the rounds with its last name, and each round is written. Distinct
    contents are found with map-side combine, and names return by joins that adaptive execution can split, so copies
    of one text may be any share of the rows.
    """
    hashed = F.xxhash64("block") if hashed is None else hashed
    places = docs.select("row", F.posexplode("blocks").alias("at", "block"))
    sizes = docs.select("row", F.size("blocks").alias("n_blocks"))
    most = sizes.agg(F.max("n_blocks")).first()[0] or 0
    done = sizes.where("n_blocks = 0").select("row", "n_blocks", F.lit(0).cast("bigint").alias("name"))
    named = written(name_blocks(places, hashed).join(sizes, "row"), "level").withColumn("left", F.col("n_blocks"))
    while True:
        done = done.union(named.where("left = 1").select("row", "n_blocks", "name"))
        if most <= 1:
            return done
        side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("name")))
        pairs = named.where("left > 1").groupBy("row", "n_blocks", "left", F.shiftright("at", 1).alias("next")).agg(
            side(0).alias("a"), F.coalesce(side(1), F.lit(0)).alias("b"))  # 0 is no name: a text of odd length ends here
        pairs = written(pairs.withColumnRenamed("next", "at"), "pairs")
        names = _named(pairs.select("a", "b"), "a", "b")
        named = written(pairs.join(names, ["a", "b"]).select("row", "at", "name", "n_blocks", F.ceil(F.col("left") / 2).alias("left")), "level")
        most = -(-most // 2)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, hashed: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    Texts are equal when they are identical without blanks; whether they are is decided by names alone, which
    stand for contents one to one. Of equal texts the row with the most code points stays, then the smallest id (null
    ids last); of rows that tie even so, repeated rows, one stays. Null, empty and blank texts are equal to each other.
    Texts may have any length. An empty table gives no rows; other columns are not read.
    """
    plain = normalised(F.col(text))
    cut = F.regexp_extract_all(plain, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.length(text), F.lit(0)).alias("n_points"), F.sha2(plain, 256).alias("text_sha256"), cut.alias("blocks"))
    rows = written(rows, "blocks")
    names = name_texts(rows.select("row", "blocks"), hashed)
    found = written(rows.select("row", "doc_id", "n_points", "text_sha256").join(names, "row"), "identities")
    best = F.min(F.struct((-F.col("n_points")).alias("size"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    # Written, so that the join has both sides as they are dealt and a large group's rows can be split.
    groups = written(found.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "groups")
    return found.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
