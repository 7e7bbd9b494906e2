"""SimHash near duplicates, found by a generalised pigeonhole search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.llm.base import LOWER, slices, utf8, words
from stallbook.llm.components import connected_components
from stallbook.session import written

#: A bucket is compared in blocks of so many fingerprints.
BLOCK = 4096
#: One row dealt to a bucket costs about as much as so many comparisons.
ROW_COST = 200


# ---- fingerprints -----------------------------------------------------------------------------------------------

def text_fingerprints(data: np.ndarray, borders: np.ndarray, size: int, seed: int = 42) -> np.ndarray:
    """The SimHash of each text: a bit is set if over half of the XXH64 of its word shingles have it."""
    data = LOWER[data]
    starts, ends, before = words(data, borders)
    prints = np.zeros(len(borders) - 1, np.uint64)
    if not len(starts):
        return prints
    # The words one after the other with one space between them.
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[np.repeat(to, sizes) + at] = data[np.repeat(starts, sizes) + at]
    n_words = np.diff(before)
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    first = np.repeat(before[:-1], n_shingles) + np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    last = np.minimum(first + size, np.repeat(before[1:], n_shingles)) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(to[first].tolist(), (to + sizes)[last].tolist(), strict=True)),
                         np.uint64, len(first))
    some = n_shingles > 0
    begins = (np.cumsum(n_shingles) - n_shingles)[some]
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), begins)
        prints[some] |= (2 * ones > n_shingles[some].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return prints


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint BIGINT) of every row; a text without words has fingerprint 0, and so has a null."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = text_fingerprints(*utf8(part.column("text")), size)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(got.view(np.int64))], ["id", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(prints, "id long, fingerprint long").withColumnRenamed("id", id_column)


# ---- the plan of the search -------------------------------------------------------------------------------------

def bit_correlations(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Share of ones of each bit, and the 64 x 64 correlations of the bits, over all fingerprints.

    Tasks send 64 x 64 sums each; these are added up in Spark, and 4,096 numbers reach the driver.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(0, len(values), 65536):
                part = values[k:k + 65536]
                bits = ((part[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], ["at", "n"])

    rows = classes.select("fingerprint").mapInArrow(sums, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = max(classes.count(), 1)
    both = np.zeros(4096)
    for row in rows:
        both[row["at"]] = row["n"]
    both = both.reshape(64, 64) / n
    share = np.diagonal(both).copy()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return share, (both - np.outer(share, share)) / np.outer(spread, spread)


def group_bits(correlations: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of near equal size; each group gathers the bits that go together most."""
    left, groups = set(range(64)), []
    strength = np.abs(correlations)
    for k in range(parts):
        size = len(left) // (parts - k)
        pool = sorted(left)
        group = [max(pool, key=lambda b: (strength[b, pool].sum(), -b))]
        while len(group) < size:
            pool = sorted(left - set(group))
            group.append(max(pool, key=lambda b: (strength[b, group].sum(), -b)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def part_costs(n: int, pairs: float, share: np.ndarray, most: int) -> list[float]:
    """Estimated cost of probing one group of bits at thresholds -1, 0, ... most.

    pairs: how many pairs of fingerprints agree in the whole group (counted). Pairs that differ in d of its bits are
    estimated from these by the chance of each bit to differ; a pair meets once for each mask that hides all d.
    """
    width = len(share)
    differ = np.clip(2 * share * (1 - share), 1e-9, 0.5)
    odds = np.zeros(most + 1)
    odds[0] = 1
    for x in differ / (1 - differ):
        odds[1:] += odds[:-1] * x
    costs = [0.0]
    for t in range(most + 1):
        met = sum(pairs * odds[d] * comb(width - d, t - d) for d in range(t + 1) if t <= width)
        costs.append(ROW_COST * n * comb(width, t) + met)
    return costs


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1: group not probed) with the given sum and the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, more in enumerate(own, -1):
                if done + t not in step or cost + more < step[done + t][0]:
                    step[done + t] = (cost + more, [*chosen, t])
        best = step
    return best[total]


def search_plan(classes: DataFrame, bits: int) -> list[int]:
    """The masks to probe: two fingerprints within `bits` bits agree under at least one of them.

    With m groups of bits and thresholds that add up to bits - m + 1, some group differs in at most its threshold.
    For m = 1 to bits + 1 the cheapest thresholds are found; the cheapest m is taken.
    """
    n = classes.count()
    share, correlations = bit_correlations(classes)
    plans = {m: group_bits(correlations, m) for m in range(2, bits + 2)} or {1: [list(range(64))]}
    groups = [(m, k, sum(1 << b for b in g)) for m, all_of in plans.items() for k, g in enumerate(all_of)]
    keys = classes.select(F.explode(F.array(*(
        F.struct(F.lit(i).alias("part"), F.col("fingerprint").bitwiseAND(_signed(mask)).alias("key")) for i, (_, _, mask) in enumerate(groups)))))
    counted = keys.groupBy("col.part", "col.key").count().groupBy("part").agg(F.sum(F.expr("count * (count - 1) / 2")).alias("pairs")).collect()
    pairs = {row["part"]: float(row["pairs"]) for row in counted}
    chosen = None
    for m, all_of in plans.items():
        own = [i for i, (k, _, _) in enumerate(groups) if k == m]
        cost, thresholds = allocate([part_costs(n, pairs.get(i, 0.0), share[g], bits) for i, g in zip(own, all_of, strict=True)], bits - m + 1)
        if chosen is None or cost < chosen[0]:
            chosen = (cost, all_of, thresholds)
    return [sum(1 << b for b in set(g) - set(hidden)) for g, t in zip(*chosen[1:], strict=True) if t >= 0 for hidden in combinations(g, t)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


# ---- probing and verifying --------------------------------------------------------------------------------------

def near_links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """(u, v): links that join the same fingerprints as all pairs within `bits` bits would.

    Each bucket of a mask is compared inside one task where it has up to BLOCK members; a larger one is dealt over
    tasks in pairs of blocks, so all its pairs are still compared. A task gives the edges of a spanning star for what
    it found linked, not the pairs.
    """
    masks = search_plan(classes, bits)
    rows = classes.select("fingerprint", F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(_signed(m)) for m in masks))).alias("mask", "key"))
    shared = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    dealt = rows.join(shared, ["mask", "key"]).withColumn("blocks", blocks).withColumn("own", own)
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    dealt = dealt.withColumn("other", F.explode(others)).select(
        "fingerprint", F.xxhash64("mask", "key", F.least("own", "other"), F.greatest("own", "other")).alias("pair"))
    dealt = dealt.repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(lambda batches: compare_buckets(batches, bits), "u long, v long").distinct()


def compare_buckets(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> star edges inside each bucket; different buckets in one hash only add comparisons."""
    kept_key, kept = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        kept_key = np.concatenate((kept_key, batch.column("pair").to_numpy(zero_copy_only=False)))
        kept = np.concatenate((kept, batch.column("fingerprint").to_numpy(zero_copy_only=False)))
        if not len(kept):
            continue
        cut = int(np.searchsorted(kept_key, kept_key[-1], "left"))
        yield from _stars(kept_key[:cut], kept[:cut], bits)
        kept_key, kept = kept_key[cut:], kept[cut:]
    yield from _stars(kept_key, kept, bits)


def _stars(keys: np.ndarray, values: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    if len(keys) < 2:
        return
    ends = np.searchsorted(keys, keys, "right")
    label, prints = np.arange(len(keys)), values.view(np.uint64)
    live, lag = np.arange(len(keys)), 0
    while True:
        lag += 1
        live = live[live + lag < ends[live]]
        if not len(live):
            break
        hit = live[np.bitwise_count(prints[live] ^ prints[live + lag]) <= bits]
        hit = hit[label[hit] != label[hit + lag]]
        while len(hit):  # merge the labels, smallest first
            a, b = label[hit], label[hit + lag]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
            hit = hit[label[hit] != label[hit + lag]]
    off = np.flatnonzero(label != np.arange(len(keys)))
    if len(off):
        yield pa.RecordBatch.from_arrays([pa.array(values[off]), pa.array(values[label[off]])], ["u", "v"])


# ---- the operator -----------------------------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, bits: int = 3, size: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint BIGINT, component_id) of every row.

    Rows are linked if their fingerprints differ in at most `bits` bits; component_id is the smallest id reachable.
    Equal texts are one class before the search, so copies cost one row each and no pairs. Null and empty texts have
    fingerprint 0 and are linked like others. Rows that repeat an id are returned as often; null ids are returned with
    the smallest non-null id of their component, or null. An empty table gives no rows. Other columns are not read.
    """
    rows = written(fingerprints(docs, size, id_column, text), "fingerprints")
    classes = written(rows.groupBy("fingerprint").agg(F.min(id_column).alias("first_id")), "classes")
    parts = connected_components(near_links(classes, bits))
    roots = classes.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("root"))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = roots.join(least, "root").select("fingerprint", "component_id")
    return rows.join(members, "fingerprint").select(id_column, "fingerprint", "component_id")

