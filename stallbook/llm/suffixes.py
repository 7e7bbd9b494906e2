"""Exact removal of repeated byte strings by suffix arrays of content-defined shards."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.base import hash_filter, mix, passes, slices, utf8
from stallbook.session import written

WINDOW = 200
#: Windows are routed by the least hash of the strings of this length inside them.
GRAM = 32
SLICE = 1 << 20
#: Bits of the filter of keys that occur at least twice (8 MiB); the same for keys that occur very often.
KEY_BITS = 1 << 26
#: A key of more segments is dealt out by single windows instead.
HOT_SEGMENTS = 16_384
#: Symbols of a suffix array; a key's segments stay together, so it may have as many more as one key brings.
CHUNK = 2_000_000


# ---- suffix array -----------------------------------------------------------------------------------------------

def _join(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.int32)


def _deal(places: np.ndarray, s: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Appends places to the queue of their symbol, in order."""
    if not len(places):
        return
    symbols = s[places]
    order = np.argsort(symbols, kind="stable")
    places, symbols = places[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part in np.split(places, cuts):
        queues[s[part[0]]].append(part)


def _before(places: np.ndarray) -> np.ndarray:
    return places[places > 0] - 1


def induce(s: np.ndarray, lms: np.ndarray, n_symbols: int) -> np.ndarray:
    """All suffixes in order, induced from its leftmost-smaller suffixes in order.

    One pass over the buckets upwards puts the larger suffixes, one downwards the smaller ones; inside a
    bucket all suffixes that follow from the same step are moved at once. Linear but for runs of one symbol, which
    take a step each.
    """
    larger: list[np.ndarray] = []
    queues: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    _deal(lms, s, seeds)
    queues[s[-1]].append(np.array([len(s) - 1], np.int32))
    for c in range(n_symbols):
        now, parts = _join(queues[c]), []
        while len(now):
            parts.append(now)
            now = _before(now)
            now = now[s[now] == c]
        larger.append(_join(parts))
        places = _before(_join([larger[c], *seeds[c]]))
        _deal(places[s[places] > c], s, queues)
    smaller: list[np.ndarray] = [np.zeros(0, np.int32)] * n_symbols
    queues = [[] for _ in range(n_symbols)]
    for c in range(n_symbols - 1, -1, -1):
        now, parts = _join(queues[c]), []
        while len(now):
            parts.append(now)
            now = _before(now)
            now = now[s[now] == c]
        down = _join(parts)
        smaller[c] = down[::-1]
        places = _before(np.concatenate((down, larger[c][::-1])))
        _deal(places[s[places] < c], s, queues)
    return _join([part for c in range(n_symbols) for part in (larger[c], smaller[c])])


def _names(s: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each leftmost-smaller substring, in order, differs from the one before it."""
    a, b = order[:-1], order[1:]
    differs = ends[:-1] - a != ends[1:] - b
    left, k = np.flatnonzero(~differs), 0
    while len(left):
        left = left[a[left] + k <= ends[:-1][left]]
        unlike = s[np.minimum(a[left] + k, len(s) - 1)] != s[np.minimum(b[left] + k, len(s) - 1)]
        differs[left[unlike]] = True
        left, k = left[~unlike], k + 1
    return np.concatenate(([True], differs))


def _sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, to `depth` names at least.

    Names are joined in pairs, the pairs in pairs, and so on; at each level only what is still tied is sorted again.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    firsts = np.concatenate(([True], np.diff(names[order]) != 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(firsts, np.arange(n), 0)) + 1
    k = 1
    while k < depth:
        slots = np.flatnonzero(~(firsts & np.concatenate((firsts[1:], [True]))))
        if not len(slots):
            break
        tied = order[slots]
        key = rank[tied] * (n + 2) + rank[np.minimum(tied + k, n)]
        by = np.argsort(key, kind="stable")
        order[slots], key = tied[by], key[by]
        new = np.concatenate(([True], np.diff(key) != 0))
        firsts[slots] = new
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] + 1
        k *= 2
    return order


def suffix_array(s: np.ndarray, depth: int, n_symbols: int) -> np.ndarray:
    """The suffixes of s in order of their first `depth` symbols at least, by induced sorting."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int32)
    at = np.arange(n, dtype=np.int32)
    unlike = np.append(s[:-1] != s[1:], True)
    turn = np.minimum.accumulate(np.where(unlike, at, n - 1)[::-1])[::-1]
    small = (s[turn] < s[np.minimum(turn + 1, n - 1)]) & (turn < n - 1)  # the suffix is smaller than the next one
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) > 1:
        leftmost = np.zeros(n, bool)
        leftmost[lms] = True
        order = induce(s, lms, n_symbols)
        order = order[leftmost[order]]  # by their substrings up to the next leftmost-smaller place
        number = np.searchsorted(lms, order)
        ends = np.append(lms[1:], n)[number]
        names = np.zeros(len(lms), np.int64)
        names[number] = np.cumsum(_names(s, order, ends))
        lms = lms[_sort_names(names, -(-depth // 2))]  # each name covers two symbols or more
    return induce(s, lms, n_symbols)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, heads: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place its common prefix with the suffix before it in order, up to `most`; and that suffix's place, or -1.

    In text order: where both places moved one step on, the prefix is one shorter; only the others, and `heads`, are
    compared symbol by symbol, four at a time.
    """
    n = len(s)
    other = np.full(n, -1, np.int64)
    other[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (other[1:] < 1) | (other[:-1] != other[1:] - 1) | (s[:-1] != s[other[1:] - 1])
    fresh[heads] = True
    padded = np.concatenate((s.astype(np.uint64), np.arange(most + 8, dtype=np.uint64) + np.uint64(300)))
    words = padded[:-3] | (padded[1:-2] << np.uint64(16)) | (padded[2:-1] << np.uint64(32)) | (padded[3:] << np.uint64(48))
    common = np.zeros(n, np.int32)
    left, k = np.flatnonzero(fresh & (other >= 0)), 0
    while len(left) and k < most:
        unlike = words[left + k] ^ words[other[left] + k]
        whole = unlike == 0
        ended = left[~whole]
        low = unlike[~whole]
        low &= ~low + np.uint64(1)
        common[ended] = k + np.bitwise_count(low - np.uint64(1)).astype(np.int32) // 16
        left, k = left[whole], k + 4
    common[left] = most
    at = np.arange(n, dtype=np.int64)
    start = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.maximum(common[start] - (at - start), 0), other


def repeated_windows(contents: list[bytes], window: int) -> list[np.ndarray]:
    """Per content, which of its windows occur elsewhere in the contents."""
    sizes = np.array([len(c) for c in contents])
    starts = np.cumsum(sizes + 1) - sizes - 1
    s = np.zeros(int((sizes + 1).sum()), np.uint16)
    s[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = np.frombuffer(b"".join(contents), np.uint8).astype(np.uint16) + 1
    order = suffix_array(s, window, 257)
    common, other = permuted_prefixes(s, order, starts, int(sizes.max()) + 4)
    again = common >= window
    pairs = np.flatnonzero(again)
    again[other[pairs]] = True  # and the suffix before it
    return [again[a:a + n - window + 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


# ---- shards -----------------------------------------------------------------------------------------------------

def window_runs(data: np.ndarray, borders: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: text, first and last window in it, and the key.

    The anchor of a window is the leftmost string of `gram` bytes with the least hash in it, the key is that hash. Equal
    windows have equal keys, and the windows of a run differ from each other.
    """
    n = len(data)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    value, size, base = mix(data.astype(np.uint64) + np.uint64(0x9E3779B9)), 1, 0x9E3779B97F4A7C15
    while size < gram:
        value = value[:-size] * np.uint64(base) + value[size:]
        size, base = 2 * size, base * base % 2**64
    value = mix(value)
    place_bits = np.uint64(int(n).bit_length())
    least = (value >> place_bits << place_bits) | np.arange(len(value), dtype=np.uint64)
    span, have = window - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    n_windows = np.maximum(np.diff(borders) - window + 1, 0)
    text = np.repeat(np.arange(len(n_windows)), n_windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + borders[text]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    anchor = anchor[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(text) != 0))))
    last = np.append(first[1:], len(at)) - 1
    return text[first], at[first], at[last], value[anchor[first]]


def _segment(batches: Iterator[pa.RecordBatch], often, hot, window: int) -> Iterator[pa.RecordBatch]:
    """Segments that may repeat, with their route; from the third equal one in a task on only its place, as settled.

    Copies of a text share their id and so their spans: the third one in a task has nothing to add.
    """
    seen: dict[bytes, int] = {}
    copies: dict[bytes, int] = {}
    held = 0
    for part in slices(batches, most=SLICE):
        data, borders = utf8(part.column("text"))
        text, first, last, key = window_runs(data, borders, window)
        pick = passes(often.value, key)
        single = np.zeros(len(key), bool)
        single[passes(hot.value, key)] = True
        raw, ids, out = data.tobytes(), part.column("id").to_pylist(), []
        known = np.zeros(len(ids), bool)
        for t, own in enumerate(ids):
            copies[own] = copies.get(own, 0) + 1
            known[t] = copies[own] > 2
        pick = pick[~known[text[pick]]]
        for t, a, b, k, alone in zip(text[pick].tolist(), first[pick].tolist(), last[pick].tolist(), key[pick].view(np.int64).tolist(), single[pick].tolist(), strict=True):
            origin = int(borders[t])
            for x, y in ((p, p) for p in range(a, b + 1)) if alone else ((a, b),):
                content = raw[x:y + window]
                n = seen[content] = seen.get(content, 0) + 1
                route = int.from_bytes(blake2b(content, digest_size=8).digest(), "little", signed=True) if alone else k
                if n > 2:  # settled: goes where its document does, not where its equals are
                    route = int.from_bytes(ids[t][:8], "little", signed=True)
                out.append((route, ids[t], x - origin, y + window - origin, content if n < 3 else None))
                held += len(content) if n == 1 else 0
            if held > 64 << 20:
                seen, copies, held = {}, {}, 0
        if out:
            route, own, start, end, content = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route, pa.int64()), pa.array(own, pa.binary()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(content, pa.binary())],
                ["route", "id", "start", "end", "content"])


def _shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Segments sorted by route -> the byte spans of each text that are covered by repeated windows."""
    spans: list[tuple[bytes, int, int]] = []
    chunk: list[tuple[bytes, list[tuple[bytes, int]]]] = []
    group: dict[bytes, list[tuple[bytes, int]]] = {}
    route, held = None, 0

    def close() -> int:
        """Ends the group of a route: equal contents are settled, different ones wait for the suffix array."""
        for content, places in group.items():
            if len(places) > 1:
                spans.extend((own, start, start + len(content)) for own, start in places)
        if len(group) > 1:
            chunk.extend(group.items())
            return sum(len(c) + 1 for c in group)
        return 0

    def solve() -> None:
        for (content, places), again in zip(chunk, repeated_windows([c for c, _ in chunk], window), strict=True):
            if len(places) > 1 or not again.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], again.astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                spans.extend((own, start + a, start + b - 1 + window) for own, start in places)

    def drain() -> pa.RecordBatch:
        own, start, end = zip(*spans, strict=True)
        spans.clear()
        return pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["id", "start", "end"])

    for batch in batches:
        for r, own, start, end, content in zip(*(batch.column(c).to_pylist() for c in ("route", "id", "start", "end", "content")), strict=True):
            if r != route:
                held += close()
                group, route = {}, r
                if held >= CHUNK:
                    solve()
                    chunk, held = [], 0
            if content is None:
                spans.append((own, start, end))
            else:
                group.setdefault(content, []).append((own, start))
        if len(spans) > 50_000:
            yield drain()
    close()
    if chunk:
        solve()
    if spans:
        yield drain()


def text_id(text: str):
    """16 bytes of the SHA-256 of a text: rows with equal texts share their spans."""
    return F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))


def repeated_spans(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(id, spans ARRAY<STRUCT<start, end>>): per distinct text the bytes covered by strings of `window` bytes that
    also start elsewhere in the table; id is text_id, the spans may overlap and have no order.

    1. The anchors of all windows are counted by their hash; those that occur twice go into a filter of fixed size.
    2. Segments around such anchors are dealt to shards by hash: equal windows have equal anchors, so whatever repeats
       meets in one shard. Equal segments are settled as they are, from the third in a task on already before the
       shuffle. A key of more than HOT_SEGMENTS segments is dealt by its windows one by one.
    3. A shard sorts the suffixes of its different segments and reads repeats off the common prefixes.
    Texts shorter than the window, null and empty texts have no spans. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= window)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(window_runs(*utf8(part.column("text")), window)[3].view(np.int64))], ["hash"])

    counted = written(rows.mapInArrow(keys, "hash long").groupBy("hash").count().where("count > 1"), "keys")
    often = spark.sparkContext.broadcast(hash_filter(counted, KEY_BITS))
    hot = spark.sparkContext.broadcast(hash_filter(counted.where(F.col("count") > HOT_SEGMENTS), KEY_BITS))
    segments = rows.withColumn("id", text_id("text")).mapInArrow(
        lambda batches: _segment(batches, often, hot, window), "route long, id binary, start int, end int, content binary")
    found = segments.repartition("route").sortWithinPartitions("route").mapInArrow(lambda batches: _shard(batches, window), "id binary, start int, end int")
    return found.distinct().groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def cut_out(data: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left without the spans, and the maximal removed runs."""
    runs: list[list[int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans or ()):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    kept, at = [], 0
    for start, end in runs:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in runs]


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, runs ARRAY<STRUCT<start, end>>, kept BINARY) of every row.

    kept has the bytes of the text without those covered by a repeated string, judged on the input; runs are the
    maximal removed ones. Copies lose everything that is long enough, all copies alike; a null text counts as empty.
    Rows that repeat an id, and null ids, are separate documents. An empty table gives no rows; other columns are not read.
    """
    spans = repeated_spans(docs, window, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = rows.withColumn("id", text_id("text")).join(spans, "id", "left").select("doc_id", "text", "spans")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, borders = utf8(part.column("text"))
            raw, ends = data.tobytes(), borders.tolist()
            got = [cut_out(raw[a:b], x) for a, b, x in zip(ends, ends[1:], part.column("spans").to_pylist(), strict=False)]
            runs = pa.array([[{"start": a, "end": b} for a, b in r] for _, r in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(borders)), runs, pa.array([k for k, _ in got], pa.binary())], ["doc_id", "n_bytes", "runs", "kept"])

    return joined.mapInArrow(kept, "doc_id long, n_bytes long, runs array<struct<start:int,end:int>>, kept binary")
