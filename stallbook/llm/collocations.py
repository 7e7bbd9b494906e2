"""Phrase collocations: suffix pointers, routed by their leading words, are sorted by a multikey three-way quicksort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallbook.llm.base import LOWER, hash_filter, mix, passes, utf8, word_hashes
from stallbook.session import written

#: Words of the longest phrase.
DEPTH = 4
#: Occurrences of a phrase to be a candidate.
LEAST = 30
#: Phrases reported per language.
TOP = 2000
#: A phrase is dropped if a longer one around it has this share of its occurrences.
PERCENT = 80
#: Leading words are routed whole unless one of them holds more than 1 / SHARE of all pointers, so at most SHARE do.
SHARE = 4096
#: Bytes of text looked at together; longer texts are cut between pieces.
SLICE = 1 << 20
#: Suffix pointers sorted together; each takes about a kilobyte of memory meanwhile.
CHUNK = 100_000

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_GAP = _BREAK.copy()
_GAP[list(BLANKS)] = True


# ---- words ------------------------------------------------------------------------------------------------------

class Words:
    """The words of one slice: where they lie, numbers that are equal for equal words, and how far each piece goes on."""

    def __init__(self, data: np.ndarray, heads: np.ndarray, langs: np.ndarray) -> None:
        """data: lower-cased bytes; heads: first byte of each text, or part of one; langs: number of its language."""
        inside = ~_GAP[data]
        first = np.zeros(len(data) + 1, bool)
        first[heads] = True
        first[-1] = True
        self.data = data
        self.starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
        self.ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        text = np.searchsorted(heads, self.starts, "right") - 1
        self.lang = langs[text]
        piece = np.cumsum(_BREAK[data])[self.starts] + text
        n = len(self.starts)
        #: Words from this one on in its piece, DEPTH at most.
        self.room = np.ones(n, np.int8)
        for k in range(1, DEPTH):
            self.room[:n - k][piece[k:] == piece[:n - k]] = k + 1
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.code, self.sample = same_words(data, self.starts, self.ends, self.hashes)

    def spelled(self, at: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that start at these words, joined by spaces."""
        columns = []
        for k in range(words):
            a, b = self.starts[at + k], self.ends[at + k]
            columns.append(_strings(self.data, a, b))
        return columns[0] if words == 1 else pa.compute.binary_join_element_wise(*columns, " ")


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    borders = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(borders[-1]) + np.repeat(starts - borders[:-1], sizes)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal just for equal words, and one place of each number.

    Words are told apart by hash and then compared byte by byte with the first of their hash; where a hash stands for
    two words, the words themselves are numbered.
    """
    _, sample, code = np.unique(hashes, return_index=True, return_inverse=True)
    first = sample[code]
    equal = (ends - starts) == (ends - starts)[first]
    sizes = np.where(equal, ends - starts, 0)
    before = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    unlike = data[np.repeat(starts, sizes) + step] != data[np.repeat(starts[first], sizes) + step]
    if equal.all() and not unlike.any():
        return code, sample
    raw = data.tobytes()
    names = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    numbers: dict[bytes, int] = {}
    code = np.array([numbers.setdefault(w, len(numbers)) for w in names])
    return code, np.unique(code, return_index=True)[1]


def _cuts(data: np.ndarray, most: int) -> list[int]:
    """Where to cut a long run of bytes: behind a break each time, so that no phrase lies across."""
    breaks = np.flatnonzero(_BREAK[data]) + 1
    cuts, at = [], 0
    while len(data) - at > most:
        k = int(np.searchsorted(breaks, at + most, "right"))
        after = breaks[k - 1] if k and breaks[k - 1] > at else breaks[k] if k < len(breaks) else len(data)
        if after >= len(data):
            break
        cuts.append(int(after))
        at = int(after)
    return cuts


def word_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[Words, list[str]]]:
    """The words of the texts (lang, text), about `most` bytes at a time, with the names of the languages."""
    for batch in batches:
        data, borders = utf8(batch.column("text"))
        lang = batch.column("lang").dictionary_encode()
        names, numbers = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        heads = borders[:-1]
        full = heads < borders[1:]
        heads, numbers = heads[full], numbers[full]
        data = LOWER[data]
        # Texts that start inside a slice go to the next one unless they are cut themselves.
        cuts, at = [], 0
        while len(data) - at > most:
            k = int(np.searchsorted(heads, at + most, "right")) - 1
            if k >= 0 and heads[k] > at:
                cuts.append(int(heads[k]))
            else:
                end = int(heads[k + 1]) if k + 1 < len(heads) else len(data)
                cuts += [at + c for c in _cuts(data[at:end], most)]
                if end < len(data):
                    cuts.append(end)
                else:
                    break
            at = cuts[-1]
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            if a < b:
                here = np.searchsorted(heads, [a, b], "left")
                own, langs = heads[here[0]:here[1]] - a, numbers[here[0]:here[1]]
                if not len(own) or own[0] > 0:
                    own, langs = np.concatenate(([0], own)), np.concatenate((numbers[here[0] - 1:here[0]], langs))
                yield Words(data[a:b], own, langs), names


def _lang_hashes(names: list[str]) -> np.ndarray:
    return mix(np.array([int.from_bytes(x.encode()[:8].ljust(8, b"\0"), "little") ^ (len(x.encode()) << 56) for x in names], np.uint64))


def route_hashes(langs: np.ndarray, hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of a language and the n words from each of these places on, from the hashes of both."""
    value = langs
    for k in range(n):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
    return value


def split_phrases(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some phrases, where their words start and end, and the first word and the number of words of each."""
    data, borders = utf8(column)
    lead = np.concatenate((np.ones(min(len(data), 1), bool), data[:-1] == 32))  # words are joined by single spaces
    lead[borders[:-1][borders[:-1] < len(data)]] = True
    starts = np.flatnonzero(lead)
    ends = np.append(starts[1:], len(data)) - 1
    ends[np.searchsorted(starts, borders[1:], "left") - 1] = borders[1:]
    first = np.searchsorted(starts, borders[:-1], "left")
    return data, starts, ends, first, np.diff(np.append(first, len(starts)))


# ---- leading words ----------------------------------------------------------------------------------------------

def _counted(words: Words, names: list[str], at: np.ndarray, codes: list[np.ndarray], n: int) -> pa.RecordBatch:
    """(lang, phrase, n) of the distinct phrases of n words that start at these words."""
    order = np.lexsort([words.lang[at], *codes])
    at = at[order]
    fresh = np.concatenate(([True], np.diff(words.lang[at]) != 0))
    for c in codes:
        fresh[1:] |= np.diff(c[order]) != 0
    heads = np.flatnonzero(fresh)
    counts = np.diff(np.append(heads, len(at)))
    at = at[heads]
    lang = pa.array(names, pa.string()).take(pa.array(words.lang[at]))
    return pa.RecordBatch.from_arrays([lang, words.spelled(at, n), pa.array(counts)], ["lang", "phrase", "n"])


def leading_words(rows: DataFrame, least: int) -> DataFrame:
    """(lang, words, phrase, n) of words and pairs of words that occur `least` times or more, written.

    With words = 0 and an empty phrase: all word occurrences of the language. Counted in slices, in tasks, then over all.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, names in word_slices(batches):
            at = np.arange(len(words.starts))
            if not len(at):
                continue
            langs = np.bincount(words.lang, minlength=len(names))
            seen = np.flatnonzero(langs)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in seen], pa.string()), pa.array([""] * len(seen), pa.string()), pa.array(langs[seen])], ["lang", "phrase", "n"])
            yield _counted(words, names, at, [words.code], 1)
            pairs = at[words.room > 1]
            if len(pairs):
                yield _counted(words, names, pairs, [words.code[pairs], words.code[pairs + 1]], 2)

    summed = rows.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    number = F.when(F.col("phrase") == "", 0).when(F.contains("phrase", F.lit(" ")), 2).otherwise(1)
    return written(summed.where((F.col("n") >= least) | (F.col("phrase") == "")).select("lang", number.alias("words"), "phrase", "n"), "leading-words")


# ---- suffix pointers --------------------------------------------------------------------------------------------

def multikey_quicksort(symbols: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, one row, size) of the partitions of rows that agree on their first `depth` symbols, as they come up.

    A three-way quicksort on one symbol at a time: each partition is split at a pivot into rows with a smaller, the
    same and a larger symbol; the middle one goes on with the next symbol, to the last one, and its summed weights are
    its size. All partitions of a round are split together. What weighs less than `least` is abandoned at once, and so
    is what has ended (symbol 0).
    """
    n, last = symbols.shape
    order = np.arange(n)
    heads, depth = np.zeros(1 if n else 0, np.int64), np.zeros(1 if n else 0, np.int64)
    while len(heads):
        sizes = np.diff(np.append(heads, len(order)))
        own = np.repeat(np.arange(len(heads)), sizes)
        symbol = symbols[order, depth[own]]
        a, b, c = symbol[heads], symbol[heads + sizes // 2], symbol[heads + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[own]
        side = own * 3 + (symbol >= pivot) + (symbol > pivot)
        size = np.bincount(side, minlength=3 * len(heads))
        # Rows move to their side in one pass, keeping their order there.
        by = np.argsort(side, kind="stable")
        order, weight = order[by], weights[order[by]]
        starts = np.cumsum(size) - size
        some = np.flatnonzero(size)
        total = np.zeros(len(size), np.int64)
        total[some] = np.add.reduceat(weight, starts[some])
        level = np.repeat(depth, 3)
        middle = np.arange(len(size)) % 3 == 1
        level[middle] += 1
        lead = np.zeros(len(size), np.int64)
        lead[some] = order[starts[some]]
        go = (size > 0) & (total >= least)
        go[middle] &= symbols[lead[middle], level[middle] - 1] > 0
        found = go & middle
        for d in np.unique(level[found]).tolist():
            pick = found & (level == d)
            yield d, lead[pick], total[pick]
        go &= level < last
        keep = np.repeat(go, size)
        order = order[keep]
        heads, depth = (np.cumsum(size[go]) - size[go]), level[go]


def _phrases(langs: pa.Array, windows: pa.Array, weights: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, n) of the phrases of three words and more that lead the windows."""
    data, starts, ends, first, length = split_phrases(windows)
    code, _ = same_words(data, starts, ends, word_hashes(data, starts, ends))
    lang = langs.dictionary_encode()
    symbols = np.zeros((len(windows), DEPTH + 1), np.int64)
    symbols[:, 0] = lang.indices.to_numpy() + 1
    for k in range(DEPTH):
        has = length > k
        symbols[has, k + 1] = code[first[has] + k] + 1
    for depth, lead, size in multikey_quicksort(symbols, weights, least):
        if depth >= 4:
            spelled = _strings(data, starts[first[lead]], ends[first[lead] + depth - 2])
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lead)), pa.array(np.full(len(lead), depth - 1, np.int32)), spelled, pa.array(size)], ["lang", "words", "phrase", "n"])


def sort_routes(batches: Iterator[pa.RecordBatch], least: int, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Windows sorted by (spread, route) -> counts of the phrases they lead with, to be summed.

    Whole routes are sorted together and what is infrequent in them is abandoned. A route of more than `chunk` windows,
    and windows that were spread over routes, have parts of their counts here only, so nothing of them is abandoned.
    """
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table, floor: int) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            yield from _phrases(table["lang"].combine_chunks(), table["phrase"].combine_chunks(), table["n"].to_numpy(), floor)

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        route = table["route"].to_numpy()
        spread = table["spread"].to_numpy().astype(bool)
        n_whole = int(np.searchsorted(spread, True))
        cut = table.num_rows
        if not last and n_whole == cut:
            cut = int(np.searchsorted(route, route[-1], "left"))
        if cut == 0:  # a single route as long as this
            yield from solve(table, 1)
            over[0] = int(route[-1])
            return
        whole = table.slice(0, min(cut, n_whole))
        if over[0] is not None:  # what is left of that route comes first
            n = int(np.searchsorted(route[:whole.num_rows], over[0], "right"))
            yield from solve(whole.slice(0, n), 1)
            whole, over[0] = whole.slice(n), None
        yield from solve(whole, least)
        yield from solve(table.slice(whole_end := min(cut, n_whole), cut - whole_end), 1)
        if cut < table.num_rows:
            held.extend(table.slice(cut).to_batches())

    over: list[int | None] = [None]
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield from close(False)
                n = sum(b.num_rows for b in held)
    if held:
        yield from close(True)


def longer_phrases(rows: DataFrame, leading: DataFrame, least: int, chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """(lang, words, phrase, n) of the phrases of three words and more that occur `least` times or more.

    Suffix pointers (windows of up to DEPTH words) whose leading pair is infrequent are abandoned; a window ends before
    its first infrequent pair. The others are dealt by language and leading pair, those of a pair with more than its
    share by the whole window. Equal windows of a slice travel as one with a weight. In the tasks a multikey three-way
    quicksort finds the partitions of equal phrases, whose sizes are their counts.
    """
    spark = rows.sparkSession
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends, first, _ = split_phrases(batch.column("phrase"))
            lang = batch.column("lang").dictionary_encode()
            langs = _lang_hashes(lang.dictionary.to_pylist())[lang.indices.to_numpy()]
            found = route_hashes(langs, word_hashes(data, starts, ends), first, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column("n")], ["hash", "n"])

    pairs = written(leading.where("words = 2").select("lang", "phrase", "n").mapInArrow(hashes, "hash long, n long"), "leading-pairs")
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("all")).first()
    bits = 1 << min(max(row["n"] * 16, 1 << 16).bit_length(), 26)
    often = spark.sparkContext.broadcast(hash_filter(pairs.select("hash"), bits))
    top = pairs.where(F.col("n") * share > (row["all"] or 0)).select("hash").toArrow()["hash"].to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(top.view(np.uint64)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, names in word_slices(batches):
            at = np.flatnonzero(words.room > 1)
            pair = np.zeros(len(words.starts) + DEPTH, bool)
            hashes = route_hashes(_lang_hashes(names)[words.lang[at]], words.hashes, at, 2)
            pair[at[passes(often.value, hashes)]] = True
            length = np.ones(len(words.starts), np.int64)
            for k in range(1, DEPTH):
                length += (length == k) & (words.room > k) & pair[k - 1:len(words.starts) + k - 1]
            route = np.zeros(len(words.starts), np.uint64)
            route[at] = hashes
            at = np.flatnonzero(length > 2)  # pairs are counted already
            if not len(at):
                continue
            symbols = np.zeros((len(at), DEPTH + 1), np.int64)
            symbols[:, DEPTH] = words.lang[at]
            for k in range(DEPTH):
                has = length[at] > k
                symbols[has, k] = words.code[at[has] + k] + 1
            order = np.lexsort(symbols.T)
            fresh = np.concatenate(([True], (np.diff(symbols[order], axis=0) != 0).any(axis=1)))
            heads = np.flatnonzero(fresh)
            weights = np.diff(np.append(heads, len(at)))
            at = at[order[heads]]
            own, size = route[at], length[at]
            spread = np.isin(own, hot.value)
            whole = own.copy()
            for k in range(2, DEPTH):
                has = spread & (size > k)
                whole[has] = mix(whole[has] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[at[has] + k])
            spelled = np.empty(len(at), object)
            for n in range(3, DEPTH + 1):
                pick = np.flatnonzero(size == n)
                if len(pick):
                    spelled[pick] = words.spelled(at[pick], n).to_numpy(zero_copy_only=False)
            lang = pa.array(names, pa.string()).take(pa.array(words.lang[at]))
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(whole.view(np.int64)), lang, pa.array(spelled, pa.string()), pa.array(weights)],
                                             ["spread", "route", "lang", "phrase", "n"])

    dealt = rows.mapInArrow(windows, "spread boolean, route long, lang string, phrase string, n long").repartition("route").sortWithinPartitions("spread", "route")
    found = dealt.mapInArrow(lambda batches: sort_routes(batches, least, chunk), "lang string, words int, phrase string, n long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- the operator -----------------------------------------------------------------------------------------------

def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, percent: int = PERCENT,
                 chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the most tightly bound phrases of two to DEPTH words of each language.

    Texts, A-Z in lower case, are cut into pieces at punctuation and line ends, pieces into words at blanks. a, l and r
    count the phrase and the two parts of its weakest cut, overlaps included; n is all words of the language; score is
    floor(2000000 * a / (l + r)), in exact arithmetic. Of equal cuts the first counts. Candidates occur `least` times; one
    inside a longer candidate with `percent` % of its occurrences or more is dropped. The first `top` by score, a
    and phrase stay; ties cannot remain, as phrases differ. Null texts count as empty, a null language as `und`; repeated
    rows count each time. Texts may have any length, and a word or phrase any share of them. Empty tables, and tables
    without candidates, give no rows; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    leading = leading_words(rows, least)
    longer = longer_phrases(rows, leading, least, chunk, share)
    counts = written(leading.where("words > 0").select("lang", "words", "phrase", "n").union(longer), "phrases")
    candidates = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(
        counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as bigint)")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    places = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    inside = candidates.where(F.size("w") > 2).select("lang", "a", places.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    tight = F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent)
    kept = scored.join(inside, ["lang", "phrase"], "left").where(tight).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = leading.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
