"""Byte-level BPE by prefix tables: each prefix of a piece keeps the last token of its only valid encoding."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.base import slices

#: Pieces that a task remembers: so many, and as many older ones. Also the most pairs of tokens.
REMEMBERED = 120_000
#: Tokens that are put together at once, so that memory follows the text and not several times its length.
TOGETHER = 1 << 17


class Vocabulary:
    """Token bytes with their ranks, as read from a rank file."""

    def __init__(self, lines: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.endings = ahocorasick.Automaton()  # the tokens that end at each byte, the longest first
        for token, rank in self.ranks.items():
            self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()
        self.known_fits: dict[int, bool] = {}
        self.known_alone: dict[int, bool] = {}
        self._edges: dict[int, tuple[list, list]] = {}
        self.sizes = np.zeros(max(self.tokens, default=-1) + 1, np.int64)  # the tokens one after the other, by rank
        self.sizes[list(self.tokens)] = list(map(len, self.tokens.values()))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.tokens[rank] for rank in sorted(self.tokens)), np.uint8)

    def merged(self, data: bytes, most: int = 1) -> list[bytes]:
        """The encoding by its definition: join the neighbours of the lowest rank, leftmost first, until none or `most` are left."""
        parts, none = [data[i:i + 1] for i in range(len(data))], len(self.ranks) + 1
        while len(parts) > most:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if rank == none:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, token: int) -> bool:
        """Does the token encode its own bytes?"""
        if token not in self.known_alone:
            self.known_alone[token] = self.merged(self.tokens[token]) == [self.tokens[token]]
        return self.known_alone[token]

    def edges(self, token: int) -> tuple[list, list]:
        """What stands at the left and at the right edge of a token while it is merged: (bytes, from rank, up to rank)."""
        if token not in self._edges:
            sides = []
            for side in (0, -1):
                node, until, out = self.tokens[token], len(self.ranks) + 1, []
                while True:
                    own = self.ranks[node] if len(node) > 1 else -1
                    out.append((node, own, until))
                    if len(node) == 1:
                        break
                    node, until = self.merged(node, 2)[side], own
                sides.append(out)
            self._edges[token] = sides[0], sides[1]
        return self._edges[token]

    def fits(self, left: int, right: int) -> bool:
        """Do the two tokens stay as they are side by side? An encoding is valid if all its neighbours fit.

        They do not if two of their parts that stand side by side at some time would join before either joins its own.
        """
        pair = left << 32 | right
        got = self.known_fits.get(pair)
        if got is None:
            if len(self.known_fits) > REMEMBERED:
                self.known_fits.clear()
                self._edges.clear()
            got = self.known_fits[pair] = self._stay(self.edges(left)[1], self.edges(right)[0])
        return got

    def _stay(self, ends: list, starts: list) -> bool:
        get = self.ranks.get
        for x, since_x, until_x in ends:
            for y, since_y, until_y in starts:
                if since_x < until_y and since_y < until_x:
                    rank = get(x + y)
                    if rank is not None and rank < until_x and rank <= until_y:
                        return False
        return True


class PrefixTable:
    """The encoding of a growing or edited piece of bytes.

    last[i] is the last token of the encoding of the first i + 1 bytes. That encoding is unique, so exactly one token
    that ends there fits to the encoding before it.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Adds bytes; nothing before them is encoded again."""
        self.data += data
        self._fill(len(self.data))

    def _fill(self, to: int) -> None:
        v, last = self.vocabulary, self.last
        fits, alone, done = v.known_fits.get, v.known_alone.get, len(last)
        for at, (token, size) in v.endings.iter(self.data.decode("latin-1"), max(done - v.longest, 0), to):
            if at < done:
                continue  # a shorter token at a place that is settled
            if at > done:
                break
            if size > at:
                ok = alone(token)
                if ok is None:
                    ok = v.alone(token)
            else:
                left = last[at - size]
                ok = fits(left << 32 | token)
                if ok is None:
                    ok = v.fits(left, token)
            if ok:
                last.append(token)
                done += 1
        if done < to:
            raise ValueError(f"no token for byte {self.data[done]}")

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts data in place of data[start:end]; returns how many prefixes were encoded again.

        Behind the edit the table is kept as soon as it agrees with the old one over the longest token, since a last
        token depends on no more than that.
        """
        tail, old = self.data[end:], self.last[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(data)
        self.data += tail
        same = 0
        for k in range(len(tail)):
            self._fill(start + len(data) + k + 1)
            same = same + 1 if self.last[-1] == old[k] else 0
            if same >= self.vocabulary.longest:
                self.last += old[k + 1:]
                return len(data) + k + 1
        return len(data) + len(tail)

    def tokens(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Pieces(dict):
    """Piece -> its ids as 32-bit integers; pieces met again stay remembered."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        got = self.older.get(piece)
        if got is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            got = array("i", PrefixTable(self.vocabulary, data).tokens() if whole is None else (whole,)).tobytes()
        if len(piece) <= 64:
            self[piece] = got
        return got


class Encoder:
    """Texts to ids and back; each match of the pattern is encoded by itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.pattern, self.pieces = vocabulary, regex.compile(pattern), Pieces(vocabulary)

    def encode(self, text: str) -> array:
        return array("i", b"".join(map(self.pieces.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: array) -> bytes:
        v, ids, out = self.vocabulary, np.frombuffer(ids, np.int32), []
        for k in range(0, len(ids), TOGETHER):
            part = ids[k:k + TOGETHER]
            sizes = v.sizes[part]
            before = np.cumsum(sizes) - sizes
            out.append(v.data[np.repeat(v.starts[part] - before, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(out)

    def extend(self, text: str, ids: array, more: str) -> array:
        """The ids of text + more: only the last three pieces of text, which the pattern may cut anew, are encoded again."""
        pieces = self.pattern.findall(text)
        back = "".join(pieces[-3:])
        again = sum(len(self.pieces[p]) for p in pieces[-3:]) // ids.itemsize
        return ids[:len(ids) - again] + self.encode(back + more)


@lru_cache(maxsize=2)
def _encoder(lines: bytes, pattern: str) -> Encoder:
    return Encoder(Vocabulary(lines), pattern)


def _shared(docs: DataFrame, vocabulary: str) -> Broadcast:
    """The rank file, read on the driver: its size is that of the vocabulary, whatever the input."""
    with open(vocabulary, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, vocabulary: str, pattern: str, decode: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids ARRAY<INT>[, decoded BINARY]) of every row, from its whole text; decoded holds the bytes of the ids.

    Null and empty texts give no ids. Rows that repeat an id, and null ids, are encoded like others. An empty table
    gives no rows; other columns are not read. There is no shuffle: a lost task encodes its rows again.
    """
    lines = _shared(docs, vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lines.value, pattern)
        for part in slices(batches):
            ids, ends, decoded = array("i"), [0], []
            for value in part.column("text").to_pylist():
                own = encoder.encode(value or "")
                if decode:
                    decoded.append(encoder.decode(own))
                ids.extend(own)
                ends.append(len(ids))
            columns = {"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))}
            if decode:
                columns["decoded"] = pa.array(decoded, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, ids array<int>" + ", decoded binary" * decode)
