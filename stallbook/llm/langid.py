"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.base import slices, utf8

#: Hash buckets of the n-grams; the matrix has one row of so many log probabilities a language.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bytes of text handled at a time; each takes about 50 bytes of memory.
SLICE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower case letter, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            table[i] = ord(small) if len(small) == 1 else i
    return table


def grams(part: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each order, by place; the limits of each text in these; and whether it has a letter.

    Letters in lower case, everything else as one blank each, two blanks between texts.
    """
    data, borders = utf8(part.column("text"))
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[borders]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(borders) - 1
    starts, sizes = before[:-1] + 2 * np.arange(n) + 1, np.diff(before)
    signs = np.zeros(len(points) + 2 * n + 3, np.uint32)
    signs[np.arange(len(points)) + np.repeat(2 * np.arange(n) + 1, sizes)] = _letters()[points]
    orders = []
    value = np.zeros(len(signs) - 3, np.uint32)
    for k in range(max(ORDERS)):
        value = (value + signs[k:len(signs) - 3 + k]) * np.uint32(0x9E3779B1) + np.uint32(k + 1)
        if k + 1 in ORDERS:
            orders.append((((value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(16)).astype(np.int64) % BUCKETS)
    limits = np.stack((starts - 1, starts + sizes), axis=1)
    lettered = np.add.reduceat((signs > 0).astype(np.int64), limits.ravel())[::2] > 0 if n else np.zeros(0, bool)
    return orders, limits, lettered


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_probabilities: np.ndarray  # languages x BUCKETS
    priors: np.ndarray


def train(rows: DataFrame) -> Model:
    """From (lang, text): counts per language and bucket, summed in tasks and then in Spark.

    Only these sums, at most BUCKETS + 1 a language, reach the driver. Rows with a null are left out.
    """
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches, most=SLICE):
            orders, limits, _ = grams(part)
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                total = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                own = [k for k, x in enumerate(langs) if x == lang]
                for order in orders:
                    total[:BUCKETS] += np.bincount(np.concatenate([order[a:b] for a, b in limits[own]]), minlength=BUCKETS)
                total[BUCKETS] += len(own)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    known = rows.select("lang", "text").where("lang is not null and text is not null")
    got = known.mapInArrow(counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = got["lang"].to_pylist()
    languages = sorted(set(langs))
    table = np.zeros((len(languages), BUCKETS + 1))
    place = {x: k for k, x in enumerate(languages)}
    table[[place[x] for x in langs], got["bucket"].to_numpy()] = got["n"].to_numpy()
    seen = table[:, :BUCKETS] + 0.5
    priors = np.log(table[:, BUCKETS]) - np.log(max(table[:, BUCKETS].sum(), 1))
    return Model(languages, np.log(seen / seen.sum(axis=1, keepdims=True)), priors)


def scores(part: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each text, -1 without a letter, and its probability."""
    orders, limits, lettered = grams(part)
    n = len(limits)
    best, probability = np.full(n, -1), np.zeros(n)
    if not n or not model.languages:
        return best, probability
    sums = np.tile(model.priors, (n, 1))
    for k in range(len(model.languages)):
        for order in orders:
            values = np.concatenate((model.log_probabilities[k][order], [0.0]))
            sums[:, k] += np.add.reduceat(values, np.minimum(limits.ravel(), len(values) - 1))[::2]
    top = sums.argmax(axis=1)  # the first of equals
    share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(lettered, top, best), np.where(lettered, share, probability)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. Among equally likely
    languages the first by name wins. Rows that repeat an id, and null ids, are scored like others; an empty table
    gives no rows. The broadcast matrix has BUCKETS numbers a language; there is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for part in slices(batches, most=SLICE):
            best, probability = scores(part, model)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(probability)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: CRC-32 of its id as text leaves 1 when divided by three."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
