"""Keyed state of streams: what keys must remember between batches lives in the state store, by bucket of keys.

A call to the state store from Python costs more than a thousand rows, so keys share buckets: the state of a bucket is
one JSON value, which a batch reads and writes once for all of its keys in that bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Part of what is stored: a stream that has state must go on with the same number.
BUCKETS = 1024


def bucketed(df: DataFrame, *key: str) -> DataFrame:
    """Adds `bucket`, the bucket of a key."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int"))


class Remembered:
    """A JSON value of the bucket that is being handled; `empty` until something is stored."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, empty: Callable[[], Any] = dict) -> None:
        self.state, self.empty = handle.getValueState(name, "value string"), empty

    def load(self) -> Any:
        stored = self.state.get()
        return self.empty() if stored is None or stored[0] is None else json.loads(stored[0])

    def store(self, value: Any) -> None:
        self.state.update((json.dumps(value, separators=(",", ":")),))


def run_available(
    writer: DataStreamWriter, folder: str, one_batch: Callable[[DataFrame, int], None], spark
) -> StreamingQuery:
    """Starts a stream with keyed state over what is available; progress and state are kept in `folder`.

    Value states and their timers need the RocksDB store. A query takes its own copy of the settings when it
    starts, so the session gets back what it had.
    """
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return (
            writer.foreachBatch(one_batch)
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def millis(at: datetime) -> int:
    """Milliseconds since 1970 of a session timestamp, which Spark hands out in local time."""
    return int(at.astimezone(timezone.utc).timestamp() * 1000)


class FirstOwner(StatefulProcessor):
    """One remembered row per key: the earliest that asked. Rows go on with what was remembered before their batch.

    `fields` are kept, numbers and texts, `order` says which row of a batch is the earliest. The rows of a bucket pass by
    one at a time; one row a key is collected.
    """

    def __init__(self, key: list[str], fields: str, order: str) -> None:
        self.key, self.order = key, order
        self.names = [f.split()[0] for f in fields.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owners = Remembered(handle, "owners")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        owners = self.owners.load()
        earliest: dict[str, Row] = {}
        for row in rows:
            name = json.dumps([row[k] for k in self.key])
            kept = owners.get(name)
            if kept is None and (name not in earliest or row[self.order] < earliest[name][self.order]):
                earliest[name] = row
            yield Row(**row.asDict(), owner=None if kept is None else Row(**dict(zip(self.names, kept, strict=True))))
        if earliest:
            self.owners.store(owners | {name: [row[n] for n in self.names] for name, row in earliest.items()})

    def close(self) -> None:
        pass
