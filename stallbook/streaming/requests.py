"""Idempotent requests as a stream: the owner of a key is remembered between batches, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from ..functions.digest import sha256_hex
from ..operators.cart import REQUEST_KEY, arbitrate
from ..session import configure
from ..sources.tables import replace_batch
from .state import FirstOwner, bucketed, run_available

OWNER = "arrival bigint, request_sha256 string, finished_us bigint, response_status int"


def start_arbitration(requests: DataFrame, folder: str) -> StreamingQuery:
    """Judges the requests of a stream; decisions are a table in `folder`, owners are state.

    A key belongs to the first batch that names it, in that batch to its earliest arrival. What a batch reads is its
    own rows and the state of its keys' buckets. A repeated batch
    starts from the same state and overwrites its own decisions. Keys are kept for ever.
    """
    hashed = requests.withColumn("response_status", F.col("response_status").cast("int")).withColumn(
        "request_sha256", sha256_hex(F.coalesce("body", F.lit("null")))
    ).withColumn("finished_us", F.unix_micros("finished_at"))
    schema = StructType([*hashed.schema.fields, StructField("owner", StructType.fromDDL(OWNER))])
    faced = bucketed(hashed, *REQUEST_KEY).groupBy("bucket").transformWithState(
        FirstOwner(REQUEST_KEY, OWNER, "arrival"), schema, "Append", "None"
    )

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        session = configure(batch.sparkSession)
        # The state is moved on once: everything else reads the written rows.
        replace_batch(batch, f"{folder}/faced", batch_id)
        faced = session.read.schema(schema).parquet(f"{folder}/faced/batch_id={batch_id}")
        owners = faced.where("owner is not null").select(*REQUEST_KEY, "owner.*").distinct().withColumn(
            "finished_at", F.timestamp_micros("finished_us")
        )
        replace_batch(arbitrate(faced.drop("owner", "finished_us"), owners), f"{folder}/decisions", batch_id)

    return run_available(faced.writeStream, folder, one_batch, requests.sparkSession)
