"""Session settings every job relies on, and where durable scratch tables go."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The settings that results depend on; all else is up to whoever made the session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated header or option name keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stallbook")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Recording the Python line of every column costs more than planning does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


#: Bytes of a given Parquet table to a shuffle partition of what is derived from it, and most shuffled bytes that adaptive
#: execution puts into one task. Rows take 30 to 50 times as much memory in the aggregates and sorts of a task.
TABLE_BYTES = 4 << 20
TASK_BYTES = 16 << 20
#: Whether the shuffle files of a query are removed when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@lru_cache(maxsize=256)
def _table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a table; their content is not read."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return files.agg(F.sum("length")).first()[0] or 0


def spread(spark: SparkSession, path: str) -> None:
    """Lets shuffles have partitions enough for a table of this size, so that the memory of a task does not grow with it.

    Only what adaptive execution starts from is raised, and its aim set where the session left it open: small partitions
    are still put together, and a session without adaptive execution keeps its own number.
    """
    start, aim = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    wanted = -(-_table_bytes(spark, path) // TABLE_BYTES)
    if wanted > int(spark.conf.get(start, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(start, str(wanted))
    if spark.conf.get(aim, None) is None:
        spark.conf.set(aim, str(TASK_BYTES))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, the storage all executors see.

    A session on one machine (tests, the benchmark) may leave the setting out and gets a
    temporary folder; on a cluster a missing setting is an error, since executors would
    write to disks that the others cannot read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    For a result that several parts of a plan need: it is computed once, and a lost
    executor costs a read instead of a recomputation. What its own shuffles left on the
    disks is removed then, and not when the driver next collects garbage.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
