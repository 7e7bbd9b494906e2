"""Feeds, catalogue, log and run history as stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feed import check_feed, check_metadata
from ..operators.ranking import positions
from ..session import written

PRICE = "struct<amount:bigint,currency:string>"
MEDIA = "array<struct<type:string,url:string,alt_text:string>>"
PRODUCT_SCHEMA = (
    "id string, title string, description struct<plain:string>, media " + MEDIA + ", "
    "variants array<struct<id:string,title:string,description:struct<plain:string>,"
    f"price:{PRICE},list_price:{PRICE},availability:struct<available:boolean,status:string>,"
    "categories:array<struct<value:string,taxonomy:string>>,"
    f"variant_options:array<struct<name:string,value:string>>,media:{MEDIA}>>"
)
# Lines, and then hashes, that one hash of a feed digest covers, and how often this is done.
DIGEST_LINES, DIGEST_LEVELS = 4096, 3


_MANIFEST = "feed_id string, products string, metadata string"
_POINTER = "number bigint, version string"


def _manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number of the latest publish, and (feed_id, products, metadata): the versions that are on sale after it."""
    spark.createDataFrame([], _POINTER).write.mode("ignore").parquet(f"{path}/pointer")
    last = spark.read.schema(_POINTER).parquet(f"{path}/pointer").agg(
        F.max("number").alias("number"), F.max_by("version", "number").alias("version")
    ).first()
    if last["number"] is None:
        return 0, spark.createDataFrame([], _MANIFEST)
    return last["number"], spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{last['version']}")


def write_feed(lines: DataFrame, metadata: DataFrame, path: str) -> None:
    """Replaces the feeds named in `lines` and `metadata`, all at once; other feeds stay as they are.

    Lines and metadata go into folders of a new version; the manifest says for each feed which version of either is on
    sale. One row appended to the pointer puts a manifest in force. Whatever fails before that changes nothing
    for readers, and a reader sees lines and metadata of the same publish. A feed of `metadata` without lines has no
    products from then on. Earlier versions stay; one publish runs at a time on a store.
    """
    spark = lines.sparkSession
    number, before = _manifest(spark, path)
    version = f"{number + 1:012d}-{uuid.uuid4().hex[:12]}"
    lines.select("feed_id", "first_row", "product.*").sortWithinPartitions("feed_id", "first_row").drop("first_row").write.partitionBy(
        "feed_id"
    ).json(f"{path}/products/version={version}")
    metadata.withColumn("feed_id", F.col("id")).write.partitionBy("feed_id").json(f"{path}/metadata/version={version}")

    named = lambda kind: _stored(spark, path, kind, version).select("feed_id").distinct()
    touched = named("products").withColumn("has_lines", F.lit(True)).join(
        named("metadata").withColumn("has_metadata", F.lit(True)), "feed_id", "full"
    )
    now = F.lit(version)
    after = before.join(touched, "feed_id", "full").select(
        "feed_id",
        F.when(F.col("has_lines") | F.col("has_metadata"), now).otherwise(F.col("products")).alias("products"),
        F.when(F.col("has_metadata"), now).otherwise(F.col("metadata")).alias("metadata"),
    )
    after.write.parquet(f"{path}/manifests/{version}")
    put_in_force(spark, path, number + 1, version)


def put_in_force(spark: SparkSession, path: str, number: int, version: str) -> None:
    """The one write that readers notice: a single file with a single row."""
    spark.createDataFrame([(number, version)], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def publish(lines: DataFrame, metadata: DataFrame, path: str) -> DataFrame:
    """Publishes the feeds that keep to the schema and returns the violations of the others.

    A feed with any violation, in a line or in its metadata, stays as it was published before. Lines and violations
    are computed once and before anything is published.
    """
    lines = written(lines, "lines")
    broken = written(check_feed(lines).unionByName(check_metadata(metadata)), "violations")
    bad = broken.select("feed_id").distinct()
    write_feed(
        lines.join(bad, "feed_id", "left_anti"), metadata.join(bad.withColumnRenamed("feed_id", "id"), "id", "left_anti").where("id is not null"), path
    )
    return broken


_STORED = {
    "products": PRODUCT_SCHEMA,
    "metadata": "id string, target_country string, updated_at string",
}


def _stored(spark: SparkSession, path: str, kind: str, version: str | None = None) -> DataFrame:
    """What is stored of one kind, of all versions or of one; a condition on feed_id reads the folders of that feed."""
    folder = f"{path}/{kind}" + (f"/version={version}" if version else "")
    schema = _STORED[kind] + ", feed_id string" + ("" if version else ", version string")
    return spark.read.schema(schema).option("basePath", folder).json(folder)


def read_feed(spark: SparkSession, path: str, feed_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(product lines, metadata) of the publish in force. Blank lines are skipped; one feed reads its own folders only."""
    _, manifest = _manifest(spark, path)
    if feed_id is not None:
        manifest = manifest.where(F.col("feed_id") == feed_id)

    def in_force(kind: str) -> DataFrame:
        if feed_id is None:
            on_sale = manifest.select("feed_id", F.col(kind).alias("version"))
            return _stored(spark, path, kind).join(on_sale, ["feed_id", "version"], "left_semi").drop("version")
        version = manifest.first()[kind]
        if version is None:
            return spark.createDataFrame([], _STORED[kind] + ", feed_id string")
        return _stored(spark, path, kind, version).where(F.col("feed_id") == feed_id)

    if manifest.isEmpty():
        lines, metadata = (spark.createDataFrame([], _STORED[k] + ", feed_id string") for k in ("products", "metadata"))
    else:
        lines, metadata = in_force("products").where("id is not null"), in_force("metadata")
    return lines.select("feed_id", F.struct(*[c for c in lines.columns if c != "feed_id"]).alias("product")), metadata


def feed_digest(lines: DataFrame) -> DataFrame:
    """Content digest per feed: 32 hex digits. `lines`: feed_id, ord (distinct), line.

    Blocks of DIGEST_LINES lines are hashed, then blocks of hashes, DIGEST_LEVELS times for a
    feed of any size; no task sees all of a feed.
    """
    placed = positions(lines, ["feed_id"], ["ord"], "place")
    level = placed.select("feed_id", (F.col("place") - 1).alias("at"), F.col("line").alias("text"))
    for _ in range(DIGEST_LEVELS):
        entries = F.array_sort(F.collect_list(F.struct("at", "text")))
        joined = F.array_join(F.transform(entries, lambda e: e["text"]), "\n")
        hashed = F.sha2(joined, 256)
        level = level.groupBy("feed_id", F.floor(F.col("at") / DIGEST_LINES).cast("bigint").alias("block")).agg(
            hashed.alias("text")
        ).withColumnRenamed("block", "at")
    return level.select("feed_id", F.left("text", F.lit(32)).alias("digest"))


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Adds rows to an append-only table; existing rows are never touched."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes one batch of an append-only table so that writing it again changes nothing."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
