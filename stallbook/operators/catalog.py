"""The live catalogue: keyed upsert, patches and lookups, as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["merchant_id", "variant_id"]
FIELDS = ["product_id", "title", "price_minor", "currency", "availability", "category"]


def catalog_rows(servable: DataFrame, now: str) -> DataFrame:
    """Servable variants in catalogue form; `ord` keeps their publishing order."""
    return servable.select(
        *KEY, *FIELDS, F.lit(now).cast("timestamp").alias("updated_at"),
        F.struct("file", "sheet", "row", "option_ord").alias("ord"),
    )


def upsert_catalog(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalogue after a publish: all fields replaced, nothing deleted.

    Of a variant published twice the later row (largest `ord`) stays. The incoming
    side is reduced first; current rows then meet it by key.
    """
    latest = incoming.groupBy(*KEY).agg(
        F.max_by(F.struct(*FIELDS, "updated_at"), "ord").alias("fresh")
    )
    kept = F.col("fresh").isNull()
    return current.join(latest, KEY, "full_outer").select(
        *KEY,
        *[F.when(kept, F.col(c)).otherwise(F.col(f"fresh.{c}")).alias(c) for c in [*FIELDS, "updated_at"]],
    )


def rows_written(incoming: DataFrame) -> DataFrame:
    """How many rows a publish wrote per merchant: both copies of a variant published twice count."""
    return incoming.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("rows_written"))


def patch_catalog(current: DataFrame, changes: DataFrame, field: str, now: str) -> DataFrame:
    """One attribute (price_minor or availability) replaced where a change names the row.

    Of several changes of a row the last one (largest `ord`) counts, of equally late ones that with the largest value.
    """
    if field not in ("price_minor", "availability"):
        raise ValueError(f"{field} is not a patchable attribute")
    last = changes.groupBy(*KEY).agg(F.max_by(field, F.struct("ord", field)).alias("new_value"))
    patched = current.join(last, KEY, "left")
    changed = F.col("new_value").isNotNull()
    return patched.withColumn(
        "updated_at", F.when(changed, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    ).withColumn(field, F.coalesce("new_value", field)).drop("new_value")


def lookup(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Catalogue rows of the wanted (merchant, variant) pairs, each once."""
    return catalog.join(wanted.select(*KEY).distinct(), KEY, "left_semi")
