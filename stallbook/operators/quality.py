"""Invariants as violation rows: an empty result means the tables agree with the rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import SESSION_STATES
from ..functions.flags import needs_review


def _violations(df: DataFrame, table: str, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule. A rule that evaluates to NULL is not broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    )
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return df.select(F.lit(table).alias("table"), name.alias("key"), F.explode(broken).alias("rule"))


def check_jobs(jobs: DataFrame, batches: DataFrame) -> DataFrame:
    status = F.col("status")
    on_batches = _violations(
        batches, "batch", ["job_id", "batch_index"],
        {
            "done_has_completed_at": (status != "done") | F.col("completed_at").isNotNull(),
            "only_failed_has_reason": (status == "failed") | F.col("reason_code").isNull(),
            "running_has_claimed_at": (status != "running") | F.col("claimed_at").isNotNull(),
            "batch_status_known": status.isin("pending", "running", "done", "failed"),
        },
    )
    on_jobs = _violations(
        jobs, "job", ["job_id"],
        {
            "job_only_failed_has_reason": (status == "failed") | F.col("reason_code").isNull(),
            "job_status_known": status.isin("pending", "running", "complete", "failed"),
        },
    )
    return on_batches.unionByName(on_jobs)


def check_variants(variants: DataFrame) -> DataFrame:
    count, stock = F.col("inventory_count"), F.col("availability")
    return _violations(
        variants, "variant", ["variant_id"],
        {
            "counted_is_in_stock": ~(count > 0) | (stock == "in_stock"),
            "zero_is_out_of_stock": ~(count == 0) | (stock == "out_of_stock"),
            "unknown_has_no_count": (stock != "unknown") | count.isNull(),
            "review_follows_flags": F.col("needs_review") == needs_review("flags"),
            "unpriced_is_flagged": (F.col("price_minor") > 0)
            | F.array_contains("flags", "MISSING_REQUIRED_FIELD")
            | F.array_contains("flags", "PRICE_AMBIGUOUS")
            | F.array_contains("flags", "PRICE_OUT_OF_BAND"),
        },
    )


def check_catalog(catalog: DataFrame, sessions: DataFrame) -> DataFrame:
    currency = F.col("currency").rlike(r"^[A-Z]{3}\z")
    return _violations(
        catalog, "catalog", ["merchant_id", "variant_id"],
        {
            "price_not_negative": F.col("price_minor") >= 0,
            "currency_code": currency,
            "availability_known": F.col("availability").isin("in_stock", "out_of_stock", "unknown"),
        },
    ).unionByName(
        _violations(
            sessions, "session", ["session_id"],
            {"status_known": F.col("status").isin(*SESSION_STATES), "currency_code": currency},
        )
    )


def check_keys(jobs: DataFrame, batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Repeated keys, and batches or rows whose parent is missing."""

    def repeated(df: DataFrame, table: str, key: list[str]) -> DataFrame:
        twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
        return twice.select(F.lit(table).alias("table"), name.alias("key"), F.lit("key_repeated").alias("rule"))

    def orphans(child: DataFrame, parent: DataFrame, table: str, key: list[str], on: list[str]) -> DataFrame:
        lost = child.join(parent.select(*on), on, "left_anti")
        name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
        return lost.select(F.lit(table).alias("table"), name.alias("key"), F.lit("parent_missing").alias("rule"))

    batch_key, row_key = ["job_id", "batch_index"], ["job_id", "source_row"]
    parts = [
        repeated(jobs, "job", ["job_id"]),
        repeated(batches, "batch", batch_key),
        repeated(rows, "row", row_key),
        orphans(batches, jobs, "batch", batch_key, ["job_id"]),
        orphans(rows, batches, "row", row_key, batch_key),
    ]
    return reduce(DataFrame.unionByName, parts)
