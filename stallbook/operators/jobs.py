"""Ingest jobs, their batches and rows: creation, work owed, results, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import job_id
from ..functions.fixed import CLAIM_TIMEOUT_MINUTES
from ..functions.options import semantic_cells
from ..functions.text import classify_failure
from .grid import chunk, find_field
from .normalize import assembled_variants, products

FINGERPRINT = ["provider", "model_requested", "model_served", "prompt_sha256"]


def create_jobs(
    rows: DataFrame, existing: DataFrame, now: Column, batch_size: int = 100
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, batches, job rows) for sheets not ingested before.

    `rows` has merchant_id, file, sheet, row, headers, cells. A job id hashes
    merchant, file and row count; ids that exist are left untouched.
    """
    sheet = ["merchant_id", "file", "sheet"]
    jobs = rows.groupBy(*sheet).agg(
        F.count(F.lit(1)).alias("rows_total"), F.min("headers").alias("headers")
    ).withColumn("job_id", job_id("merchant_id", F.concat_ws("/", "file", "sheet"), "rows_total"))
    fresh = jobs.join(existing.select("job_id").distinct(), "job_id", "left_anti")
    batched = chunk(rows.join(fresh.select(*sheet, "job_id"), sheet), ["job_id"], "row", batch_size)
    consumed = F.array_compact(F.array(*[find_field("headers", r) for r in ("price", "list_price", "stock")]))
    job_rows = batched.select(
        "job_id", F.col("row").alias("source_row"), "sheet", "batch_index",
        semantic_cells("cells", consumed).alias("semantic_cells"),
        F.col("cells").alias("raw_cells"),
    )
    # Batches follow from the count; the rows need not be read again for them.
    last = F.floor((F.col("rows_total") - 1) / batch_size).cast("int")
    batches = fresh.select("job_id", F.explode(F.sequence(F.lit(0), last)).alias("batch_index")).withColumn(
        "status", F.lit("pending")
    )
    return (
        fresh.select(
            "job_id", "merchant_id", F.col("file").alias("source_file"), F.col("sheet").alias("sheet_name"),
            "headers", F.lit("pending").alias("status"), "rows_total", F.lit(batch_size).alias("batch_size"),
            now.alias("created_at"), now.alias("updated_at"),
        ),
        batches,
        job_rows,
    )


def owed(batches: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Rows still to be read: of batches pending, failed, or claimed too long ago."""
    stale = (F.col("status") == "running") & (
        F.col("claimed_at") < now - F.expr(f"INTERVAL {CLAIM_TIMEOUT_MINUTES} MINUTES")
    )
    due = batches.where(F.col("status").isin("pending", "failed") | stale).select("job_id", "batch_index")
    return rows.where("reading IS NULL").join(due, ["job_id", "batch_index"])


def apply_results(
    jobs: DataFrame, batches: DataFrame, rows: DataFrame, readings: DataFrame, outcomes: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, batches, rows) after a run.

    `readings`: job_id, source_row, reading, ord (last one wins). `outcomes`: job_id,
    batch_index, ord, error (NULL: done) and the fingerprint columns. A job keeps the
    first fingerprint it was given.
    """
    last = readings.groupBy("job_id", "source_row").agg(F.max_by("reading", "ord").alias("new_reading"))
    new_rows = rows.join(last, ["job_id", "source_row"], "left").withColumn(
        "reading", F.coalesce("new_reading", "reading")
    ).drop("new_reading")

    error = F.col("error")
    tried = F.col("attempted")
    done = tried & error.isNull()
    result = outcomes.groupBy("job_id", "batch_index").agg(
        F.max_by("error", "ord").alias("error"), F.count(F.lit(1)).alias("n_tries")
    ).withColumn("attempted", F.lit(True))
    new_batches = batches.join(result, ["job_id", "batch_index"], "left").withColumns(
        {
            "status": F.when(done, "done").when(tried, "failed").otherwise(F.col("status")),
            "attempts": F.col("attempts") + F.coalesce("n_tries", F.lit(0)),
            "completed_at": F.when(done, now).otherwise(F.col("completed_at")),
            "reason_code": F.when(tried & error.isNotNull(), classify_failure(error)).when(
                done, F.lit(None).cast("string")
            ).otherwise(F.col("reason_code")),
            "reason_human": F.when(tried & error.isNotNull(), error).when(
                done, F.lit(None).cast("string")
            ).otherwise(F.col("reason_human")),
        }
    ).drop("error", "attempted", "n_tries")

    succeeded = outcomes.where("error IS NULL")
    first = succeeded.groupBy("job_id").agg(
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("batch_index", "ord"))).alias(f"new_{c}")
            for c in FINGERPRINT
        ]
    )
    new_jobs = jobs.join(first, "job_id", "left")
    for c in FINGERPRINT:
        new_jobs = new_jobs.withColumn(c, F.coalesce(c, f"new_{c}")).drop(f"new_{c}")
    return new_jobs, new_batches, new_rows


def progress(jobs: DataFrame, batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs with counts of their batches and rows; each child is counted by itself."""
    batch_counts = batches.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("batches_total"),
        F.count_if(F.col("status") == "done").alias("batches_done"),
        F.count_if(F.col("status") == "failed").alias("batches_failed"),
    )
    row_counts = rows.groupBy("job_id").agg(F.count("reading").alias("rows_extracted"))
    counts = ["batches_total", "batches_done", "batches_failed", "rows_extracted"]
    return jobs.join(batch_counts, "job_id", "left").join(row_counts, "job_id", "left").fillna(0, counts)


def failures(batches: DataFrame) -> DataFrame:
    return batches.where("status = 'failed'").select("job_id", "batch_index", "reason_code", "reason_human")


def job_status(progressed: DataFrame) -> DataFrame:
    """Status of a finished run, with the reason when batches failed."""
    failed = F.col("batches_failed") > 0
    text = F.format_string(
        "%d of %d batches failed; %d rows unread",
        "batches_failed", "batches_total", F.col("rows_total") - F.col("rows_extracted"),
    )
    return progressed.withColumns(
        {
            "status": F.when(failed, "failed").otherwise("complete"),
            "reason_code": F.when(failed, "INGEST_BATCHES_FAILED"),
            "reason_human": F.when(failed, text),
        }
    )


def assemble(jobs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, products) from the stored rows and readings; pure, so repeatable."""
    facts = jobs.select(
        "job_id", "merchant_id", F.col("source_file").alias("file"), F.col("sheet_name").alias("sheet"), "headers"
    )
    roled = rows.select(
        "job_id", F.col("source_row").alias("row"), F.col("raw_cells").alias("cells"), "reading"
    ).join(facts, "job_id")
    for role in ("price", "list_price", "stock", "pack_size"):
        roled = roled.withColumn(f"{role}_field", find_field("headers", role))
    # The reading is stored beside its row: nothing to join.
    made = assembled_variants(roled)
    return made, products(made)


def failed_rows(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows lost to failed batches, with the reason."""
    lost = batches.where("status = 'failed'").select("job_id", "batch_index", "reason_code", "reason_human")
    return rows.where("reading IS NULL").join(lost, ["job_id", "batch_index"]).select(
        "job_id", "source_row", "batch_index", "reason_code", "reason_human"
    )
