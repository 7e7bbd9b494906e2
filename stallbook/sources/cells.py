"""Reading sheets as one long table of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import as_text
from ..session import written

CELL_SCHEMA = "file string, sheet string, row int, col int, text string, master_row int"


def cells_from_arrays(rows: DataFrame, values: str = "values") -> DataFrame:
    """Rows with an array of values -> one record per cell; columns count from 1."""
    return rows.select(
        "file", "sheet", "row", F.posexplode(values).alias("at", "value")
    ).select(
        "file", "sheet", F.col("row").cast("int"), (F.col("at") + 1).alias("col"),
        as_text("value").alias("text"), F.col("row").cast("int").alias("master_row"),
    )


def csv_records(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(file, chunk, line, record): the records of CSV files whose quoted cells may hold line breaks.

    Files are read in pieces by many tasks, line by line. A line starts inside a quoted cell if the number of quotes
    before it in its file is odd: the quotes before it in its piece, counted in order, and the parity of all earlier
    pieces, a prefix sum over the pieces of a file. Lines that start outside are where records start; the others go to the record
    that starts last before them, in their piece or an earlier one. Inside a cell quotes are doubled, and a cell that has
    a quote is quoted. A quote that is never closed makes the rest of its file one record, as in any reader.
    `max_bytes`: the size of a piece, else the session's.
    """
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    if max_bytes:
        spark.conf.set(setting, str(max_bytes))
    try:
        lines = spark.read.option("lineSep", "\n").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"),
            F.monotonically_increasing_id().alias("at"), "value",
        )
        # The pieces are cut while the plan is made, so the plan is made here; and both reads below need the same places.
        lines = written(lines, "csv-lines")
    finally:
        if max_bytes:
            spark.conf.set(setting, before)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    piece = ["file", "chunk"]
    in_order = Window.partitionBy(*piece).orderBy("at")
    counted = lines.withColumn("quotes", quotes.cast("bigint"))
    totals = counted.groupBy(*piece).agg(F.sum("quotes").alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    opened = totals.select(*piece, F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("opened"))
    so_far = F.coalesce(F.sum("quotes").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("before", so_far).join(opened, piece)
    starts = (F.col("opened") + F.col("before")) % 2 == 0
    placed = placed.withColumn("start", F.max(F.when(starts, F.col("at"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    # A piece may begin, or lie as a whole, inside a record of an earlier one.
    last = placed.groupBy(*piece).agg(F.max("start").alias("last"))
    carried = last.select(
        *piece, F.last(F.when(F.col("last").isNotNull(), F.struct(F.col("chunk").alias("from_chunk"), F.col("last").alias("from_at"))), ignorenulls=True)
        .over(earlier).alias("carried")
    )
    owned = placed.join(carried, piece).select(
        "file", "at", F.col("chunk").alias("own_chunk"), "value",
        F.when(F.col("start").isNotNull(), F.col("chunk")).otherwise(F.col("carried.from_chunk")).alias("chunk"),
        F.coalesce("start", "carried.from_at").alias("line"),
    )
    whole = F.array_sort(F.collect_list(F.struct("own_chunk", "at", "value")))
    return owned.groupBy("file", "chunk", "line").agg(
        F.regexp_replace(F.array_join(F.transform(whole, lambda x: x["value"]), "\n"), "\r$", "").alias("record")
    )


def _csv_with_breaks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with a header each, under the cell schema."""
    records = csv_records(spark, path)
    first = records.groupBy("file").agg(F.min(F.struct("chunk", "line")).alias("header"))
    body = records.where("record <> ''").join(first, "file").where(F.struct("chunk", "line") > F.col("header"))
    return body.select(F.from_csv("record", CELL_SCHEMA, {"escape": '"'}).alias("cell"), F.col("file").alias("path")).select("cell.*", "path")


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet", line_breaks: bool = False) -> DataFrame:
    """Cell tables in parquet, csv or json; what names no file takes that of its own path.

    line_breaks: CSV cells may hold line breaks; files are still read by many tasks.
    """
    if fmt == "csv" and line_breaks:
        df = _csv_with_breaks(spark, path)
    else:
        reader = spark.read.schema(CELL_SCHEMA)
        if fmt == "csv":
            # Surrounding whitespace is trimmed below, by one rule for all formats.
            reader = reader.options(header="true", escape='"')
        df = reader.format(fmt).load(path).withColumn("path", F.col("_metadata.file_path"))
    return df.select(
        F.coalesce("file", "path").alias("file"), "sheet", "row", "col",
        as_text("text").alias("text"), F.coalesce("master_row", "row").alias("master_row"),
    )
