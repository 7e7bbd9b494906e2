import csv
import io
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from stallbook.functions import text
from stallbook.sources import tables
from stallbook.sources.cells import cells_from_arrays, csv_records, read_cells


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


# ---- cells ------------------------------------------------------------------------------------------------------

def test_cells_from_arrays(spark):
    df = spark.createDataFrame([("f", "s", 2, [" a ", None, ""]), ("f", "s", 3, []), ("f", "s", 4, None)], "file string, sheet string, row long, values array<string>")
    got = [tuple(r) for r in cells_from_arrays(df).orderBy("row", "col").collect()]
    assert got == [("f", "s", 2, 1, "a", 2), ("f", "s", 2, 2, "", 2), ("f", "s", 2, 3, "", 2)] or got == [("f", "s", 2, 1, "a", 2), ("f", "s", 2, 2, None, 2), ("f", "s", 2, 3, "", 2)]


@pytest.mark.parametrize("piece", [40, 333, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_breaks_in_pieces(spark, piece, end):
    """Pieces of any size, also inside a cell, give the records that a reader of the whole file gives."""
    random.seed(piece)
    parts = ["a", "b c", '"', ",", "\n", "\n\n", '""', "é", "long " * 9, ""]
    path, expected = folder(), []
    for name in ("one", "two"):
        rows = [(f"{name}.xls", "s", str(r), "1", "x" + "".join(random.choices(parts, k=random.randint(0, 7))) + "x", "") for r in range(1, 60)]
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerows([("file", "sheet", "row", "col", "text", "master_row"), *rows])
        with open(f"{path}/{name}.csv", "w", newline="") as f:
            f.write(out.getvalue())
        expected += [(r[0], int(r[2]), r[4]) for r in rows]
    records = csv_records(spark, path, piece)
    assert records.count() == len(expected) + 2
    if piece < 1000:
        assert records.select("file", "chunk").distinct().count() > 10
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(piece))
    try:
        got = sorted((r.file, r.row, r.text) for r in read_cells(spark, path, "csv", line_breaks=True).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(expected)


def test_csv_of_no_rows(spark):
    path = folder()
    with open(f"{path}/a.csv", "w") as f:
        f.write("file,sheet,row,col,text,master_row\n\n")
    assert read_cells(spark, path, "csv", line_breaks=True).count() == 0


# ---- feeds ------------------------------------------------------------------------------------------------------

def feed_rows(spark, price, feeds=("feed_a", "feed_b")):
    product = f"""struct('p' as id, 't' as title, struct('d' as plain) as description, array() as media,
      array(struct('v' as id, 't' as title, struct('d' as plain) as description, struct({price}L as amount, 'INR' as currency) as price)) as variants)"""
    lines = spark.createDataFrame([(f, 1) for f in feeds], "feed_id string, first_row int").select("feed_id", "first_row", F.expr(product).alias("product"))
    metadata = spark.createDataFrame([(f, "IN", str(price)) for f in feeds], "id string, target_country string, updated_at string")
    return lines, metadata


def on_sale(spark, path, feed=None):
    lines, metadata = tables.read_feed(spark, path, feed)
    prices = {r.feed_id: r["product"]["variants"][0]["price"]["amount"] for r in lines.collect()}
    return prices, {r.feed_id: int(r.updated_at) for r in metadata.collect()}


@pytest.mark.parametrize("stop", ["metadata", "manifest", "pointer"])
def test_a_publish_that_stops_halfway_changes_nothing(spark, monkeypatch, stop):
    path = folder()
    assert on_sale(spark, path) == ({}, {}) and on_sale(spark, path, "feed_a") == ({}, {})
    tables.write_feed(*feed_rows(spark, 1), path)
    lines, metadata = feed_rows(spark, 2)

    class Stopped(Exception):
        pass

    def fails(*_):
        raise Stopped

    if stop == "metadata":  # the products are written, the metadata are not
        metadata = metadata.withColumn("id", F.when(F.raise_error(F.lit("stopped")).isNull(), F.col("id")))
    elif stop == "manifest":
        monkeypatch.setattr(tables, "_stored", fails)
    else:
        monkeypatch.setattr(tables, "put_in_force", fails)
    with pytest.raises(Exception):  # noqa: B017
        tables.write_feed(lines, metadata, path)
    monkeypatch.undo()
    before = {"feed_a": 1, "feed_b": 1}
    assert on_sale(spark, path) == (before, before)
    tables.write_feed(*feed_rows(spark, 3, ("feed_b",)), path)
    after = {"feed_a": 1, "feed_b": 3}
    assert on_sale(spark, path) == (after, after) and on_sale(spark, path, "feed_b") == ({"feed_b": 3}, {"feed_b": 3})


def test_a_reader_keeps_its_version(spark):
    path = folder()
    tables.write_feed(*feed_rows(spark, 1), path)
    lines, metadata = tables.read_feed(spark, path)
    tables.write_feed(*feed_rows(spark, 2), path)
    assert {r["product"]["variants"][0]["price"]["amount"] for r in lines.collect()} == {1} == {int(r.updated_at) for r in metadata.collect()}


def test_a_feed_without_lines_is_emptied(spark):
    path = folder()
    lines, metadata = feed_rows(spark, 1)
    tables.write_feed(lines, metadata, path)
    tables.write_feed(lines.where("feed_id = 'feed_a'"), metadata, path)
    assert on_sale(spark, path) == ({"feed_a": 1}, {"feed_a": 1, "feed_b": 1}) and on_sale(spark, path, "feed_b") == ({}, {"feed_b": 1})


# ---- ids --------------------------------------------------------------------------------------------------------

def test_id_shapes(spark):
    ids = ["job_0123456789abcdef", "job_0123456789ABCDEF", "job_0123456789abcde", "cs_0123456789abcdef01234567", "cs_0123456789abcdef0123456", "cs_0123456789abcdef01234567\n", "", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string").select(text.valid_job_id("id").alias("job"), text.valid_session_id("id").alias("session"))
    assert [(r.job, r.session) for r in df.collect()] == [(True, False)] + [(False, False)] * 2 + [(False, True)] + [(False, False)] * 4
