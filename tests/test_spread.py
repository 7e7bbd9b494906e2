"""Shuffles that follow the size of the tables, and steps that run once."""

import time

from pyspark.sql import functions as F

import __spark_entry__ as registered
from stallbook import session
from stallbook.operators.alternatives import alternatives
from stallbook.plans.tables import given

SMALL = "/root/testdata/sf0.001"
START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_shuffles_start_from_more_partitions_for_a_larger_table(spark, tmp_path, monkeypatch):
    spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(session, "TABLE_BYTES", 4096)
    before = spark.conf.get(START, None)
    try:
        rows = given(spark, str(tmp_path), "orders")
        wanted = int(spark.conf.get(START))
        assert wanted >= 5000 * 32 // 4096 // 2 and rows.count() == 5000
        spark.range(10).write.parquet(f"{tmp_path}/part.parquet")
        given(spark, str(tmp_path), "part")
        assert int(spark.conf.get(START)) == wanted  # a smaller table takes nothing back
    finally:
        spark.conf.unset(START) if before is None else spark.conf.set(START, before)


def test_completion_events_price_the_carts_once(spark):
    events = registered.queries()["cart_completion_events"](spark, SMALL)
    assert not [f for f in events.inputFiles() if "lineitem" in f or "part.parquet" in f]


def test_alternatives_deal_what_was_found_by_session_once(spark):
    refused = spark.createDataFrame(
        [("s1", "m", 200_000, None, ["home"]), ("s2", "m", 200_000, ["home"], ["home"])],
        "session_id string, merchant_id string, max_value bigint, categories array<string>, cart_categories array<string>")
    stock = spark.createDataFrame(
        [("m", f"v{i}", f"t{i}", 1000 * i, "INR", "in_stock", "home" if i % 2 else "kitchen") for i in range(1, 21)] + [("m", None, "no id", 90_000, "INR", "in_stock", "home")],
        "merchant_id string, variant_id string, title string, price_minor bigint, currency string, availability string, category string")
    lines = spark.createDataFrame(
        [("s1", "v20", "kitchen", None), ("s1", "v20", "kitchen", None), ("s1", None, "home", None), ("s2", "v19", "home", None), (None, "v17", "home", None)],
        "session_id string, item_id string, category string, error string")
    got = alternatives(refused, lines, stock)
    # An id that is not known hides nothing, nor does a line of no session.
    assert sorted((r.session_id, r.rank, r.id) for r in got.collect()) == [
        ("s1", 1, None), ("s1", 2, "v19"), ("s1", 3, "v17"), ("s2", 1, None), ("s2", 2, "v17"), ("s2", 3, "v15")]
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def shuffled(spark):
    """Names of the shuffle files on the disks of a session on one machine."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_what_is_written_leaves_no_shuffle_files(spark):
    before, setting = shuffled(spark), spark.conf.get(CLEANUP, None)
    made = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()
    kept = session.written(made, "counts")
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP, None) == setting
    # The frame itself and what was kept can still be read.
    assert kept.count() == made.count() == 5000


def test_carts_are_not_dealt_by_mandate(spark):
    """Gate decisions: only mandates and spends are shuffled by mandate, carts by session alone."""
    plan = registered.queries()["gate_verdicts"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    top = next(i for i, line in enumerate(plan) if "Join LeftOuter, (mandate_id" in line)
    below = [line for i, line in enumerate(plan[top + 1:], top + 1) if all(d > depth[top] for d in depth[top + 1:i + 1])]
    assert below and not [line for line in below if "l_orderkey" in line] and [line for line in plan if "l_orderkey" in line]
    assert not [line for line in plan if "Rebalance" in line]  # they are dealt by key at once


def test_evidence_deals_checks_and_not_spelled_verdicts(spark):
    records = registered.queries()["gate_evidence"](spark, SMALL)
    plan = records._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(session_id" in line]
    below = [plan.splitlines()[i + 1] for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning(session_id" in line]
    assert dealt and not [line for line in below if "peers" in line]
    # Offers are read from where they were written; their own shuffles are gone by then.
    assert [f for f in records.inputFiles() if "/offers-" in f] and not [f for f in records.inputFiles() if "part.parquet" in f]
