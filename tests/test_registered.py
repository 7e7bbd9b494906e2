"""Some registered queries against their check SQL, and what holds for all of them."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as registered
from stallbook.plans.tables import GIVEN
from tools.check import plain

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "refused_carts", "cart_aggregate_items", "cart_creation_events", "gate_verdicts", "gate_signatures", "cells_price", "cells_text",
    "grid_headers_of_prose", "readings_rejected", "norm_variants", "feed_products", "audit_session_list", "jobs_status", "events_folded",
    "eval_accuracy",
]


def test_every_query_has_a_check():
    """Queries of the text operators, where SQL cannot express one, are held against plain versions in their own tests."""
    named = {name for name in registered.queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert named <= set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_runs(spark):
    assert registered.entry(spark).columns == ["reason_code", "carts", "total_minor"]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_check(spark, name):
    con = duckdb.connect()
    for table in GIVEN:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = registered.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    result = con.execute(registered.oracle_sql()[name])
    names = [d[0] for d in result.description]
    theirs = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(names) == columns and ours == theirs


@pytest.mark.parametrize("name", ["cart_totals", "gate_verdicts", "grid_rows_of_prose", "events_folded"])
def test_plans_stay_in_the_jvm_and_spread_out(spark, name):
    plan = registered.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SinglePartition"):
        assert unwanted not in plan, unwanted
