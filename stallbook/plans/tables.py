"""The domain tables the registered queries run on, derived from the given tables.

Each is one SELECT in the SQL both Spark and DuckDB read; only unrolling of
arrays is spelled differently (UNROLL(SEQ(a, b))), and << >> stand for literal
braces. Spark runs it with the given tables as arguments,
the check queries use the same text as a WITH item, so that both sides start from
the same rows and differ in everything computed from them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, spread

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Texts of price, stock and pack cells; the last branch is the plain amount.
PRICE_TEXT = """CASE p_partkey % 17
  WHEN 0 THEN CAST(900 + p_partkey % 100 AS STRING)
  WHEN 1 THEN '2,' || CAST(100 + p_partkey % 900 AS STRING)
  WHEN 2 THEN '₹' || CAST(1000 + p_partkey % 700 AS STRING)
  WHEN 3 THEN '₹ 2,' || CAST(100 + p_partkey % 900 AS STRING)
  WHEN 4 THEN 'Rs. 1,' || CAST(100 + p_partkey % 900 AS STRING) || '/-'
  WHEN 5 THEN CAST(2000 + p_partkey % 500 AS STRING) || '/-'
  WHEN 6 THEN CAST(1 + p_partkey % 9 AS STRING) || '.8k'
  WHEN 7 THEN CAST(1000 + p_partkey % 99 AS STRING) || ' (MRP 3499)'
  WHEN 8 THEN '899.' || CAST(10 + p_partkey % 90 AS STRING)
  WHEN 9 THEN '500-' || CAST(600 + p_partkey % 200 AS STRING)
  WHEN 10 THEN 'Call for price'
  WHEN 11 THEN '₹ ' || CAST(100 + p_partkey % 100 AS STRING) || '/Kg'
  WHEN 12 THEN '0.50'
  WHEN 13 THEN '899.5' || CAST(10 + p_partkey % 90 AS STRING)
  WHEN 14 THEN '50,00,000 (List: 60,00,000)'
  WHEN 15 THEN ' INR ' || CAST(300 + p_partkey % 50 AS STRING) || ' per Pack '
  ELSE CAST(p_retailprice AS STRING) END"""
STOCK_TEXT = """CASE p_partkey % 15
  WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN '✓' WHEN 3 THEN '✗' WHEN 4 THEN 'Y'
  WHEN 5 THEN 'N' WHEN 6 THEN '' WHEN 7 THEN CAST(p_size AS STRING) || ' pcs'
  WHEN 8 THEN '0' WHEN 9 THEN CAST(p_size AS STRING) WHEN 10 THEN 'Out of  Stock'
  WHEN 11 THEN 'in stock' WHEN 12 THEN 'ask' WHEN 13 THEN 'not available' ELSE 'sold out' END"""
PACK_TEXT = """CASE p_partkey % 8
  WHEN 0 THEN '250g' WHEN 1 THEN '1 kg' WHEN 2 THEN '500 ml' WHEN 3 THEN '2 x 500 g'
  WHEN 4 THEN '1.5 Ltr' WHEN 5 THEN '' WHEN 6 THEN '1,000 gms' ELSE 'dozen' END"""
SIZE_TEXT = """CASE p_partkey % 7
  WHEN 0 THEN 'S/M/L' WHEN 1 THEN '1/2 kg' WHEN 2 THEN '5 kg / 10 kg' WHEN 3 THEN ''
  WHEN 4 THEN 'Free Size' WHEN 5 THEN '30 / 32 / 34' ELSE 'Half Sleeve/Full Sleeve' END"""
COLOUR_TEXT = """CASE p_partkey % 5
  WHEN 0 THEN 'Red, Blue, Black' WHEN 1 THEN 'Green' WHEN 2 THEN '' WHEN 3 THEN 'Red; Maroon' ELSE 'Blue|White' END"""
CATEGORY = """CASE p_type WHEN 'STANDARD' THEN 'home' WHEN 'ECONOMY' THEN 'kitchen' WHEN 'PROMO' THEN 'apparel'
  WHEN 'MEDIUM' THEN 'footwear' WHEN 'SMALL' THEN 'jewellery' ELSE 'unmapped' END"""

TABLES: dict[str, str] = {
    "catalog": f"""
SELECT 'mer_' || CAST(p_partkey % 5 AS STRING) AS merchant_id,
  'var_' || CAST(p_partkey AS STRING) AS variant_id,
  'prod_' || replace(p_brand, '#', '') AS product_id, p_name AS title,
  CAST(round(p_retailprice * 100) AS BIGINT) + (p_partkey % 7) * 5000 AS price_minor,
  'INR' AS currency,
  CASE WHEN p_partkey % 10 = 0 THEN 'out_of_stock' WHEN p_partkey % 10 < 3 THEN 'unknown'
    ELSE 'in_stock' END AS availability,
  {CATEGORY} AS category, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at
FROM {{part}}""",
    "sessions": """
SELECT 'cs_' || CAST(o_orderkey AS STRING) AS session_id,
  'mer_' || CAST(o_orderkey % 5 AS STRING) AS merchant_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'completed' WHEN 1 THEN 'expired' WHEN 2 THEN 'canceled'
    WHEN 3 THEN 'ready_for_payment' WHEN 4 THEN 'not_ready_for_payment'
    ELSE 'complete_in_progress' END AS status,
  'INR' AS currency, CAST(round(o_totalprice * 100) AS BIGINT) AS snapshot_total_minor,
  CAST(o_orderdate AS TIMESTAMP) AS updated_at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'plink_' || CAST(o_orderkey AS STRING) END AS payment_link_id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'https://pay.example/' || CAST(o_orderkey AS STRING) END AS payment_link_url,
  CAST(round(o_totalprice * 100) AS BIGINT) AS link_amount_minor,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) - INTERVAL '1' MINUTE
    WHEN 1 THEN CAST(o_orderdate AS TIMESTAMP) - INTERVAL '2' MINUTE
    WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY ELSE NULL END AS link_expires_at,
  CASE WHEN o_orderkey % 6 = 0 THEN 'other_handler' ELSE 'payment_link' END AS handler_id,
  CAST(NULL AS STRING) AS order_id
FROM {orders}""",
    # Every line counts as one to three units of an item of the session's merchant.
    "item_rows": """
SELECT 'cs_' || CAST(l_orderkey AS STRING) AS session_id,
  'mer_' || CAST(l_orderkey % 5 AS STRING) AS merchant_id,
  'var_' || CAST(l_partkey - l_partkey % 5 + l_orderkey % 5 AS STRING) AS item_id,
  (l_linenumber * CAST(100000000000 AS BIGINT) + l_partkey) * 10 + copy AS pos,
  CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 100.5
    ELSE CAST(90000 + l_linenumber * 100 + l_partkey % 10 AS DOUBLE) END AS unit_amount
FROM (SELECT *, UNROLL(SEQ(1, 1 + l_linenumber % 3)) AS copy FROM {lineitem}) AS l""",
    "requested": """
SELECT session_id, merchant_id, item_id, quantity,
  pos * CAST(100000000000 AS BIGINT) + item_no * 2 + gone AS pos,
  CASE WHEN pos % 3 = 0 THEN NULL ELSE 90000 + (item_no % 1000) * 10 + (item_no % 7) * 5000
    + CASE WHEN pos % 3 = 1 THEN 0 ELSE 500 END END AS quoted_minor
FROM (SELECT 'cs_' || CAST(l_orderkey AS STRING) AS session_id,
    'mer_' || CAST(l_orderkey % 5 AS STRING) AS merchant_id,
    CASE WHEN gone = 1 THEN 'gone_' ELSE 'var_' END || CAST(item_no AS STRING) AS item_id, item_no, gone,
    MAX(CASE WHEN l_quantity = 50 THEN CAST(100 AS BIGINT) WHEN l_quantity = 1 THEN CAST(0 AS BIGINT)
      ELSE CAST(l_quantity AS BIGINT) END) AS quantity, MIN(l_linenumber) AS pos
  FROM (SELECT *, l_partkey - l_partkey % 5 + l_orderkey % 5 AS item_no,
      CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END AS gone FROM {lineitem}) AS l
  GROUP BY l_orderkey, item_no, gone) AS r""",
    # Two sessions share a mandate. NULL categories allow all, '' none.
    "mandates": """
SELECT session_id, CASE WHEN mk % 11 = 0 THEN NULL ELSE 'mnd_' || CAST(mk AS STRING) END AS mandate_id,
  CASE WHEN mk % 43 = 0 THEN 'soon' ELSE CAST(DATE '1992-01-01' + CAST(mk % 2000 AS INT) AS STRING) || 'T00:00:00.000Z' END AS issued_at,
  CAST(DATE '1992-01-01' + CAST(mk % 2000 + (mk % 7 + 1) * 500 AS INT) AS STRING) || 'T00:00:00.000Z' AS expires_at,
  CASE mk % 3 WHEN 0 THEN 95000 + (mk * 37 % 60) * 1000 WHEN 1 THEN 1000000 + (mk % 50) * 100000
    ELSE CAST(20000000 AS BIGINT) END AS max_value,
  CASE WHEN mk % 29 = 0 THEN 'USD' ELSE 'INR' END AS max_currency,
  CASE mk % 6 WHEN 0 THEN NULL WHEN 1 THEN 'home|kitchen|apparel|footwear|jewellery'
    WHEN 2 THEN 'footwear|home' WHEN 3 THEN NULL WHEN 4 THEN 'home|kitchen|apparel|footwear|jewellery|unmapped'
    ELSE CASE WHEN mk % 4 = 1 THEN '' ELSE NULL END END AS categories_text,
  CASE mk % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE NULL END AS max_items,
  mk % 2 = 0 AS single_use, 'buy order ' || CAST(mk AS STRING) AS intent_text,
  mk % 13 <> 0 AS signature_valid, now
FROM (SELECT 'cs_' || CAST(o_orderkey AS STRING) AS session_id,
  (o_orderkey - o_orderkey % 2) / 2 AS mkd, CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS mk,
  CAST(o_orderdate AS TIMESTAMP) AS now FROM {orders}) AS o""",
    "spends": """
SELECT 'mnd_' || CAST(CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS STRING) AS mandate_id,
  'cs_' || CAST(o_orderkey AS STRING) AS session_id, CAST(1000000000000 AS BIGINT) - o_orderkey AS arrival
FROM {orders}""",
    "payments": """
SELECT 'evt_' || CAST(event_id AS STRING) AS event_id,
  event_id * 10 + CASE WHEN copy = 2 THEN 505 ELSE 1 END AS arrival,
  CAST(ts AS TIMESTAMP) AS received_at,
  CASE event_type WHEN 'purchase' THEN 'payment_link.paid' WHEN 'error' THEN 'payment_link.cancelled'
    WHEN 'signup' THEN 'payment_link.expired' ELSE 'payment_link.' || event_type END AS event,
  CASE WHEN user_id % 29 = 0 THEN 'cs_missing' ELSE 'cs_' || CAST(order_no AS STRING) END AS session_id,
  'plink_' || CAST(order_no AS STRING) AS link_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'order_X' || CAST(event_id AS STRING) END AS order_id_raw,
  'pay_' || CAST(event_id AS STRING) AS payment_id,
  CASE WHEN event_id % 5 = 0 THEN CAST(round(value * 100) AS BIGINT) WHEN event_id % 17 = 0 THEN NULL
    ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS amount_paid_minor,
  CASE WHEN event_id % 19 = 0 THEN 'USD' ELSE 'INR' END AS currency
FROM (SELECT *, user_id * 100 + (event_id % 4) * 25 AS order_no,
    UNROLL(SEQ(1, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END)) AS copy FROM {events}) AS e
LEFT JOIN {orders} AS o ON o.o_orderkey = e.order_no""",
    "raw_events": """
SELECT CASE WHEN number % 47 = 0 THEN '' ELSE event_id END AS event_id, arrival, received_at,
  CASE WHEN number % 37 = 0 THEN 'not json ' || event_id
    ELSE '<<"entity":"' || CASE WHEN number % 41 = 0 THEN 'order' ELSE 'event' END || '","event":"' || event
      || '","payload":<<"payment_link":<<"entity":<<"id":"' || link_id || '","reference_id":"' || session_id
      || '","notes":' || CASE number % 3 WHEN 0 THEN '[]' WHEN 1 THEN 'null' ELSE '<<"k":"v">>' END
      || ',"order_id":' || CASE WHEN order_id_raw IS NULL THEN 'null' ELSE '"' || order_id_raw || '"' END
      || ',"amount":' || CASE WHEN number % 23 = 0 THEN '"100"' ELSE '100' END
      || ',"amount_paid":' || CASE WHEN number % 31 = 0 THEN '10.5' WHEN amount_paid_minor IS NULL THEN 'null'
        ELSE CAST(amount_paid_minor AS STRING) END
      || ',"currency":"' || currency || '">>>>'
      || CASE WHEN number % 5 = 0 THEN '' ELSE ',"payment":<<"entity":<<"id":"' || payment_id || '">>>>' END || '>>>>' END AS body,
  number % 53 <> 0 AS signed
FROM (SELECT *, CAST(substr(event_id, 5) AS BIGINT) AS number FROM {payments}) AS p""",
    "audit": """
SELECT 'aud_' || CAST(event_id AS STRING) AS event_id, event_id * 3 + 1 AS seq, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_id % 33 = 0 THEN NULL ELSE 'cs_' || CAST(user_id * 100 + (event_id % 4) * 25 AS STRING) END AS session_id,
  CASE event_id % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'system' WHEN 2 THEN 'merchant' ELSE 'psp' END AS actor,
  event_type AS action,
  CASE event_type WHEN 'error' THEN 'refused' WHEN 'purchase' THEN 'allowed' WHEN 'signup' THEN 'error'
    ELSE 'observed' END AS outcome,
  CASE WHEN event_type = 'error' AND event_id % 7 <> 0 THEN 'MANDATE_CEILING_EXCEEDED'
    WHEN event_type = 'signup' THEN 'PROVIDER_ERROR' ELSE NULL END AS reason_code,
  CASE WHEN event_type = 'error' AND event_id % 11 = 0 THEN '' WHEN event_type = 'error' THEN 'too much'
    ELSE NULL END AS reason_human,
  '<<' || CASE WHEN event_id % 2 = 0 THEN '"cart_total_minor":' || CAST(event_id * 10 AS STRING) || ',' ELSE '' END
    || CASE WHEN event_id % 3 = 0 THEN '"mandate_ceiling_minor":' || CASE WHEN event_id % 9 = 0 THEN 'null'
      ELSE CAST(event_id AS STRING) END || ',' ELSE '' END
    || '"peers_failed":[' || CASE WHEN event_type = 'error' THEN '<<"check":"ceiling","reason_code":"MANDATE_CEILING_EXCEEDED">>' ELSE '' END
    || '],"peers_passed":[' || CASE WHEN event_type = 'view' THEN '' ELSE '"category","item_count"' END
    || '],"drift":[' || CASE WHEN event_id % 5 = 0 THEN '<<"id":"var_1","title":"cup","quoted_minor":100,"live_minor":' || CAST(event_id AS STRING) || '>>' ELSE '' END
    || ']' || CASE WHEN event_id % 6 = 0 THEN ',"alternatives_offered":[<<"id":"var_2","title":"tin","price_minor":' || CAST(user_id AS STRING) || '>>]' ELSE '' END
    || '>>' AS evidence
FROM {events}""",
    "requests": """
SELECT 'mer_' || CAST(user_id % 5 AS STRING) AS merchant_id, 'key_' || CAST(user_id AS STRING) || '_' || CAST(event_id % 20 AS STRING) AS key,
  CASE WHEN event_type = 'purchase' THEN 'complete' ELSE 'create' END AS endpoint,
  '<<"items":' || CAST(event_id % 3 AS STRING) || '>>' AS body, event_id AS arrival, CAST(ts AS TIMESTAMP) AS arrived_at,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL '1' DAY
    ELSE CAST(ts AS TIMESTAMP) + INTERVAL '1' SECOND END AS finished_at,
  CASE WHEN event_id % 4 = 0 THEN 409 ELSE 201 END AS response_status,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Basic abc' WHEN 2 THEN 'bearer   tok_' || CAST(user_id AS STRING)
    ELSE ' Bearer tok_' || CAST(user_id AS STRING) || ' ' END AS authorization
FROM {events}""",
    "credentials": """
SELECT 'tok_' || CAST(c_custkey AS STRING) AS token, 'agent_' || CAST(c_custkey AS STRING) AS agent_id,
  'mer_' || CAST(c_nationkey % 5 AS STRING) AS merchant_id,
  CASE WHEN c_custkey % 7 = 0 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) ELSE NULL END AS revoked_at
FROM {customer}""",
    "jobs": """
SELECT 'job_' || CAST(c_custkey AS STRING) AS job_id, 'mer_' || CAST(c_nationkey AS STRING) AS merchant_id,
  CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'complete' ELSE 'failed' END AS status,
  CASE WHEN c_custkey % 4 = 3 OR c_custkey % 50 = 0 THEN 'INGEST_BATCHES_FAILED' ELSE NULL END AS reason_code,
  CAST(100 AS BIGINT) + c_custkey % 50 AS rows_total,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'first' END AS provider
FROM {customer}""",
    "batches": """
SELECT 'job_' || CAST(o_custkey AS STRING) AS job_id, o_orderkey AS batch_index,
  CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS status,
  CAST(o_orderkey % 3 AS INT) AS attempts,
  CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 100 <> 1 THEN CAST(o_orderdate AS TIMESTAMP) ELSE NULL END AS claimed_at,
  CASE WHEN o_orderkey % 5 > 2 AND o_orderkey % 70 <> 3 THEN CAST(o_orderdate AS TIMESTAMP) ELSE NULL END AS completed_at,
  CASE WHEN o_orderkey % 5 = 2 OR o_orderkey % 90 = 4 THEN 'PROVIDER_ERROR' ELSE NULL END AS reason_code,
  CASE WHEN o_orderkey % 5 = 2 THEN 'call failed' ELSE NULL END AS reason_human
FROM {orders}""",
    "job_rows": """
SELECT 'job_' || CAST(o_custkey AS STRING) AS job_id, l_orderkey AS batch_index,
  l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS source_row,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'read ' || l_linestatus END AS reading
FROM {lineitem} AS l JOIN {orders} AS o ON l.l_orderkey = o.o_orderkey""",
    "outcomes": """
SELECT 'job_' || CAST(o_custkey AS STRING) AS job_id, o_orderkey AS batch_index, try_no AS ord,
  CASE o_orderkey % 9 WHEN 0 THEN 'HTTP 429 quota exceeded' WHEN 1 THEN 'extraction failed schema validation: x'
    WHEN 2 THEN 'output truncated at MAX_TOKENS' WHEN 3 THEN 'request was refused' WHEN 4 THEN 'socket hang up'
    ELSE NULL END AS error,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'prov_' || CAST(o_orderkey % 3 AS STRING) END AS provider,
  'model_' || CAST(o_orderkey % 2 AS STRING) AS model_requested, 'served_' || CAST(o_orderkey % 6 AS STRING) AS model_served,
  'sha' AS prompt_sha256
FROM (SELECT *, UNROLL(SEQ(1, 1 + o_orderkey % 2)) AS try_no FROM {orders}) AS o""",
    # Twenty parts make a sheet; one sheet in five has no header, one in four no stock column.
    "sheet_parts": f"""
SELECT p_partkey, sheet_no, 'mer_' || CAST(sheet_no % 7 AS STRING) AS merchant_id,
  'book_' || CAST(CAST((sheet_no - sheet_no % 3) / 3 AS BIGINT) AS STRING) AS file, 'sheet_' || CAST(sheet_no AS STRING) AS sheet,
  CAST(4 + p_partkey % 20 AS INT) AS "row", sheet_no % 5 <> 4 AS headed, sheet_no % 4 <> 3 AS stocked,
  CASE WHEN p_partkey % 9 = 0 THEN p_name || ' சேலை' WHEN p_partkey % 40 = 39 THEN ' Small  RING '
    WHEN p_partkey % 10 = 9 THEN 'small ring' ELSE p_name || ' no ' || CAST(p_partkey AS STRING) END AS item,
  p_type AS kind, {PRICE_TEXT} AS price_text,
  CASE WHEN p_partkey % 6 = 0 THEN '₹ ' || CAST(4000 + p_partkey % 100 AS STRING) ELSE '' END AS listed_text,
  {STOCK_TEXT} AS stock_text, {PACK_TEXT} AS pack_text, p_brand, p_size, p_name, p_type, p_retailprice
FROM (SELECT *, CAST((p_partkey - p_partkey % 20) / 20 AS BIGINT) AS sheet_no FROM {{part}}) AS p""",
    "sheet_cells": """
SELECT file, sheet, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col,
  CASE col WHEN 1 THEN item WHEN 2 THEN CASE WHEN sheet_no % 3 = 0 AND "row" > 4 THEN '' ELSE kind END
    WHEN 3 THEN price_text WHEN 4 THEN listed_text WHEN 5 THEN CASE WHEN stocked THEN stock_text ELSE pack_text END
    ELSE CASE WHEN stocked THEN pack_text ELSE '' END END AS text
FROM (SELECT *, UNROLL(SEQ(1, 6)) AS col FROM {sheet_parts}) AS d
UNION ALL
SELECT file, sheet, CAST(CASE line WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 22 + line END AS INT) AS "row", CAST(col AS INT) AS col,
  CASE line WHEN 1 THEN CASE WHEN col = 1 THEN 'Price list' ELSE '' END
    WHEN 2 THEN CASE WHEN NOT headed THEN '' ELSE CASE col WHEN 1 THEN 'Item' WHEN 2 THEN 'Type' WHEN 3 THEN ' Price '
      WHEN 4 THEN 'MRP' WHEN 5 THEN CASE WHEN stocked THEN 'Stock' ELSE 'Pack Size' END
      ELSE CASE WHEN stocked THEN 'Pack Size' ELSE '' END END END
    WHEN 3 THEN CASE col WHEN 1 THEN 'Grand Total' WHEN 3 THEN '12345' ELSE '' END
    WHEN 4 THEN CASE WHEN col = 2 THEN 'Note: rates subject to change' ELSE '' END
    ELSE CASE WHEN col = 1 THEN 'ring 98765 43210' ELSE '' END END AS text
FROM (SELECT *, UNROLL(SEQ(1, 6)) AS col
  FROM (SELECT file, sheet, headed, stocked, UNROLL(SEQ(1, 5)) AS line
    FROM (SELECT DISTINCT file, sheet, headed, stocked FROM {sheet_parts}) AS s) AS n) AS f""",
    "merges": """
SELECT DISTINCT file, sheet, 4 AS r1, 2 AS c1, 23 AS r2, 2 AS c2 FROM {sheet_parts} WHERE sheet_no % 3 = 0""",
    # The wire form of readings: pairs for options and attributes.
    "readings": f"""
SELECT file, sheet, "row" AS source_row, CAST(ord AS INT) AS ord,
  CASE WHEN p_partkey % 31 = 0 THEN '' ELSE p_name END AS title, p_partkey % 31 = 0 AS title_inferred,
  CASE WHEN p_partkey % 37 = 0 THEN 'gadgets' ELSE {CATEGORY} END AS category,
  CASE WHEN p_partkey % 8 = 0 THEN 0.5 ELSE 0.9 END AS category_confidence,
  {COLOUR_TEXT} AS colour, {SIZE_TEXT} AS size, CASE WHEN p_partkey % 4 = 0 THEN 'Cotton' ELSE '' END AS material,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand,
  CASE WHEN p_partkey % 5 = 0 THEN 'made by hand' ELSE NULL END AS description,
  CASE WHEN p_partkey % 6 < 2 THEN 'group ' || p_brand ELSE NULL END AS variant_group,
  CASE WHEN p_partkey % 29 = 0 THEN 0.4 ELSE 0.8 END AS confidence
FROM (SELECT *, UNROLL(SEQ(1, CASE WHEN p_partkey % 10 = 0 THEN 2 WHEN p_partkey % 23 = 0 THEN 0 ELSE 1 END)) AS ord
  FROM {{sheet_parts}}) AS r""",
}

# Lines of the documents, and the lines cut at commas: sheets full of prose and junk.
# (Spark text, check text)
SPLIT_TABLES: dict[str, tuple[str, str]] = {
    "doc_lines": (
        "SELECT doc_id, source, CAST(pos + 1 AS INT) AS line_no, line "
        "FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line",
        "SELECT doc_id, source, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, "
        "unnest(string_split(text, chr(10))) AS line FROM {documents}",
    ),
    "doc_cells": (
        "SELECT source AS file, 'doc_' || CAST(doc_id AS STRING) AS sheet, line_no AS `row`, CAST(pos + 1 AS INT) AS col, part AS text "
        "FROM {doc_lines} LATERAL VIEW posexplode(split(line, ',')) t AS pos, part",
        "SELECT source AS file, 'doc_' || CAST(doc_id AS STRING) AS sheet, line_no AS \"row\", "
        "CAST(generate_subscripts(string_split(line, ','), 1) AS INTEGER) AS col, unnest(string_split(line, ',')) AS text FROM {doc_lines}",
    ),
}


def _spark_text(sql: str) -> str:
    # An upper end below 1 means no row; sequence() would count downwards.
    sql = sql.replace("UNROLL(SEQ(1, CASE WHEN p_partkey % 10 = 0 THEN 2 WHEN p_partkey % 23 = 0 THEN 0 ELSE 1 END))",
                      "explode(CASE WHEN p_partkey % 10 = 0 THEN array(1, 2) WHEN p_partkey % 23 = 0 THEN array() ELSE array(1) END)")
    sql = sql.replace("UNROLL(SEQ(", "explode(sequence(").replace('"row"', "`row`")
    return sql.replace("<<", "{{").replace(">>", "}}")


def _check_text(name: str) -> str:
    if name in SPLIT_TABLES:
        return SPLIT_TABLES[name][1]
    return TABLES[name].replace("UNROLL(SEQ(", "unnest(generate_series(")


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    spread(spark, path)
    return spark.read.parquet(path)


#: Tables whose rows cost much to work on; a given table in few files would leave that to few tasks.
COSTLY = {"doc_lines", "mandates", "raw_events", "sheet_parts"}


def table(spark: SparkSession, folder: str, name: str, deal: bool = True) -> DataFrame:
    """A domain table (or a given one) as a DataFrame.

    The costly ones are rebalanced, by adaptive execution and by bytes, where their source has fewer files than there
    are cores; else the files' own splits are enough and nothing is shuffled. Without `deal` they are not: for rows
    that are dealt by a key at once.
    """
    configure(spark)
    if name in GIVEN:
        return given(spark, folder, name)
    sql = SPLIT_TABLES[name][0] if name in SPLIT_TABLES else _spark_text(TABLES[name])
    parts = {n: table(spark, folder, n) for n in _names(sql)}
    made = spark.sql(sql, **parts)
    if deal and name in COSTLY and len(made.inputFiles()) < spark.sparkContext.defaultParallelism:
        return made.hint("rebalance")
    return made


def with_tables(body: str, *names: str) -> str:
    """A check query: the needed domain tables as WITH items in front of `body`.

    `body` is either a SELECT or further WITH items ending in a SELECT.
    """
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in GIVEN or name in ordered:
            return
        for other in _names(_check_text(name)):
            need(other)
        ordered.append(name)

    for name in names:
        need(name)
    items = []
    for name in ordered:
        sql = _check_text(name)
        text = sql.format(**{n: n for n in _names(sql)}).replace("<<", "{").replace(">>", "}")
        items.append(f"{name} AS ({text})")
    body = body.strip()
    if body[:5].upper() == "WITH ":
        body = ", " + body[5:]
    return "WITH " + ",\n".join(items) + "\n" + body
