"""Registered queries over carts, mandates and the live catalogue, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import hmac_pads
from ..operators import alternatives as alt
from ..operators import cart, catalog, gate
from ..session import written
from ..sources.mandates import decode_mandates, encode_mandates
from .tables import table, with_tables

SIGNING_KEY = "a key for the registered queries"
NOW = "1998-06-01 12:00:00"

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, tables: tuple[str, ...] = ()):
    def add(build):
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = with_tables(check, *tables) if tables else check
        return build

    return add


def _mandates(spark: SparkSession, sf: str, deal: bool = True) -> DataFrame:
    text = F.col("categories_text")
    return table(spark, sf, "mandates", deal).withColumn(
        "categories",
        F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.split(text, "\\|")),
    ).drop("categories_text")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return cart.price_lines(table(spark, sf, "requested"), table(spark, sf, "catalog"))


def _carts(spark: SparkSession, sf: str, lines: DataFrame, categories: bool = False) -> DataFrame:
    return cart.cart_status(cart.cart_totals(table(spark, sf, "sessions"), lines, categories))


def _consumption(spark: SparkSession, sf: str) -> DataFrame:
    return gate.consume(table(spark, sf, "spends")).where("first_spend").select("mandate_id", "session_id")


def _facts(spark: SparkSession, sf: str, carts: DataFrame) -> DataFrame:
    """Carts beside their mandates. Mandates are marked before they meet their carts: only they are dealt by mandate."""
    marked = gate.consumed_by_other(_mandates(spark, sf, deal=False), _consumption(spark, sf))
    return carts.join(marked, "session_id", "left").withColumn("consumed", F.coalesce("consumed", F.lit(False)))


def _gated(spark: SparkSession, sf: str, carts: DataFrame) -> DataFrame:
    return gate.evaluate(_facts(spark, sf, carts), F.col("now"))


def _kept_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The priced lines, written out, for plans that read them again."""
    return written(_lines(spark, sf).select(
        "session_id", "merchant_id", "item_id", "title", "category", "item_currency", "pos", "error", "amount_minor",
        "quoted_minor", "price_minor",
    ), "lines")


def _verdicts(spark: SparkSession, sf: str, keep_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(verdicts, priced lines); with `keep_lines` the lines are written out, for plans that read them again."""
    lines = _kept_lines(spark, sf) if keep_lines else _lines(spark, sf)
    return _gated(spark, sf, gate.cart_facts(_carts(spark, sf, lines, categories=True), lines)), lines


def _offers(spark: SparkSession, sf: str, verdicts: DataFrame, lines: DataFrame) -> DataFrame:
    """Alternatives of the refusals they can answer.

    The refusals and their cart lines are read in several places of the plan, hence
    written out once instead of pricing all carts again for each.
    """
    refused = gate.answerable(verdicts).where("item_count > 0").select(
        "session_id", "merchant_id", "max_value", "categories", "cart_categories"
    )
    refused = written(refused, "refused")
    in_carts = lines.where("error IS NULL").select("session_id", "item_id", "category", "error").join(
        refused.select("session_id"), "session_id", "left_semi"
    )
    return alt.alternatives(refused, written(in_carts, "refused-lines"), table(spark, sf, "catalog"))


# --- check SQL shared by several queries -------------------------------------------
LINES_SQL = """
lines AS (SELECT r.session_id, r.merchant_id, r.item_id, r.quantity, r.pos, r.quoted_minor, c.title, c.price_minor, c.category,
  CASE WHEN c.variant_id IS NULL THEN 'unknown_item' WHEN c.availability = 'out_of_stock' THEN 'out_of_stock'
    WHEN r.quantity < 1 OR r.quantity > 99 THEN 'bad_quantity' END AS error
  FROM requested r LEFT JOIN catalog c ON r.merchant_id = c.merchant_id AND r.item_id = c.variant_id),
sums AS (SELECT session_id, count(*) FILTER (WHERE error IS NULL) AS n_lines, count(*) FILTER (WHERE error IS NOT NULL) AS n_errors,
  coalesce(sum(price_minor * quantity) FILTER (WHERE error IS NULL), 0)::BIGINT AS subtotal_minor FROM lines GROUP BY 1),
based AS (SELECT s.session_id, s.merchant_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_errors, 0) AS n_errors,
  coalesce(subtotal_minor, 0) AS subtotal_minor FROM sessions s LEFT JOIN sums USING (session_id)),
fees AS (SELECT *, (CASE WHEN n_lines = 0 OR subtotal_minor >= 100000 THEN 0 ELSE 5000 END)::BIGINT AS delivery_minor FROM based),
taxed AS (SELECT *, ((subtotal_minor + delivery_minor) * 500 + 5000) // 10000 AS tax_minor FROM fees),
carts AS (SELECT *, subtotal_minor + delivery_minor + tax_minor AS total_minor,
  n_lines > 0 AND n_errors = 0 AS payable,
  CASE WHEN n_lines > 0 AND n_errors = 0 THEN 'ready_for_payment' ELSE 'not_ready_for_payment' END AS cart_status FROM taxed)"""
GATE_SQL = LINES_SQL + """,
cats AS (SELECT session_id, list_sort(list(DISTINCT category)) AS cart_categories FROM lines WHERE error IS NULL GROUP BY 1),
consumption AS (SELECT mandate_id, arg_min(session_id, arrival) AS spent_by FROM spends GROUP BY 1),
facts AS (SELECT c.*, m.mandate_id, m.issued_at, m.expires_at, m.max_value, m.max_currency, m.max_items, m.single_use,
  m.signature_valid, m.now, coalesce(cats.cart_categories, []) AS cart_categories, m.categories_text,
  CASE WHEN m.categories_text = '' THEN [] WHEN m.categories_text IS NULL THEN NULL ELSE string_split(m.categories_text, '|') END AS categories,
  coalesce(k.spent_by <> c.session_id, false) AS consumed,
  try_cast(issued_at AS TIMESTAMP) AS starts, try_cast(expires_at AS TIMESTAMP) AS ends
  FROM carts c LEFT JOIN mandates m USING (session_id) LEFT JOIN cats USING (session_id)
  LEFT JOIN consumption k ON k.mandate_id = m.mandate_id),
peers AS (SELECT *, CASE WHEN mandate_id IS NULL THEN 'MANDATE_MISSING' WHEN NOT signature_valid THEN 'MANDATE_SIGNATURE_INVALID'
    WHEN starts IS NULL OR ends IS NULL THEN 'MANDATE_SIGNATURE_INVALID' WHEN max_currency <> 'INR' THEN 'MANDATE_CURRENCY_MISMATCH' END AS pre,
  CASE WHEN now < starts THEN 'MANDATE_NOT_YET_VALID' WHEN now >= ends THEN 'MANDATE_EXPIRED' END AS k1,
  CASE WHEN single_use AND consumed THEN 'MANDATE_ALREADY_CONSUMED' END AS k2,
  CASE WHEN total_minor > max_value THEN 'MANDATE_CEILING_EXCEEDED' END AS k3,
  CASE WHEN categories IS NOT NULL AND len(list_filter(cart_categories, lambda x: NOT list_contains(categories, x))) > 0
    THEN 'MANDATE_CATEGORY_NOT_PERMITTED' END AS k4,
  CASE WHEN n_lines > max_items THEN 'MANDATE_ITEM_COUNT_EXCEEDED' END AS k5 FROM facts),
verdicts AS (SELECT *, coalesce(pre, CASE WHEN pre IS NULL THEN coalesce(k1, k2, k3, k4, k5) END) AS reason_code FROM peers)"""
CART_TABLES = ("catalog", "requested", "sessions")
GATE_TABLES = (*CART_TABLES, "mandates", "spends")


@query(
    "refused_carts",
    "WITH " + GATE_SQL.strip() + """
SELECT coalesce(reason_code, 'ALLOWED') AS reason_code, count(*) AS carts, sum(total_minor)::BIGINT AS total_minor
FROM verdicts GROUP BY 1""",
    GATE_TABLES,
)
def refused_carts(spark, sf):
    verdicts, _ = _verdicts(spark, sf)
    return verdicts.groupBy(F.coalesce("reason_code", F.lit("ALLOWED")).alias("reason_code")).agg(
        F.count(F.lit(1)).alias("carts"), F.sum("total_minor").alias("total_minor")
    )


@query(
    "cart_aggregate_items",
    """
SELECT session_id, merchant_id, item_id, count(*) AS quantity, min(pos) AS pos,
  arg_max(CAST(unit_amount AS BIGINT), pos) FILTER (WHERE unit_amount = floor(unit_amount)) AS quoted_minor
FROM item_rows GROUP BY ALL""",
    ("item_rows",),
)
def cart_aggregate_items(spark, sf):
    return cart.aggregate_items(table(spark, sf, "item_rows"))


@query(
    "cart_price_lines",
    "WITH " + LINES_SQL.strip() + """
SELECT session_id, item_id, quantity, pos, error, CASE WHEN error IS NULL THEN price_minor * quantity END AS amount_minor,
  CASE error WHEN 'unknown_item' THEN item_id || ': not in the catalogue' WHEN 'out_of_stock' THEN title || ': sold out'
    WHEN 'bad_quantity' THEN item_id || ': 1 to 99 pieces can be ordered' END AS message,
  CASE WHEN error = 'out_of_stock' THEN error WHEN error IS NOT NULL THEN 'invalid' END AS error_code
FROM lines""",
    CART_TABLES,
)
def cart_price_lines(spark, sf):
    return _lines(spark, sf).select(
        "session_id", "item_id", "quantity", "pos", "error", "amount_minor", "message", "error_code"
    )


@query(
    "cart_line_totals",
    "WITH " + LINES_SQL.strip() + """
SELECT session_id, merchant_id, item_id, unnest(['items_base_amount', 'subtotal', 'total']) AS type, price_minor * quantity AS amount
FROM lines WHERE error IS NULL""",
    CART_TABLES,
)
def cart_line_totals(spark, sf):
    return cart.line_totals(_lines(spark, sf))


@query(
    "cart_totals",
    "WITH " + LINES_SQL.strip() + """
SELECT session_id, n_lines, n_errors, subtotal_minor, delivery_minor, tax_minor, total_minor, payable, cart_status FROM carts""",
    CART_TABLES,
)
def cart_totals(spark, sf):
    return _carts(spark, sf, _lines(spark, sf)).select(
        "session_id", "n_lines", "n_errors", "subtotal_minor", "delivery_minor", "tax_minor", "total_minor",
        "payable", "cart_status",
    )


@query(
    "cart_totals_long",
    "WITH " + LINES_SQL.strip() + """
SELECT session_id, merchant_id, t.type, t.display_text, t.amount FROM (SELECT session_id, merchant_id, unnest([
  {'type': 'items_base_amount', 'display_text': 'Items', 'amount': subtotal_minor},
  {'type': 'subtotal', 'display_text': 'Subtotal', 'amount': subtotal_minor},
  {'type': 'fulfillment', 'display_text': CASE WHEN delivery_minor = 0 THEN 'Delivery (free)' ELSE 'Delivery' END, 'amount': delivery_minor},
  {'type': 'tax', 'display_text': 'Tax (flat 5% stub)', 'amount': tax_minor},
  {'type': 'total', 'display_text': 'Total', 'amount': total_minor}]) AS t FROM carts)""",
    CART_TABLES,
)
def cart_totals_long(spark, sf):
    return cart.totals_long(_carts(spark, sf, _lines(spark, sf)))


@query(
    "cart_creation_events",
    "WITH " + LINES_SQL.strip() + """,
said AS (SELECT session_id, string_agg(CASE error WHEN 'unknown_item' THEN item_id || ': not in the catalogue'
  WHEN 'out_of_stock' THEN title || ': sold out' ELSE item_id || ': 1 to 99 pieces can be ordered' END, '; ' ORDER BY pos) AS m
  FROM lines WHERE error IS NOT NULL GROUP BY 1),
counted AS (SELECT session_id, count(*) AS n FROM requested GROUP BY 1)
SELECT c.session_id, c.merchant_id, 'agent' AS actor, 'session.create' AS action,
  CASE WHEN payable THEN 'allowed' ELSE 'refused' END AS outcome, cart_status AS session_status_at_event,
  CASE WHEN NOT payable THEN 'CART_NOT_PAYABLE' END AS reason_code,
  CASE WHEN NOT payable THEN coalesce(m, 'there is nothing in this cart to pay for') END AS reason_human,
  coalesce(n, 0) AS item_count
FROM carts c LEFT JOIN said USING (session_id) LEFT JOIN counted USING (session_id)""",
    CART_TABLES,
)
def cart_creation_events(spark, sf):
    lines = _lines(spark, sf)
    return cart.creation_events(_carts(spark, sf, lines), lines, table(spark, sf, "requested"))


@query(
    "cart_reprice",
    "WITH " + LINES_SQL.strip() + """
SELECT s.session_id, s.merchant_id,
  CASE WHEN s.status IN ('completed', 'canceled', 'expired', 'complete_in_progress') THEN s.status ELSE c.cart_status END AS status,
  CASE WHEN s.status IN ('completed', 'canceled', 'expired') THEN s.snapshot_total_minor ELSE c.total_minor END AS total_minor,
  s.status IN ('completed', 'canceled', 'expired') AS frozen
FROM sessions s JOIN carts c USING (session_id)""",
    CART_TABLES,
)
def cart_reprice(spark, sf):
    return cart.reprice(table(spark, sf, "sessions"), table(spark, sf, "requested"), table(spark, sf, "catalog"))


@query(
    "cart_expire_due",
    f"""
SELECT session_id, coalesce(status = 'complete_in_progress' AND link_expires_at + INTERVAL 120 SECOND <= TIMESTAMP '{NOW}', false) AS expired_now,
  CASE WHEN status = 'complete_in_progress' AND link_expires_at + INTERVAL 120 SECOND <= TIMESTAMP '{NOW}' THEN 'expired' ELSE status END AS status
FROM sessions""",
    ("sessions",),
)
def cart_expire_due(spark, sf):
    return cart.expire_due(table(spark, sf, "sessions"), F.lit(NOW).cast("timestamp")).select(
        "session_id", "expired_now", "status"
    )


def _plans(spark, sf, carts):
    facts = table(spark, sf, "sessions").select(
        "session_id", "status", "handler_id", "payment_link_id", "payment_link_url", "link_expires_at",
        "updated_at", "snapshot_total_minor",
    ).join(carts.select("session_id", "merchant_id", "payable", "total_minor"), "session_id")
    # Links of every second session were made for today's total.
    stated = F.when(F.col("total_minor") % 2 == 0, F.col("total_minor")).otherwise(F.col("snapshot_total_minor"))
    return cart.completion_plan(facts.withColumn("link_amount_minor", stated), F.col("updated_at").cast("timestamp"))


PLAN_SQL = """
plans AS (SELECT s.session_id, s.merchant_id, s.status, c.total_minor,
  CASE WHEN s.status IN ('completed', 'canceled', 'expired') THEN 'refuse' WHEN handler_id <> 'payment_link' THEN 'refuse'
    WHEN NOT payable THEN 'refuse' WHEN payment_link_id IS NULL THEN 'create' WHEN link_expires_at <= s.updated_at THEN 'expire'
    WHEN total_minor % 2 <> 0 AND total_minor <> snapshot_total_minor THEN 'refuse' ELSE 'reuse' END AS plan_action,
  CASE WHEN s.status = 'completed' THEN 'session_completed' WHEN s.status IN ('canceled', 'expired') THEN 'session_terminal'
    WHEN handler_id <> 'payment_link' THEN 'unsupported_payment_handler' WHEN NOT payable THEN 'session_not_ready_for_payment'
    WHEN payment_link_id IS NULL THEN NULL WHEN link_expires_at <= s.updated_at THEN 'session_expired'
    WHEN total_minor % 2 <> 0 AND total_minor <> snapshot_total_minor THEN 'price_changed' END AS plan_code
  FROM sessions s JOIN carts c USING (session_id))"""


@query(
    "cart_completion_plan",
    "WITH " + LINES_SQL.strip() + "," + PLAN_SQL + " SELECT session_id, status, plan_action, plan_code FROM plans",
    CART_TABLES,
)
def cart_completion_plan(spark, sf):
    return _plans(spark, sf, _carts(spark, sf, _lines(spark, sf))).select(
        "session_id", "status", "plan_action", "plan_code"
    )


DEADLINE_SQL = """
SELECT session_id, mandate_id, single_use, now, ends, now + INTERVAL 30 MINUTE AS ttl_end,
  CASE WHEN ends < now + INTERVAL 30 MINUTE THEN ends ELSE now + INTERVAL 30 MINUTE END AS link_deadline,
  CASE WHEN ends < now + INTERVAL 30 MINUTE THEN 'mandate' ELSE 'link_ttl' END AS deadline_source,
  coalesce(ends < now + INTERVAL 30 MINUTE AND ends < now + INTERVAL 15 MINUTE, false) AS too_soon
FROM (SELECT session_id, mandate_id, single_use, now, CASE WHEN mandate_id IS NULL THEN NULL
  ELSE now + to_minutes(CAST(max_value // 1000 % 60 AS INTEGER)) END AS ends FROM mandates)"""


def _deadlines(spark, sf):
    # A mandate that still runs for zero to 59 minutes, from its own ceiling.
    now = F.col("now").cast("timestamp")
    minutes = F.floor(F.col("max_value") / 1000) % 60
    ends = F.when(
        F.col("mandate_id").isNotNull(), F.timestamp_micros(F.unix_micros(now) + minutes * 60_000_000)
    )
    rows = table(spark, sf, "mandates").withColumn("now", now).withColumn("mandate_expires_at", ends)
    return cart.link_deadline(rows, F.col("now"))


@query(
    "cart_link_deadline",
    f"SELECT session_id, link_deadline, deadline_source, too_soon FROM ({DEADLINE_SQL})",
    ("mandates",),
)
def cart_link_deadline(spark, sf):
    return _deadlines(spark, sf).select("session_id", "link_deadline", "deadline_source", "too_soon")


@query(
    "cart_price_drift",
    "WITH " + LINES_SQL.strip() + """
SELECT session_id, merchant_id, item_id, title, quoted_minor, price_minor AS live_minor FROM lines
WHERE error IS NULL AND quoted_minor <> price_minor""",
    CART_TABLES,
)
def cart_price_drift(spark, sf):
    return cart.price_drift(_lines(spark, sf))


@query(
    "cart_mutation_decisions",
    """
SELECT session_id, merchant_id, status, 'update' AS operation, code IS NULL AS ok, code FROM (SELECT *, CASE WHEN status = 'complete_in_progress'
  THEN 'session_pending_payment' WHEN status IN ('completed', 'canceled', 'expired') THEN 'session_terminal' END AS code FROM sessions)
UNION ALL SELECT session_id, merchant_id, status, 'cancel', code IS NULL, code FROM (SELECT *, CASE WHEN status = 'completed'
  THEN 'session_completed' WHEN status = 'expired' THEN 'session_expired' END AS code FROM sessions)""",
    ("sessions",),
)
def cart_mutation_decisions(spark, sf):
    sessions = table(spark, sf, "sessions")
    return cart.mutation_decision(sessions, "update").unionByName(cart.mutation_decision(sessions, "cancel"))


@query(
    "cart_completion_events",
    "WITH " + GATE_SQL.strip() + "," + PLAN_SQL + f""",
due AS ({DEADLINE_SQL}),
passed AS (SELECT p.*, d.mandate_id, d.single_use, d.too_soon FROM plans p JOIN verdicts v USING (session_id) JOIN due d USING (session_id)
  WHERE v.reason_code IS NULL AND plan_action = 'create')
SELECT session_id, merchant_id, mandate_id, 'system' AS actor, 'payment.link.refused' AS action, 'refused' AS outcome,
  status AS session_status_at_event, 'MANDATE_EXPIRES_TOO_SOON' AS reason_code, total_minor AS amount_minor, 1 AS step FROM passed WHERE too_soon
UNION ALL SELECT session_id, merchant_id, mandate_id, 'system', 'payment.link.created', 'allowed', status, NULL, total_minor, 2 FROM passed WHERE NOT too_soon
UNION ALL SELECT session_id, merchant_id, mandate_id, 'system', 'mandate.consumed', 'observed', status, NULL, total_minor, 3
FROM passed WHERE NOT too_soon AND single_use""",
    GATE_TABLES,
)
def cart_completion_events(spark, sf):
    lines = _lines(spark, sf)
    # The gate and the plans read the same carts.
    carts = written(_carts(spark, sf, lines, categories=True).select(
        "session_id", "merchant_id", "n_lines", "currency", "cart_categories", "total_minor", "payable",
    ), "carts")
    verdicts = _gated(spark, sf, gate.cart_facts(carts, lines))
    plans = _plans(spark, sf, carts)
    due = _deadlines(spark, sf).select("session_id", "mandate_id", "single_use", "too_soon")
    joined = plans.join(verdicts.select("session_id", F.col("ok").alias("gate_ok")), "session_id").join(due, "session_id")
    return cart.completion_events(joined).drop("reason_human")


@query(
    "cart_arbitrate_requests",
    """
WITH owner AS (SELECT merchant_id, key, endpoint, min(arrival) AS first_arrival FROM requests GROUP BY ALL),
judged AS (SELECT r.*, o.arrival AS owner_arrival, o.body AS owner_body, o.finished_at AS owner_finished, o.response_status AS owner_status
  FROM requests r JOIN owner w USING (merchant_id, key, endpoint) JOIN requests o ON o.arrival = w.first_arrival),
decided AS (SELECT *, CASE WHEN arrival = owner_arrival THEN 'proceed' WHEN body <> owner_body THEN 'conflict'
  WHEN owner_finished IS NULL OR owner_finished > arrived_at THEN 'in_flight' ELSE 'replay' END AS decision FROM judged)
SELECT arrival, merchant_id, key, endpoint, sha256(body) AS request_sha256, decision,
  CASE WHEN decision = 'replay' THEN owner_status END AS replayed_status FROM decided""",
    ("requests",),
)
def cart_arbitrate_requests(spark, sf):
    return cart.arbitrate(table(spark, sf, "requests")).select(
        "arrival", "merchant_id", "key", "endpoint", "request_sha256", "decision", "replayed_status"
    )


@query(
    "gate_verdicts",
    "WITH " + GATE_SQL.strip() + """
SELECT session_id, reason_code, reason_code IS NULL AS ok, pre IS NULL AS peers_evaluated, '2026-08-24.1' AS gate_version,
  CASE reason_code WHEN 'MANDATE_MISSING' THEN 'approval_required' WHEN 'MANDATE_SIGNATURE_INVALID' THEN 'invalid'
    WHEN 'MANDATE_EXPIRED' THEN 'expired' WHEN 'MANDATE_NOT_YET_VALID' THEN 'invalid' WHEN 'MANDATE_ALREADY_CONSUMED' THEN 'conflict'
    WHEN 'MANDATE_CURRENCY_MISMATCH' THEN 'invalid' WHEN 'MANDATE_CEILING_EXCEEDED' THEN 'maximum_exceeded'
    WHEN 'MANDATE_CATEGORY_NOT_PERMITTED' THEN 'approval_required' WHEN 'MANDATE_ITEM_COUNT_EXCEEDED' THEN 'quantity_exceeded' END AS reply_code,
  CASE WHEN pre IS NULL THEN array_to_string(list_filter([CASE WHEN k1 IS NOT NULL THEN 'validity_window' END, CASE WHEN k2 IS NOT NULL THEN 'single_use' END,
    CASE WHEN k3 IS NOT NULL THEN 'ceiling' END, CASE WHEN k4 IS NOT NULL THEN 'category' END, CASE WHEN k5 IS NOT NULL THEN 'item_count' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS failed,
  CASE WHEN pre IS NULL THEN array_to_string(list_filter([CASE WHEN k1 IS NULL THEN 'validity_window' END, CASE WHEN k2 IS NULL THEN 'single_use' END,
    CASE WHEN k3 IS NULL THEN 'ceiling' END, CASE WHEN k4 IS NULL THEN 'category' END, CASE WHEN k5 IS NULL THEN 'item_count' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS passed,
  CASE reason_code WHEN 'MANDATE_MISSING' THEN 'charging needs a mandate, and none came with the request'
    WHEN 'MANDATE_SIGNATURE_INVALID' THEN CASE WHEN signature_valid THEN mandate_id || ': its start or end is no timestamp'
      ELSE mandate_id || ': wrong signature' END
    WHEN 'MANDATE_CURRENCY_MISMATCH' THEN mandate_id || ': allows ' || max_currency || ', asked for INR'
    WHEN 'MANDATE_NOT_YET_VALID' THEN mandate_id || ': starts on ' || issued_at
    WHEN 'MANDATE_EXPIRED' THEN mandate_id || ': over since ' || expires_at
    WHEN 'MANDATE_ALREADY_CONSUMED' THEN mandate_id || ': good for one purchase, which was made'
    WHEN 'MANDATE_CEILING_EXCEEDED' THEN mandate_id || ': allows up to ' || max_value || ', asked for ' || total_minor
    WHEN 'MANDATE_CATEGORY_NOT_PERMITTED' THEN mandate_id || ': allows ' || CASE WHEN len(categories) = 0 THEN 'no category' ELSE array_to_string(categories, ', ') END
      || ', asked for ' || list_filter(cart_categories, lambda x: NOT list_contains(categories, x))[1]
    WHEN 'MANDATE_ITEM_COUNT_EXCEEDED' THEN mandate_id || ': allows ' || max_items || ' lines, asked for ' || n_lines END AS reason_human
FROM verdicts""",
    GATE_TABLES,
)
def gate_verdicts(spark, sf):
    verdicts, _ = _verdicts(spark, sf)
    return verdicts.select(
        "session_id", "reason_code", "ok", "peers_evaluated", "gate_version", "reply_code", "reason_human",
        F.array_join("peers_failed", ",").alias("failed"), F.array_join("peers_passed", ",").alias("passed"),
    )


@query(
    "gate_preconditions",
    "WITH " + GATE_SQL.strip() + " SELECT session_id, pre AS precondition FROM verdicts",
    GATE_TABLES,
)
def gate_preconditions(spark, sf):
    lines = _lines(spark, sf)
    facts = gate.cart_facts(_carts(spark, sf, lines, categories=True), lines).join(_mandates(spark, sf), "session_id", "left")
    return gate.preconditions(facts).select("session_id", "precondition")


@query(
    "gate_peer_checks",
    "WITH " + GATE_SQL.strip() + """
SELECT session_id, k1 AS validity_window, k2 AS single_use_check, k3 AS ceiling, k4 AS category_check, k5 AS item_count_check FROM verdicts""",
    GATE_TABLES,
)
def gate_peer_checks(spark, sf):
    lines = _lines(spark, sf)
    facts = gate.cart_facts(_carts(spark, sf, lines, categories=True), lines).join(_mandates(spark, sf), "session_id", "left")
    marked = gate.consumed_by_other(facts, _consumption(spark, sf))
    return gate.peer_checks(marked, F.col("now")).select(
        "session_id", "validity_window", "single_use_check", "ceiling", "category_check", "item_count_check"
    )


@query(
    "gate_cart_facts",
    "WITH " + GATE_SQL.strip() + """
SELECT session_id, total_minor, 'INR' AS currency, n_lines AS item_count, array_to_string(cart_categories, ',') AS cart_categories FROM facts""",
    GATE_TABLES,
)
def gate_cart_facts(spark, sf):
    lines = _lines(spark, sf)
    return gate.cart_facts(_carts(spark, sf, lines, categories=True), lines).select(
        "session_id", "total_minor", "currency", "item_count",
        F.array_join("cart_categories", ",").alias("cart_categories"),
    )


@query(
    "gate_answerable",
    "WITH " + GATE_SQL.strip() + """
SELECT session_id, reason_code FROM verdicts WHERE reason_code IN ('MANDATE_CEILING_EXCEEDED', 'MANDATE_CATEGORY_NOT_PERMITTED', 'MANDATE_ITEM_COUNT_EXCEEDED')""",
    GATE_TABLES,
)
def gate_answerable(spark, sf):
    verdicts, _ = _verdicts(spark, sf)
    return gate.answerable(verdicts).select("session_id", "reason_code")


@query(
    "gate_consume",
    """
SELECT mandate_id, session_id, arrival, row_number() OVER (PARTITION BY mandate_id ORDER BY arrival) = 1 AS first_spend FROM spends""",
    ("spends",),
)
def gate_consume(spark, sf):
    return gate.consume(table(spark, sf, "spends"))


@query(
    "gate_consumed_by_other",
    """
WITH consumption AS (SELECT mandate_id, arg_min(session_id, arrival) AS spent_by FROM spends GROUP BY 1)
SELECT m.session_id, EXISTS (SELECT 1 FROM consumption c WHERE c.mandate_id = m.mandate_id AND c.spent_by <> m.session_id) AS consumed FROM mandates m""",
    ("mandates", "spends"),
)
def gate_consumed_by_other(spark, sf):
    return gate.consumed_by_other(table(spark, sf, "mandates"), _consumption(spark, sf)).select("session_id", "consumed")


ALTERNATIVES_SQL = """,
refusals AS (SELECT * FROM verdicts WHERE reason_code IN ('MANDATE_CEILING_EXCEEDED', 'MANDATE_CATEGORY_NOT_PERMITTED', 'MANDATE_ITEM_COUNT_EXCEEDED') AND n_lines > 0),
fitting AS (SELECT r.session_id, r.merchant_id, c.variant_id, c.title, c.price_minor, c.currency, c.category, list_contains(r.cart_categories, c.category) AS near,
    row_number() OVER (PARTITION BY r.session_id ORDER BY c.price_minor DESC, md5(c.variant_id)) AS place
  FROM refusals r JOIN catalog c ON c.merchant_id = r.merchant_id
  WHERE c.price_minor > 0 AND c.availability <> 'out_of_stock' AND (r.categories IS NULL OR list_contains(r.categories, c.category))
    AND c.price_minor + (CASE WHEN c.price_minor >= 100000 THEN 0 ELSE 5000 END)
      + ((c.price_minor + (CASE WHEN c.price_minor >= 100000 THEN 0 ELSE 5000 END)) * 500 + 5000) // 10000 <= r.max_value
    AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.session_id = r.session_id AND l.item_id = c.variant_id AND l.error IS NULL)),
offered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY near DESC, place) AS rank FROM fitting WHERE place <= 12)"""


@query(
    "gate_alternatives",
    "WITH " + GATE_SQL.strip() + ALTERNATIVES_SQL + """
SELECT session_id, merchant_id, CAST(rank AS INTEGER) AS rank, variant_id AS id, title, price_minor, currency, category FROM offered WHERE rank <= 3""",
    GATE_TABLES,
)
def gate_alternatives(spark, sf):
    verdicts, lines = _verdicts(spark, sf, keep_lines=True)
    return _offers(spark, sf, verdicts, lines)


@query(
    "gate_evidence",
    "WITH " + GATE_SQL.strip() + ALTERNATIVES_SQL + """,
drifts AS (SELECT session_id, count(*) AS n_drift, sum(price_minor - quoted_minor)::BIGINT AS drift_minor FROM lines
  WHERE error IS NULL AND quoted_minor <> price_minor GROUP BY 1),
named AS (SELECT session_id, string_agg(variant_id, ',' ORDER BY rank) AS ids FROM offered WHERE rank <= 3 GROUP BY 1)
SELECT v.session_id, v.total_minor AS cart_total_minor, CASE WHEN reason_code IS NOT NULL THEN max_value END AS ceiling_minor,
  CASE WHEN reason_code IS NOT NULL THEN coalesce(n_drift, 0) END AS n_drift,
  CASE WHEN reason_code IS NOT NULL THEN coalesce(drift_minor, 0) END AS drift_minor,
  CASE WHEN reason_code IS NOT NULL THEN coalesce(ids, '') END AS offered
FROM verdicts v LEFT JOIN drifts USING (session_id) LEFT JOIN named USING (session_id)""",
    GATE_TABLES,
)
def gate_evidence(spark, sf):
    lines = _kept_lines(spark, sf)
    facts = _facts(spark, sf, gate.cart_facts(_carts(spark, sf, lines, categories=True), lines))
    # Checks have one code each and are short; the verdicts spelled from them are not, so rows are dealt by session before that.
    checked = written(gate.peer_checks(gate.preconditions(facts), F.col("now")).drop(
        "n_errors", "subtotal_minor", "items_base_minor", "delivery_minor", "tax_minor", "payable", "cart_status", "intent_text", "now"
    ), "checked")
    offers = written(_offers(spark, sf, gate.verdict(checked), lines), "offers")
    records = gate.gate_evidence(gate.verdict(checked.repartition("session_id")), cart.price_drift(lines), offers)
    shape = (
        "cart_total_minor bigint, mandate_ceiling_minor bigint, drift array<struct<quoted_minor:bigint,live_minor:bigint>>, "
        "alternatives_offered array<struct<id:string>>"
    )
    read = records.select("session_id", F.from_json("evidence", shape).alias("e"))
    moved = F.aggregate(
        "e.drift", F.lit(0).cast("bigint"), lambda n, d: n + d["live_minor"] - d["quoted_minor"]
    )
    return read.select(
        "session_id", F.col("e.cart_total_minor").alias("cart_total_minor"),
        F.col("e.mandate_ceiling_minor").alias("ceiling_minor"),
        F.when(F.col("e.drift").isNotNull(), F.size("e.drift")).cast("bigint").alias("n_drift"),
        moved.alias("drift_minor"),
        F.array_join(F.transform("e.alternatives_offered", lambda a: a["id"]), ",").alias("offered"),
    )


def _mandate_text_sql(alias: str) -> str:
    cats = (
        f"CASE WHEN {alias}.categories_text IS NULL THEN '' WHEN {alias}.categories_text = '' THEN '\"categories\":[],' "
        f"ELSE '\"categories\":[\"' || replace({alias}.categories_text, '|', '\",\"') || '\"],' END"
    )
    return (
        f"'{{\"constraints\":{{' || {cats} || '\"max_amount\":{{\"currency\":\"' || {alias}.max_currency || '\",\"value\":' || {alias}.max_value"
        f" || '}}' || CASE WHEN {alias}.max_items IS NULL THEN '' ELSE ',\"max_items\":' || {alias}.max_items END"
        f" || ',\"single_use\":' || {alias}.single_use || '}},\"expires_at\":\"' || {alias}.expires_at || '\",\"intent_text\":\"' || {alias}.intent_text"
        f" || '\",\"issued_at\":\"' || {alias}.issued_at || '\",\"mandate_id\":\"' || {alias}.mandate_id || '\"}}'"
    )


def hmac_sql(text: str, key: str) -> str:
    def blob(pad: bytes) -> str:
        return "'" + "".join(f"\\x{b:02X}" for b in pad) + "'::BLOB"

    inner, outer = hmac_pads(key)
    return f"sha256({blob(outer)} || unhex(sha256({blob(inner)} || encode({text}))))"


@query(
    "gate_signatures",
    f"""
WITH signed AS (SELECT *, {hmac_sql(_mandate_text_sql('m'), SIGNING_KEY)} AS right_signature FROM mandates m WHERE mandate_id IS NOT NULL)
SELECT session_id, mandate_id, right_signature AS signature, signature_valid FROM signed""",
    ("mandates",),
)
def gate_signatures(spark, sf):
    """Signs every mandate, spoils some signatures, and verifies what comes back from its header."""
    mandates = _mandates(spark, sf).where("mandate_id IS NOT NULL").withColumn("max_items", F.col("max_items").cast("int"))
    signed = gate.sign_mandates(mandates, SIGNING_KEY).withColumn("right_signature", F.col("signature"))
    spoiled = signed.withColumn(
        "signature", F.when(F.col("signature_valid"), F.col("signature")).otherwise(F.reverse("signature"))
    )
    sent = encode_mandates(spoiled).select("session_id", "right_signature", "mandate_header")
    received = decode_mandates(sent, "mandate_header")
    return gate.verify_signatures(received, SIGNING_KEY).select(
        "session_id", "mandate_id", F.col("right_signature").alias("signature"), "signature_valid"
    )


ISSUE_SQL = """
SELECT mandate_key, CASE WHEN c_acctbal IS NULL OR amount <> floor(amount) OR amount <= 0 THEN '$.max_amount'
    WHEN categories_text = 'food|gadgets' THEN '$.categories' WHEN max_items < 1 OR max_items <> floor(max_items) THEN '$.max_items'
    WHEN ttl <= 0 OR ttl > 1440 THEN '$.ttl_minutes' END AS param, amount, categories_text, max_items, ttl, single
FROM (SELECT c_custkey AS mandate_key, c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal ELSE round(c_acctbal) END AS amount,
  CASE c_custkey % 5 WHEN 0 THEN 'food|gadgets' WHEN 1 THEN 'food|toys' WHEN 2 THEN '' ELSE NULL END AS categories_text,
  CASE c_custkey % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 2.5 WHEN 2 THEN 3.0 ELSE NULL END AS max_items,
  CASE c_custkey % 11 WHEN 0 THEN 0.0 WHEN 1 THEN 1441.0 WHEN 2 THEN 0.5 WHEN 3 THEN 1440.0 ELSE NULL END AS ttl,
  CASE c_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE NULL END AS single FROM {customer}) AS r"""


@query(
    "gate_issue_mandates",
    "WITH judged AS (" + ISSUE_SQL.replace("{customer}", "customer") + f""")
SELECT 'mnd_' || mandate_key AS mandate_id, param, CASE WHEN param IS NULL THEN CAST(amount AS BIGINT) END AS max_value,
  CASE WHEN param IS NULL THEN coalesce(single, true) END AS single_use, CASE WHEN param IS NULL THEN CAST(max_items AS INTEGER) END AS max_items,
  CASE WHEN param IS NULL THEN strftime(TIMESTAMP '{NOW}' + to_milliseconds(CAST(round(coalesce(ttl, 60) * 60000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS expires_at
FROM judged""",
)
def gate_issue_mandates(spark, sf):
    raw = spark.sql(ISSUE_SQL, customer=table(spark, sf, "customer"))
    text = F.col("categories_text")
    requests = raw.select(
        F.concat(F.lit("mnd_"), F.col("mandate_key").cast("string")).alias("mandate_id"),
        F.col("amount").cast("decimal(20,2)").alias("max_amount"),
        F.lit(None).cast("string").alias("currency"),
        F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.split(text, "\\|")).alias("categories"),
        F.col("max_items").cast("decimal(10,2)").alias("max_items"),
        F.col("ttl").cast("decimal(10,2)").alias("ttl_minutes"),
        F.col("single").alias("single_use"),
        F.lit(None).cast("string").alias("intent_text"),
    )
    issued, rejected = gate.issue_mandates(requests, F.lit(NOW).cast("timestamp"), SIGNING_KEY)
    return issued.select("mandate_id", F.lit(None).cast("string").alias("param"), "max_value", "single_use", "max_items", "expires_at").unionByName(
        rejected, allowMissingColumns=True
    )


CHANGES_SQL = """
SELECT 'mer_' || CAST(s_suppkey % 6 AS STRING) AS merchant_id, 'var_' || CAST(s_suppkey AS STRING) AS variant_id, s_name,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 1000 + s_suppkey END AS price_minor, CAST(copy AS BIGINT) AS copy
FROM (SELECT *, UNROLL(SEQ(1, 1 + s_suppkey % 2)) AS copy FROM {supplier}) AS s"""


def _changes(spark, sf):
    return spark.sql(CHANGES_SQL.replace("UNROLL(SEQ(", "explode(sequence("), supplier=table(spark, sf, "supplier"))


_CHANGES_CHECK = CHANGES_SQL.replace("UNROLL(SEQ(", "unnest(generate_series(").replace("{supplier}", "supplier")


@query(
    "catalog_upsert",
    f"""
WITH changes AS ({_CHANGES_CHECK}),
latest AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY merchant_id, variant_id ORDER BY copy DESC) = 1)
SELECT coalesce(l.merchant_id, c.merchant_id) AS merchant_id, coalesce(l.variant_id, c.variant_id) AS variant_id,
  CASE WHEN l.variant_id IS NULL THEN c.title ELSE l.s_name || ' ' || l.copy END AS title,
  CASE WHEN l.variant_id IS NULL THEN c.price_minor ELSE coalesce(l.price_minor, 0) END AS price_minor,
  CASE WHEN l.variant_id IS NULL THEN c.category ELSE 'toys' END AS category,
  CASE WHEN l.variant_id IS NULL THEN c.updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at
FROM catalog c FULL JOIN latest l ON c.merchant_id = l.merchant_id AND c.variant_id = l.variant_id""",
    ("catalog",),
)
def catalog_upsert(spark, sf):
    incoming = _changes(spark, sf).select(
        "merchant_id", "variant_id", F.lit("prod_new").alias("product_id"),
        F.concat("s_name", F.lit(" "), F.col("copy").cast("string")).alias("title"),
        F.coalesce("price_minor", F.lit(0)).cast("bigint").alias("price_minor"), F.lit("INR").alias("currency"),
        F.lit("in_stock").alias("availability"), F.lit("toys").alias("category"),
        F.lit(NOW).cast("timestamp").alias("updated_at"), F.col("copy").alias("ord"),
    )
    return catalog.upsert_catalog(table(spark, sf, "catalog"), incoming).select(
        "merchant_id", "variant_id", "title", "price_minor", "category", "updated_at"
    )


@query(
    "catalog_patch_price",
    f"""
WITH changes AS ({_CHANGES_CHECK})
SELECT c.merchant_id, c.variant_id, coalesce(k.price_minor, c.price_minor) AS price_minor,
  CASE WHEN k.price_minor IS NULL THEN c.updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at
FROM catalog c LEFT JOIN (SELECT merchant_id, variant_id, arg_max(price_minor + copy, copy) AS price_minor FROM changes GROUP BY ALL) k
  ON c.merchant_id = k.merchant_id AND c.variant_id = k.variant_id""",
    ("catalog",),
)
def catalog_patch_price(spark, sf):
    """Prices patched by changes of which several name one row."""
    changes = _changes(spark, sf).select(
        "merchant_id", "variant_id", (F.col("price_minor") + F.col("copy")).cast("bigint").alias("price_minor"), F.col("copy").alias("ord")
    )
    return catalog.patch_catalog(table(spark, sf, "catalog"), changes, "price_minor", NOW).select(
        "merchant_id", "variant_id", "price_minor", "updated_at"
    )


@query(
    "catalog_patch_availability",
    f"""
WITH changes AS ({_CHANGES_CHECK})
SELECT c.merchant_id, c.variant_id, CASE WHEN k.copy IS NULL THEN c.availability WHEN k.copy % 2 = 0 THEN 'out_of_stock' ELSE 'unknown' END AS availability
FROM catalog c LEFT JOIN (SELECT merchant_id, variant_id, max(copy) AS copy FROM changes GROUP BY ALL) k
  ON c.merchant_id = k.merchant_id AND c.variant_id = k.variant_id""",
    ("catalog",),
)
def catalog_patch_availability(spark, sf):
    """Availability patched by changes of which several name one row."""
    changes = _changes(spark, sf).select(
        "merchant_id", "variant_id", F.when(F.col("copy") % 2 == 0, "out_of_stock").otherwise("unknown").alias("availability"), F.col("copy").alias("ord")
    )
    return catalog.patch_catalog(table(spark, sf, "catalog"), changes, "availability", NOW).select("merchant_id", "variant_id", "availability")


@query(
    "catalog_publish_count",
    f"WITH changes AS ({_CHANGES_CHECK}) SELECT merchant_id, count(*) AS rows_written FROM changes GROUP BY 1",
    ("catalog",),
)
def catalog_publish_count(spark, sf):
    """Rows a publish writes; both copies of a variant published twice count."""
    return catalog.rows_written(_changes(spark, sf))


@query(
    "catalog_lookup",
    """
SELECT c.merchant_id, c.variant_id, c.title, c.price_minor, c.availability FROM catalog c
WHERE EXISTS (SELECT 1 FROM requested r WHERE r.merchant_id = c.merchant_id AND r.item_id = c.variant_id)""",
    ("catalog", "requested"),
)
def catalog_lookup(spark, sf):
    wanted = table(spark, sf, "requested").select("merchant_id", F.col("item_id").alias("variant_id"))
    return catalog.lookup(table(spark, sf, "catalog"), wanted).select(
        "merchant_id", "variant_id", "title", "price_minor", "availability"
    )
