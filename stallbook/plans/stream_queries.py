"""Registered queries over payment events and requests, as batch and as stream, with their checks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import hmac_sha256
from ..session import shared_folder, written
from ..sources.payments import parse_events
from ..streaming import payments, requests
from .tables import table, with_tables

SECRET = "the provider's secret"

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, tables: tuple[str, ...] = ()):
    def add(build):
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = with_tables(check, *tables) if tables else check
        return build

    return add


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events as received: signed, except for some with a wrong signature."""
    signature = hmac_sha256("body", SECRET)
    return table(spark, sf, "raw_events").withColumn(
        "signature", F.when(F.col("signed"), signature).otherwise(F.reverse(signature))
    ).drop("signed")


PARSED_SQL = """
numbered AS (SELECT r.*, CAST(substr(p.event_id, 5) AS BIGINT) AS n, p.event AS said_event, p.session_id AS said_session, p.link_id AS said_link,
  p.order_id_raw AS said_order, p.payment_id AS said_payment, p.amount_paid_minor AS said_paid, p.currency AS said_currency
  FROM raw_events r JOIN payments p ON p.arrival = r.arrival),
parsed AS (SELECT *, n % 37 <> 0 AS is_json, n % 37 <> 0 AND n % 41 <> 0 AS recognised,
  CASE WHEN n % 37 <> 0 THEN said_event END AS event, CASE WHEN n % 37 <> 0 THEN said_session END AS session_id, CASE WHEN n % 37 <> 0 THEN said_link END AS link_id,
  CASE WHEN n % 37 <> 0 THEN said_order END AS order_id_raw, CASE WHEN n % 37 <> 0 THEN replace(said_order, 'order_', '') END AS order_id,
  CASE WHEN n % 37 <> 0 AND n % 5 <> 0 THEN said_payment END AS payment_id, CASE WHEN n % 37 <> 0 AND n % 23 <> 0 THEN CAST(100 AS BIGINT) END AS amount_minor,
  CASE WHEN n % 37 <> 0 AND n % 31 <> 0 THEN said_paid END AS amount_paid_minor, CASE WHEN n % 37 <> 0 THEN said_currency END AS currency FROM numbered),
admitted AS (SELECT *, CASE WHEN NOT signed THEN 'invalid_signature' WHEN event_id = '' THEN 'missing_event_id' WHEN NOT is_json THEN 'invalid_json'
  WHEN NOT recognised THEN 'unrecognised_event_shape' END AS reject FROM parsed),
firsts AS (SELECT * FROM admitted WHERE reject IS NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival) = 1)"""
FOLD_SQL = PARSED_SQL + """,
faced AS (SELECT f.*, s.status AS initial_status, s.snapshot_total_minor AS total_minor, s.currency AS session_currency,
  CASE WHEN s.session_id IS NULL THEN NULL WHEN f.event = 'payment_link.paid' AND f.amount_paid_minor = s.snapshot_total_minor AND f.currency = s.currency THEN 'completed'
    WHEN f.event = 'payment_link.expired' THEN 'expired' WHEN f.event = 'payment_link.cancelled' THEN 'canceled' END AS target
  FROM firsts f LEFT JOIN sessions s USING (session_id)),
met AS (SELECT *, CASE WHEN initial_status IN ('completed', 'expired', 'canceled') THEN initial_status ELSE
  coalesce(first_value(target IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), initial_status) END AS status FROM faced),
decided AS (SELECT *, status IN ('completed', 'expired', 'canceled') AS terminal, CASE WHEN initial_status IS NULL THEN 'SESSION_UNKNOWN'
  WHEN event = 'payment_link.paid' THEN CASE WHEN status = 'completed' THEN 'ALREADY_COMPLETED' WHEN status IN ('expired', 'canceled') THEN 'LATE_AUTH_AFTER_TERMINAL'
    WHEN amount_paid_minor IS DISTINCT FROM total_minor THEN 'AMOUNT_MISMATCH' WHEN currency IS DISTINCT FROM session_currency THEN 'CURRENCY_MISMATCH' ELSE 'PAYMENT_CAPTURED' END
  WHEN event = 'payment_link.expired' THEN CASE WHEN status = 'completed' THEN 'EXPIRY_AFTER_COMPLETION' WHEN status IN ('expired', 'canceled') THEN 'ALREADY_TERMINAL' ELSE 'LINK_EXPIRED' END
  WHEN event = 'payment_link.cancelled' THEN CASE WHEN status = 'completed' THEN 'CANCEL_AFTER_COMPLETION' WHEN status IN ('expired', 'canceled') THEN 'ALREADY_TERMINAL' ELSE 'LINK_CANCELLED' END
  ELSE 'EVENT_NOT_ACTIONED' END AS reason_code FROM met),
folded AS (SELECT *, CASE WHEN reason_code IN ('PAYMENT_CAPTURED', 'LINK_EXPIRED', 'LINK_CANCELLED') THEN 'allowed' WHEN reason_code LIKE '%MISMATCH' THEN 'refused' ELSE 'observed' END AS outcome,
  CASE reason_code WHEN 'PAYMENT_CAPTURED' THEN 'completed' WHEN 'LINK_EXPIRED' THEN 'expired' WHEN 'LINK_CANCELLED' THEN 'canceled' END AS transition FROM decided)"""
EVENT_TABLES = ("raw_events", "payments")
FOLD_TABLES = ("raw_events", "payments", "sessions")
_FOLDED = ("event_id", "arrival", "session_id", "action", "outcome", "session_status_at_event", "transition", "reason_code", "order_id_raw")
_FOLDED_SQL = """
SELECT event_id, arrival, session_id, event AS action, outcome, status AS session_status_at_event, transition, reason_code, order_id_raw FROM folded"""


@query(
    "events_parsed",
    "WITH " + PARSED_SQL.strip() + """
SELECT arrival, is_json, recognised, event, session_id, link_id, order_id_raw, order_id, payment_id, amount_minor, amount_paid_minor, currency FROM parsed""",
    EVENT_TABLES,
)
def events_parsed(spark, sf):
    return parse_events(table(spark, sf, "raw_events")).select(
        "arrival", "is_json", "recognised", "event", "session_id", "link_id", "order_id_raw", "order_id",
        "payment_id", "amount_minor", "amount_paid_minor", "currency",
    )


@query("events_admitted", "WITH " + PARSED_SQL.strip() + " SELECT arrival, event_id, reject FROM admitted", EVENT_TABLES)
def events_admitted(spark, sf):
    return payments.admit_events(_raw(spark, sf), SECRET).select("arrival", "event_id", "reject")


def _first_events(spark: SparkSession, sf: str) -> DataFrame:
    judged = payments.admit_events(_raw(spark, sf), SECRET)
    return payments.dedupe_events(judged.where("reject IS NULL").drop("reject"))


@query("events_deduplicated", "WITH " + PARSED_SQL.strip() + " SELECT arrival, event_id, payment_id FROM firsts", EVENT_TABLES)
def events_deduplicated(spark, sf):
    return _first_events(spark, sf).select("arrival", "event_id", "payment_id")


@query("events_folded", "WITH " + FOLD_SQL.strip() + _FOLDED_SQL, FOLD_TABLES)
def events_folded(spark, sf):
    return payments.fold_payments(_first_events(spark, sf), table(spark, sf, "sessions")).select(*_FOLDED)


@query(
    "events_reasons",
    "WITH " + FOLD_SQL.strip() + """
SELECT event_id, CASE reason_code WHEN 'SESSION_UNKNOWN' THEN event || ': no session ' || coalesce(session_id, 'is named')
  WHEN 'ALREADY_COMPLETED' THEN 'paid before; this payment event is only noted'
  WHEN 'LATE_AUTH_AFTER_TERMINAL' THEN coalesce(payment_id, 'a payment without id') || ': money for a session that is ' || status || '; somebody has to deliver or pay back'
  WHEN 'AMOUNT_MISMATCH' THEN 'owed ' || total_minor || ', got ' || coalesce(CAST(amount_paid_minor AS VARCHAR), 'no amount') || '; the session stays open'
  WHEN 'CURRENCY_MISMATCH' THEN 'owed in ' || session_currency || ', got ' || currency
  WHEN 'PAYMENT_CAPTURED' THEN coalesce(payment_id, 'a payment without id') || ': ' || total_minor || ' received'
  WHEN 'EXPIRY_AFTER_COMPLETION' THEN 'the link ran out after it was paid; the sale stands'
  WHEN 'ALREADY_TERMINAL' THEN 'nothing to end: the session is ' || status WHEN 'LINK_EXPIRED' THEN 'the link ran out unpaid'
  WHEN 'CANCEL_AFTER_COMPLETION' THEN 'the link was withdrawn after it was paid; the sale stands'
  WHEN 'LINK_CANCELLED' THEN 'the provider withdrew the link' ELSE event || ': not acted on' END AS reason_human FROM folded""",
    FOLD_TABLES,
)
def events_reasons(spark, sf):
    return payments.fold_payments(_first_events(spark, sf), table(spark, sf, "sessions")).select("event_id", "reason_human")


@query(
    "events_session_state",
    "WITH " + FOLD_SQL.strip() + """,
moved AS (SELECT session_id, transition, order_id_raw FROM folded WHERE transition IS NOT NULL)
SELECT s.session_id, coalesce(m.transition, s.status) AS status, coalesce(m.order_id_raw, CASE WHEN s.payment_link_id IS NULL THEN 'order_old' END) AS order_id
FROM sessions s LEFT JOIN moved m USING (session_id)""",
    FOLD_TABLES,
)
def events_session_state(spark, sf):
    sessions = table(spark, sf, "sessions").withColumn(
        "order_id", F.when(F.col("payment_link_id").isNull(), "order_old")
    )
    folded = payments.fold_payments(_first_events(spark, sf), sessions)
    return payments.apply_transitions(sessions, folded).select("session_id", "status", "order_id")


def _in_parts(df: DataFrame, spark: SparkSession, purpose: str, start, parts: int = 3) -> str:
    """Feeds the rows to a stream in `parts` portions by arrival; returns its folder.

    The stream is stopped and started again between portions, so every portion also
    picks up the progress and state the one before has stored.
    """
    folder = shared_folder(spark, purpose)
    steps = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx("arrival", F.array(*[F.lit(s) for s in steps]))).first()[0] or []
    portion = F.lit(0)
    for bound in bounds:
        portion = portion + (F.col("arrival") > bound).cast("int")
    for number in range(parts):
        df.where(portion == number).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return folder


@query("stream_events_folded", "WITH " + FOLD_SQL.strip() + _FOLDED_SQL, FOLD_TABLES)
def stream_events_folded(spark, sf):
    """The fold as a stream: raw events in micro-batches, audit rows read from its table."""
    sessions = table(spark, sf, "sessions")
    folder = _in_parts(
        written(_raw(spark, sf), "raw-events"), spark, "events",
        lambda stream, folder: payments.start_fold(stream, sessions, SECRET, folder),
    )
    return spark.read.schema(payments.AUDIT_SCHEMA).parquet(f"{folder}/audit").select(*_FOLDED)


HORIZON = timedelta(hours=6)
#: Second deliveries come 0 to 12 hours after the first; events are fed and ordered by the time they were received.
_LATER = """
again AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS copy FROM admitted WHERE reject IS NULL),
received AS (SELECT * REPLACE (received_at + INTERVAL 4 HOUR * (CASE WHEN arrival % 10 = 5 THEN n % 4 ELSE 0 END) AS received_at) FROM again),
timed AS (SELECT * REPLACE (CAST(epoch(date_trunc('second', received_at)) AS BIGINT) * 1000000000 + arrival AS arrival) FROM received),
firsts AS (SELECT * FROM timed QUALIFY coalesce(received_at > lag(received_at) OVER (PARTITION BY event_id ORDER BY received_at, arrival) + INTERVAL 6 HOUR, true))"""
_HORIZON_SQL = FOLD_SQL.replace(FOLD_SQL[FOLD_SQL.index("\nfirsts AS"):FOLD_SQL.index(",\nfaced AS")], _LATER)


@query("stream_events_horizon", "WITH " + _HORIZON_SQL.strip() + _FOLDED_SQL, FOLD_TABLES)
def stream_events_horizon(spark, sf):
    """The fold with event ids remembered for six hours only: what is delivered again later counts as a new event."""
    number = F.substring("event_id", 5, 30).try_cast("bigint")
    hours = F.when(F.col("arrival") % 10 == 5, number % 4 * 4).otherwise(0)
    raw = _raw(spark, sf).withColumn("received_at", F.col("received_at") + F.make_dt_interval(hours=F.coalesce(hours, F.lit(0))))
    timed = raw.withColumn("arrival", F.unix_seconds("received_at") * 1_000_000_000 + F.col("arrival"))
    sessions = table(spark, sf, "sessions")
    folder = _in_parts(
        written(timed, "raw-events"), spark, "events-horizon",
        lambda stream, folder: payments.start_fold(stream, sessions, SECRET, folder, HORIZON),
    )
    return spark.read.schema(payments.AUDIT_SCHEMA).parquet(f"{folder}/audit").select(*_FOLDED)


@query(
    "stream_sessions_expired",
    """
WITH latest AS (SELECT *, max(updated_at) OVER () AS now FROM (
  SELECT session_id, CASE WHEN n % 10 = 7 THEN 'completed' ELSE status END AS status, updated_at + INTERVAL 1 DAY * (CASE WHEN n % 10 = 7 THEN 1 ELSE 0 END) AS updated_at, link_expires_at
  FROM (SELECT *, CAST(substr(session_id, 4) AS BIGINT) AS n FROM sessions)))
SELECT l.session_id, l.link_expires_at + INTERVAL 120 SECOND AS expired_at FROM latest l JOIN sessions s USING (session_id)
WHERE s.status = 'complete_in_progress' AND l.link_expires_at + INTERVAL 120 SECOND <= CASE WHEN l.status = 'completed' THEN l.updated_at ELSE l.now END""",
    ("sessions",),
)
def stream_sessions_expired(spark, sf):
    """Pending sessions expired by timers as time passes; one in ten is paid a day after it was opened."""
    number = F.substring("session_id", 4, 30).cast("bigint")
    opened = table(spark, sf, "sessions").select("session_id", "status", "link_expires_at", "updated_at")
    paid = opened.where(number % 10 == 7).withColumn("status", F.lit("completed")).withColumn(
        "updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY")
    )
    updates = opened.withColumn("turn", F.lit(0)).unionByName(paid.withColumn("turn", F.lit(1)))
    updates = updates.withColumn("arrival", F.unix_seconds("updated_at") * 10 + F.col("turn"))
    folder = _in_parts(written(updates.drop("turn"), "updates"), spark, "expiry", payments.start_expiry)
    return spark.read.schema(payments.EXPIRED_SCHEMA).parquet(f"{folder}/expired").select("session_id", "expired_at")


@query(
    "stream_requests_arbitrated",
    """
WITH owner AS (SELECT merchant_id, key, endpoint, min(arrival) AS first_arrival FROM requests GROUP BY ALL),
judged AS (SELECT r.*, o.arrival AS owner_arrival, o.body AS owner_body, o.finished_at AS owner_finished, o.response_status AS owner_status
  FROM requests r JOIN owner w USING (merchant_id, key, endpoint) JOIN requests o ON o.arrival = w.first_arrival)
SELECT arrival, CASE WHEN arrival = owner_arrival THEN 'proceed' WHEN body <> owner_body THEN 'conflict'
  WHEN owner_finished IS NULL OR owner_finished > arrived_at THEN 'in_flight' ELSE 'replay' END AS decision FROM judged""",
    ("requests",),
)
def stream_requests_arbitrated(spark, sf):
    folder = _in_parts(table(spark, sf, "requests"), spark, "requests", requests.start_arbitration)
    return spark.read.parquet(f"{folder}/decisions").select("arrival", "decision")
