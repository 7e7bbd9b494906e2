import datetime
import hashlib
import hmac
import json
import random
import tempfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stallbook.operators import cart
from stallbook.sources.payments import parse_events
from stallbook.streaming import payments, requests
from stallbook.streaming.state import FirstOwner

SECRET = "s"
SESSIONS = "session_id string, status string, currency string, snapshot_total_minor bigint, order_id string"
RAW = "event_id string, arrival bigint, body string, signature string"


def body(event, session, paid=100, currency="INR", order="order_A1", **more):
    link = {"id": "plink_1", "reference_id": session, "order_id": order, "amount": 100, "amount_paid": paid, "currency": currency, "notes": [], **more}
    return json.dumps({"entity": "event", "event": event, "payload": {"payment_link": {"entity": link}, "payment": {"entity": {"id": "pay_1"}}}})


def raw_row(event_id, arrival, text):
    return event_id, arrival, text, hmac.new(SECRET.encode(), text.encode(), hashlib.sha256).hexdigest()


def test_field_types(spark):
    bodies = [
        body("payment_link.paid", "cs", paid=v) for v in (100, 100.0, 10.5, "100", True, None)
    ] + ["[]", '{"entity":"order","event":"x"}', '{"entity":"event","event":""}', "nope", '{"entity":"event","event":"e","payload":[]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = parse_events(df).orderBy("i").collect()
    assert [r.amount_paid_minor for r in got[:6]] == [100, 100, None, None, None, None]
    assert [r.recognised for r in got] == [True] * 6 + [False, False, False, False, True]
    assert [r.is_json for r in got[6:]] == [True, True, True, False, True]
    assert got[0].order_id == "A1" and got[0].order_id_raw == "order_A1"


def sequential(events, sessions):
    state = {s[0]: s[1] for s in sessions}
    facts = {s[0]: s for s in sessions}
    out = []
    for arrival, kind, session, paid, currency in events:
        status = state.get(session)
        terminal = status in ("completed", "expired", "canceled")
        target = None
        if status is None:
            code = "SESSION_UNKNOWN"
        elif kind == "payment_link.paid":
            if status == "completed":
                code = "ALREADY_COMPLETED"
            elif terminal:
                code = "LATE_AUTH_AFTER_TERMINAL"
            elif paid != facts[session][3]:
                code = "AMOUNT_MISMATCH"
            elif currency != facts[session][2]:
                code = "CURRENCY_MISMATCH"
            else:
                code, target = "PAYMENT_CAPTURED", "completed"
        elif kind == "payment_link.expired":
            code = "EXPIRY_AFTER_COMPLETION" if status == "completed" else "ALREADY_TERMINAL" if terminal else "LINK_EXPIRED"
            target = "expired" if code == "LINK_EXPIRED" else None
        elif kind == "payment_link.cancelled":
            code = "CANCEL_AFTER_COMPLETION" if status == "completed" else "ALREADY_TERMINAL" if terminal else "LINK_CANCELLED"
            target = "canceled" if code == "LINK_CANCELLED" else None
        else:
            code = "EVENT_NOT_ACTIONED"
        out.append((arrival, status, code, target))
        if target:
            state[session] = target
    return out


def scenario():
    random.seed(5)
    statuses = ["complete_in_progress", "ready_for_payment", "completed", "expired", "canceled"]
    sessions = [(f"cs_{n}", random.choice(statuses), "INR", 100, None) for n in range(25)]
    kinds = ["payment_link.paid", "payment_link.paid", "payment_link.expired", "payment_link.cancelled", "payment_link.partial"]
    events = [
        (n, random.choice(kinds), f"cs_{random.randint(0, 27)}", random.choice([100, 100, 99, None]), random.choice(["INR", "INR", "USD"]))
        for n in range(300)
    ]
    return sessions, events


def test_fold_is_the_sequential_one(spark):
    sessions, events = scenario()
    raw = spark.createDataFrame([raw_row(f"e{a}", a, body(k, s, p, c)) for a, k, s, p, c in events], RAW)
    admitted = payments.admit_events(raw, SECRET).where("reject IS NULL")
    folded = payments.fold_payments(admitted, spark.createDataFrame(sessions, SESSIONS)).orderBy("arrival").collect()
    assert [(r.arrival, r.session_status_at_event, r.reason_code, r.transition) for r in folded] == sequential(events, sessions)


def test_stream_equals_batch_and_survives_redelivery(spark):
    sessions, events = scenario()
    table = spark.createDataFrame(sessions, SESSIONS)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = [raw_row(f"e{a}", a, body(k, s, p, c)) for a, k, s, p, c in events]
    forged = [("e250", 1000, rows[250][2], "0" * 64), ("", 1001, *rows[1][2:]), ("e9", 1002, *rows[9][2:])]
    portions = [rows[:100] + forged[:1], rows[100:] + forged[1:], rows[:50]]
    for portion in portions:
        spark.createDataFrame(portion, RAW).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(RAW).parquet(f"{folder}/in")
        payments.start_fold(stream, table, SECRET, f"{folder}/out").awaitTermination()
    audit = spark.read.parquet(f"{folder}/out/audit")
    got = [(r.arrival, r.session_status_at_event, r.reason_code, r.transition) for r in audit.orderBy("arrival").collect()]
    assert got == sequential(events, sessions)
    assert sorted(r.reject for r in spark.read.parquet(f"{folder}/out/rejected").collect()) == ["invalid_signature", "missing_event_id"]
    after = {r.session_id: r.status for r in payments.apply_transitions(table, audit).collect()}
    assert all(after[s] == t for _, _, _, t, s in [(*x, e[2]) for x, e in zip(got, events)] if t)


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def feed(spark, path, rows, schema):
    """Appends rows as one file, which makes them one batch of the stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).parquet(f"{path}/in")


def audit_of(spark, path):
    rows = spark.read.schema(payments.AUDIT_SCHEMA).parquet(f"{path}/out/audit").orderBy("arrival").collect()
    return [(r.arrival, r.session_status_at_event, r.reason_code, r.transition) for r in rows]


def test_a_batch_that_fails_is_repeated_from_the_same_state(spark, monkeypatch):
    sessions, events = scenario()
    table = spark.createDataFrame(sessions, SESSIONS)
    rows = [raw_row(f"e{a}", a, body(k, s, p, c)) for a, k, s, p, c in events]
    path = folder()
    payments.start_fold(feed(spark, path, rows[:100], RAW), table, SECRET, f"{path}/out").awaitTermination()
    for stop in ("audit", "transitions"):
        whole = payments.replace_batch

        def failing(df, target, batch_id, stop=stop, whole=whole):
            if target.endswith(stop):
                raise RuntimeError("stopped")
            whole(df, target, batch_id)

        monkeypatch.setattr(payments, "replace_batch", failing)
        more = rows[100:200] if stop == "audit" else []
        stream = feed(spark, path, more, RAW) if more else spark.readStream.schema(RAW).parquet(f"{path}/in")
        with pytest.raises(Exception):  # noqa: B017
            payments.start_fold(stream, table, SECRET, f"{path}/out").awaitTermination()
        monkeypatch.undo()
    payments.start_fold(feed(spark, path, rows[200:] + rows[:60], RAW), table, SECRET, f"{path}/out").awaitTermination()
    assert audit_of(spark, path) == sequential(events, sessions)


def test_sessions_opened_while_the_stream_runs(spark):
    sessions, events = scenario()
    rows = [raw_row(f"e{a}", a, body(k, s, p, c)) for a, k, s, p, c in events]
    path = folder()
    early = spark.createDataFrame(sessions[:10], SESSIONS)
    late = [r for r, e in zip(rows, events) if int(e[2][3:]) >= 10]
    first = [r for r, e in zip(rows, events) if int(e[2][3:]) < 10]
    for part, new in ((first, sessions[:1]), (late, sessions[10:])):  # the first one states a session again
        spark.createDataFrame(new, SESSIONS).write.mode("append").parquet(f"{path}/opened")
        opened = spark.readStream.schema(SESSIONS).parquet(f"{path}/opened")
        payments.start_fold(feed(spark, path, part, RAW), early, SECRET, f"{path}/out", opened=opened).awaitTermination()
    assert audit_of(spark, path) == sequential(events, sessions)


TIMED = RAW + ", received_at timestamp"
NOON = datetime.datetime(2024, 1, 1, 12)


def hours(n):
    return NOON + datetime.timedelta(hours=n)


def test_horizon_keeps_forged_events_from_using_up_an_id(spark):
    path = folder()
    good = raw_row("e1", 2, body("payment_link.paid", "cs_1"))
    rows = [("e1", 1, good[2], "0" * 64), good, ("e1", 3, *good[2:])]
    sessions = spark.createDataFrame([("cs_1", "complete_in_progress", "INR", 100, None)], SESSIONS)
    stream = feed(spark, path, [(*r, NOON) for r in rows], TIMED)
    payments.start_fold(stream, sessions, SECRET, f"{path}/out", datetime.timedelta(hours=1)).awaitTermination()
    assert [c for _, _, c, _ in audit_of(spark, path)] == ["PAYMENT_CAPTURED"]
    assert [r.arrival for r in spark.read.parquet(f"{path}/out/rejected").collect()] == [1]


@pytest.mark.parametrize("portions", [1, 3])
def test_ids_count_anew_beyond_the_horizon(spark, portions):
    """What is decided depends on the times alone, however the rows are cut into batches."""
    paid = body("payment_link.paid", "cs_1")
    times = [0, 0.5, 1, 1.25, 2.5, 2.75, 9]  # with one hour: 0 and 1.25 and 2.5 and 9 count
    rows = [(*raw_row("e1", n + 1, paid), hours(h)) for n, h in enumerate(times)]
    sessions = spark.createDataFrame([("cs_1", "complete_in_progress", "INR", 100, None)], SESSIONS)
    path, size = folder(), -(-len(rows) // portions)
    for k in range(0, len(rows), size):
        stream = feed(spark, path, rows[k:k + size], TIMED)
        payments.start_fold(stream, sessions, SECRET, f"{path}/out", datetime.timedelta(hours=1)).awaitTermination()
    got = audit_of(spark, path)
    assert [a for a, *_ in got] == [1, 4, 5, 7] and [c for _, _, c, _ in got] == ["PAYMENT_CAPTURED"] + ["ALREADY_COMPLETED"] * 3


def test_events_older_than_the_horizon_are_left_out(spark):
    path = folder()
    sessions = spark.createDataFrame([("cs_1", "complete_in_progress", "INR", 100, None)], SESSIONS)
    rows = [(*raw_row(f"e{n}", n, body("payment_link.paid", "cs_1")), hours(h)) for n, h in ((1, 0), (2, 10), (3, 8), (4, 9.5), (5, 11))]
    for row in rows:  # e3 comes two hours late, e4 half an hour
        payments.start_fold(feed(spark, path, [row], TIMED), sessions, SECRET, f"{path}/out", datetime.timedelta(hours=1)).awaitTermination()
    assert [a for a, *_ in audit_of(spark, path)] == [1, 2, 4, 5]


UPDATES = "session_id string, status string, link_expires_at timestamp, updated_at timestamp, arrival bigint"


def test_sessions_expire_as_the_batch_rule_says_at_each_watermark(spark):
    random.seed(3)
    rows = []
    for n in range(60):
        at = random.randint(0, 40)
        rows.append((f"cs_{n}", random.choice(["complete_in_progress"] * 3 + ["completed"]), random.choice([None, hours(at + random.randint(-2, 20))]), hours(at), n))
        if n % 4 == 0:
            rows.append((f"cs_{n}", random.choice(["completed", "canceled", "complete_in_progress"]), random.choice([None, hours(at + 30)]), hours(at + random.randint(1, 12)), 100 + n))
    rows.sort(key=lambda r: (r[3], r[4]))
    path, done, size = folder(), [], -(-len(rows) // 3)
    rows.insert(0, ("cs_now", "complete_in_progress", rows[-1][3] - datetime.timedelta(seconds=120), rows[0][3], -1))  # due just at the end
    for k in range(0, len(rows), size):
        payments.start_expiry(feed(spark, path, rows[k:k + size], UPDATES), path).awaitTermination()
        done = rows[:k + size]
        now = done[-1][3]
        # Session by session: what was due before its next row, and among the latest rows what is due now.
        expected = {}
        for key in {r[0] for r in done}:
            own = [r for r in done if r[0] == key]
            for row, until in zip(own, [r[3] for r in own[1:]] + [now]):
                if row[1] == "complete_in_progress" and row[2] is not None and row[2] + datetime.timedelta(seconds=120) <= until:
                    expected.setdefault(key, []).append(row[2] + datetime.timedelta(seconds=120))
        got = {}
        for r in spark.read.schema(payments.EXPIRED_SCHEMA).parquet(f"{path}/expired").collect():
            got.setdefault(r.session_id, []).append(r.expired_at)
        assert {s: sorted(x) for s, x in got.items()} == expected
    latest = spark.createDataFrame([max((r for r in done if r[0] == s), key=lambda r: (r[3], r[4])) for s in {r[0] for r in done}], UPDATES)
    due = {r.session_id for r in cart.expire_due(latest, F.lit(done[-1][3])).where("expired_now").collect()}
    assert due and due <= set(expected)


REQUESTS = "merchant_id string, key string, endpoint string, body string, arrival bigint, arrived_at timestamp, finished_at timestamp, response_status int"


def test_owners_of_keys_are_remembered(spark):
    ask = lambda n, key, text="b": ("m", key, "create", text, n, hours(n), hours(n), 201)
    path = folder()
    for rows in ([ask(2, "k"), ask(1, "k"), ask(3, "k", "other")], [ask(4, "k", "other"), ask(5, "n"), ask(0, "n")]):
        requests.start_arbitration(feed(spark, path, rows, REQUESTS), path).awaitTermination()
    got = {r.arrival: r.decision for r in spark.read.parquet(f"{path}/decisions").collect()}
    assert got == {1: "proceed", 2: "replay", 3: "conflict", 4: "conflict", 0: "proceed", 5: "replay"}


def test_the_first_batch_that_names_a_key_owns_it(spark):
    path = folder()
    ask = lambda n, text: ("m", "k", "create", text, n, hours(n), hours(n), 201)
    for row in (ask(5, "a"), ask(1, "b"), ask(6, "a")):
        requests.start_arbitration(feed(spark, path, [row], REQUESTS), path).awaitTermination()
    assert {r.arrival: r.decision for r in spark.read.parquet(f"{path}/decisions").collect()} == {5: "proceed", 1: "conflict", 6: "replay"}


def test_a_bucket_of_keys_costs_few_calls_to_the_store():
    """The keys of a bucket share one value: calls do not grow with keys."""
    calls = []

    class Value:
        def __init__(self):
            self.kept = None

        def exists(self):
            calls.append("exists")
            return self.kept is not None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    owners = FirstOwner(["key"], "arrival bigint, sha string", "arrival")
    owners.init(Handle())
    rows = [Row(key=f"k{i % 100}", arrival=i, sha=str(i)) for i in range(300)]
    assert all(r.owner is None for r in owners.handleInputRows((1,), iter(rows), None))
    later = list(owners.handleInputRows((1,), iter([Row(key="k7", arrival=-1, sha="x"), Row(key="new", arrival=9, sha="y")]), None))
    assert [r.owner and r.owner.arrival for r in later] == [7, None]
    assert len(calls) <= 6
