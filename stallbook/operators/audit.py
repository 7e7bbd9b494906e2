"""Read models over the append-only decision log and the session table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import sha256_hex
from ..functions.text import bearer


def check_explained(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a refusal must carry a code and a text."""
    filled = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    fine = (F.col("outcome") != "refused") | (filled("reason_code") & filled("reason_human"))
    return events.where(fine), events.where(~fine)


def sequenced(events: DataFrame, batch_id: int) -> DataFrame:
    """Adds seq, the insertion order, from the batch and the event's own order.

    `ord` is the arrival number of what caused the event and `step` its place among
    the events of one cause, so that no global sort is needed to number the log.
    """
    return events.withColumn(
        "seq", F.lit(batch_id).cast("bigint") * F.lit(10**14) + F.col("ord") * 100 + F.coalesce("step", F.lit(0))
    )


def timeline(events: DataFrame, session_id: str | None = None) -> DataFrame:
    """Events in insertion order, of one session or of all, session by session."""
    if session_id is not None:
        return events.where(F.col("session_id") == session_id).orderBy("seq")
    return events.where("session_id IS NOT NULL").orderBy("session_id", "seq")


def session_list(sessions: DataFrame, events: DataFrame, lines: DataFrame) -> DataFrame:
    """Sessions with event count, refusals, last stated reason, first item and item count."""
    happened = events.groupBy("session_id").agg(
        F.count("event_id").alias("events"),
        F.count_if(F.col("outcome") == "refused").alias("refusals"),
        F.max_by("reason_code", F.when(F.col("reason_code").isNotNull(), F.col("seq"))).alias("last_reason"),
    )
    bought = lines.groupBy("session_id").agg(
        F.min_by("title", "pos").alias("item"), F.count(F.lit(1)).alias("item_count")
    )
    return (
        sessions.join(happened, "session_id", "left")
        .join(bought, "session_id", "left")
        .select(
            "session_id", "status", "updated_at", "item",
            F.coalesce("item_count", F.lit(0)).alias("item_count"),
            F.coalesce("events", F.lit(0)).alias("events"),
            F.coalesce("refusals", F.lit(0)).alias("refusals"),
            "last_reason",
        )
    )


def session_page(listed: DataFrame, which: str, limit: int, now: Column) -> DataFrame:
    """One page, newest first, with one row more than asked for to tell whether more exist."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if which == "refused":
        listed = listed.where("refusals > 0")
    elif which == "today":
        listed = listed.where(F.col("updated_at") >= F.date_trunc("day", now))
    return listed.orderBy(F.desc("updated_at"), "session_id").limit(limit + 1)


def overview(catalog: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """One row: variants on sale, sessions, refusals."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    parts = (
        counted(catalog, "variants")
        .unionByName(counted(sessions, "sessions"))
        .unionByName(counted(events.where("outcome = 'refused'"), "refusals"))
    )
    pick = lambda name: F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name)
    return parts.agg(pick("variants"), pick("sessions"), pick("refusals"))


def latest_refusal(events: DataFrame) -> DataFrame:
    """The newest refusal whose evidence names both a cart total and a ceiling (even if null)."""
    keys = F.json_object_keys("evidence")
    both = F.array_contains(keys, "cart_total_minor") & F.array_contains(keys, "mandate_ceiling_minor")
    amount = lambda name: F.get_json_object("evidence", f"$.{name}").try_cast("bigint")
    return (
        events.where((F.col("outcome") == "refused") & both)
        .orderBy(F.desc("seq"))
        .limit(1)
        .select(
            "session_id", "reason_code",
            amount("cart_total_minor").alias("cart"), amount("mandate_ceiling_minor").alias("ceiling"),
        )
    )


_EVIDENCE = """
peers_failed array<struct<check:string,reason_code:string>>,
peers_passed array<string>,
drift array<struct<id:string,title:string,quoted_minor:bigint,live_minor:bigint>>,
alternatives_offered array<struct<id:string,title:string,price_minor:bigint>>
"""


def evidence_rows(events: DataFrame) -> DataFrame:
    """Evidence unfolded: one row per failed or passed check, drifted item and alternative."""
    read = events.select("event_id", "session_id", "seq", F.from_json("evidence", _EVIDENCE).alias("e"))
    item = lambda kind, name, code, a, b: F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), code.alias("reason_code"),
        a.cast("bigint").alias("first_minor"), b.cast("bigint").alias("second_minor"),
    )
    none = F.lit(None)
    parts = [
        F.transform("e.peers_failed", lambda p: item("check_failed", p["check"], p["reason_code"], none, none)),
        F.transform("e.peers_passed", lambda p: item("check_passed", p, none.cast("string"), none, none)),
        F.transform(
            "e.drift",
            lambda d: item("drift", F.coalesce(d["title"], d["id"]), none.cast("string"), d["quoted_minor"], d["live_minor"]),
        ),
        F.transform(
            "e.alternatives_offered",
            lambda a: item("alternative", a["title"], none.cast("string"), a["price_minor"], none),
        ),
    ]
    kind = "array<struct<kind:string,name:string,reason_code:string,first_minor:bigint,second_minor:bigint>>"
    every = F.concat(*[F.coalesce(p, F.array().cast(kind)) for p in parts])
    return read.select("event_id", "session_id", "seq", F.explode(every).alias("d")).select(
        "event_id", "session_id", "seq", "d.*"
    )


def owned(sessions: DataFrame, identities: DataFrame) -> DataFrame:
    """Sessions that belong to the asking merchant. `identities`: session_id, merchant_id."""
    return sessions.join(identities.select("session_id", "merchant_id").distinct(), ["session_id", "merchant_id"], "left_semi")


def resolve_agents(requests: DataFrame, credentials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(authenticated, unauthenticated) requests by the hash of their bearer token."""
    hashed = requests.withColumn("token_sha256", sha256_hex(bearer("authorization")))
    valid = credentials.where("revoked_at IS NULL").select("token_sha256", "agent_id", "merchant_id")
    known = hashed.join(valid, "token_sha256")
    return known, hashed.join(valid.select("token_sha256"), "token_sha256", "left_anti")
