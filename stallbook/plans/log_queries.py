"""Registered queries over the decision log, jobs, invariants and evaluation, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import options
from ..functions.digest import sha256_hex
from ..operators import audit, evaluate, grid, jobs, normalize, quality
from ..session import shared_folder, written
from ..sources.tables import append
from .catalogue_queries import NORM_SQL, NORM_TABLES, _data_rows, _readings, _variants, fold_sql
from .tables import table, with_tables

NOW = "2024-01-15 12:00:00"
RUN_AT = "1998-01-01 00:00:00"

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, tables: tuple[str, ...] = ()):
    def add(build):
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = with_tables(check, *tables) if tables else check
        return build

    return add


# --- audit log ------------------------------------------------------------------------
@query(
    "audit_explained",
    """
SELECT event_id, NOT (outcome = 'refused' AND (coalesce(reason_code, '') = '' OR coalesce(reason_human, '') = '')) AS explained FROM audit""",
    ("audit",),
)
def audit_explained(spark, sf):
    fine, rejected = audit.check_explained(table(spark, sf, "audit"))
    return fine.select("event_id", F.lit(True).alias("explained")).unionByName(
        rejected.select("event_id", F.lit(False).alias("explained"))
    )


@query(
    "audit_appended",
    """
SELECT event_id, CASE WHEN event_id LIKE '%7' THEN 2 ELSE 1 END * CAST(100000000000000 AS BIGINT) + seq * 100 AS seq, outcome FROM audit""",
    ("audit",),
)
def audit_appended(spark, sf):
    """Two batches appended to a stored log, read back in insertion order."""
    folder = shared_folder(spark, "audit")
    events = table(spark, sf, "audit").drop("ts").withColumnRenamed("seq", "ord").withColumn("step", F.lit(0))
    late = F.col("event_id").endswith("7")
    append(audit.sequenced(events.where(~late), 1), folder)
    append(audit.sequenced(events.where(late), 2), folder)
    return audit.timeline(spark.read.parquet(folder).fillna({"session_id": ""})).select("event_id", "seq", "outcome")


@query(
    "audit_timeline",
    """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place, event_id, action, outcome FROM audit WHERE session_id IS NOT NULL""",
    ("audit",),
)
def audit_timeline(spark, sf):
    from ..operators.ranking import positions

    events = table(spark, sf, "audit").where("session_id IS NOT NULL")
    placed = positions(events, ["session_id"], ["seq"], "place")
    return audit.timeline(placed).select("session_id", "place", "event_id", "action", "outcome")


LIST_SQL = """
happened AS (SELECT session_id, count(event_id) AS events, count(*) FILTER (WHERE outcome = 'refused') AS refusals,
  arg_max(reason_code, seq) FILTER (WHERE reason_code IS NOT NULL) AS last_reason FROM audit GROUP BY 1),
bought AS (SELECT session_id, arg_min(item_id, pos) AS item, count(*) AS item_count FROM requested GROUP BY 1),
listed AS (SELECT s.session_id, s.status, s.updated_at, b.item, coalesce(b.item_count, 0) AS item_count, coalesce(h.events, 0) AS events,
  coalesce(h.refusals, 0) AS refusals, h.last_reason FROM sessions s LEFT JOIN happened h USING (session_id) LEFT JOIN bought b USING (session_id))"""
LIST_TABLES = ("sessions", "audit", "requested")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "requested").withColumn("title", F.col("item_id"))
    return audit.session_list(table(spark, sf, "sessions"), table(spark, sf, "audit"), lines)


@query("audit_session_list", "WITH " + LIST_SQL.strip() + " SELECT * FROM listed", LIST_TABLES)
def audit_session_list(spark, sf):
    return _listed(spark, sf)


@query(
    "audit_session_page",
    "WITH " + LIST_SQL.strip() + """
(SELECT 'all' AS which, * FROM listed ORDER BY updated_at DESC, session_id LIMIT 5001) UNION ALL
(SELECT 'refused' AS which, * FROM listed WHERE refusals > 0 ORDER BY updated_at DESC, session_id LIMIT 2) UNION ALL
(SELECT 'today' AS which, * FROM listed WHERE updated_at >= TIMESTAMP '1998-01-01 00:00:00' ORDER BY updated_at DESC, session_id LIMIT 51)""",
    LIST_TABLES,
)
def audit_session_page(spark, sf):
    listed, now = _listed(spark, sf), F.lit("1998-01-01 17:00:00").cast("timestamp")
    pages = [
        audit.session_page(listed, which, limit, now).withColumn("which", F.lit(which))
        for which, limit in (("all", 5000), ("refused", 1), ("today", 50))
    ]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query(
    "audit_overview",
    """
SELECT (SELECT count(*) FROM catalog) AS variants, (SELECT count(*) FROM sessions) AS sessions,
  (SELECT count(*) FROM audit WHERE outcome = 'refused') AS refusals""",
    ("catalog", "sessions", "audit"),
)
def audit_overview(spark, sf):
    return audit.overview(table(spark, sf, "catalog"), table(spark, sf, "sessions"), table(spark, sf, "audit"))


@query(
    "audit_latest_refusal",
    """
SELECT session_id, reason_code, CAST(evidence->>'$.cart_total_minor' AS BIGINT) AS cart, CAST(evidence->>'$.mandate_ceiling_minor' AS BIGINT) AS ceiling FROM audit
WHERE outcome = 'refused' AND list_contains(json_keys(evidence), 'cart_total_minor') AND list_contains(json_keys(evidence), 'mandate_ceiling_minor')
ORDER BY seq DESC LIMIT 1""",
    ("audit",),
)
def audit_latest_refusal(spark, sf):
    return audit.latest_refusal(table(spark, sf, "audit"))


@query(
    "audit_evidence_rows",
    """
WITH e AS (SELECT event_id, seq, evidence FROM audit)
SELECT event_id, 'check_failed' AS kind, f->>'$.check' AS name, f->>'$.reason_code' AS reason_code, CAST(NULL AS BIGINT) AS first_minor, CAST(NULL AS BIGINT) AS second_minor
  FROM (SELECT event_id, unnest(CAST(json_extract(evidence, '$.peers_failed') AS JSON[])) AS f FROM e)
UNION ALL SELECT event_id, 'check_passed', p, NULL, NULL, NULL FROM (SELECT event_id, unnest(CAST(json_extract(evidence, '$.peers_passed') AS VARCHAR[])) AS p FROM e)
UNION ALL SELECT event_id, 'drift', d->>'$.title', NULL, CAST(d->>'$.quoted_minor' AS BIGINT), CAST(d->>'$.live_minor' AS BIGINT)
  FROM (SELECT event_id, unnest(CAST(json_extract(evidence, '$.drift') AS JSON[])) AS d FROM e)
UNION ALL SELECT event_id, 'alternative', a->>'$.title', NULL, CAST(a->>'$.price_minor' AS BIGINT), NULL
  FROM (SELECT event_id, unnest(CAST(json_extract(evidence, '$.alternatives_offered') AS JSON[])) AS a FROM e)""",
    ("audit",),
)
def audit_evidence_rows(spark, sf):
    return audit.evidence_rows(table(spark, sf, "audit")).drop("session_id", "seq")


@query(
    "audit_owned_sessions",
    """
SELECT s.session_id, s.merchant_id FROM sessions s WHERE EXISTS (SELECT 1 FROM
  (SELECT session_id, 'mer_' || CAST(substr(session_id, 4) AS BIGINT) % 3 AS merchant_id FROM audit WHERE session_id IS NOT NULL) a
  WHERE a.session_id = s.session_id AND a.merchant_id = s.merchant_id)""",
    ("sessions", "audit"),
)
def audit_owned_sessions(spark, sf):
    asked = table(spark, sf, "audit").where("session_id IS NOT NULL").select(
        "session_id", F.concat(F.lit("mer_"), (F.substr("session_id", F.lit(4)).cast("bigint") % 3).cast("string")).alias("merchant_id")
    )
    return audit.owned(table(spark, sf, "sessions"), asked).select("session_id", "merchant_id")


@query(
    "audit_resolved_agents",
    """
WITH asked AS (SELECT arrival, nullif(regexp_extract(trim(coalesce("authorization", '')), '(?i)^bearer\\s+(\\S+)$', 1), '') AS token FROM requests)
SELECT a.arrival, c.agent_id, c.merchant_id FROM asked a LEFT JOIN credentials c ON c.token = a.token AND c.revoked_at IS NULL""",
    ("requests", "credentials"),
)
def audit_resolved_agents(spark, sf):
    credentials = table(spark, sf, "credentials").withColumn("token_sha256", sha256_hex("token"))
    requests = table(spark, sf, "requests").drop("merchant_id")
    known, unknown = audit.resolve_agents(requests, credentials)
    return known.select("arrival", "agent_id", "merchant_id").unionByName(
        unknown.select("arrival", F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("string").alias("merchant_id"))
    )


# --- jobs -------------------------------------------------------------------------------
@query(
    "jobs_created",
    """
WITH data AS (SELECT merchant_id, file, sheet, "row", headed FROM sheet_parts UNION SELECT merchant_id, file, sheet, 1, headed FROM sheet_parts WHERE NOT headed),
sheets AS (SELECT merchant_id, file, sheet, count(*) AS rows_total FROM data GROUP BY ALL),
named AS (SELECT *, 'job_' || substr(sha256(merchant_id || ' ' || file || '/' || sheet || ' ' || rows_total), 1, 16) AS job_id FROM sheets),
fresh AS (SELECT * FROM named WHERE job_id NOT LIKE '%7'),
placed AS (SELECT f.job_id, d."row", CAST((row_number() OVER (PARTITION BY f.job_id ORDER BY d."row") - 1) // 6 AS INTEGER) AS batch_index FROM fresh f JOIN data d USING (merchant_id, file, sheet))
SELECT job_id, batch_index, count(*) AS n_rows, min("row") AS first_row, max("row") AS last_row FROM placed GROUP BY ALL""",
    ("sheet_parts",),
)
def jobs_created(spark, sf):
    from ..functions.digest import job_id

    rows = written(_data_rows(spark, sf), "data-rows")
    sheet = ["merchant_id", "file", "sheet"]
    known = rows.groupBy(*sheet).agg(F.count(F.lit(1)).alias("n")).select(
        job_id("merchant_id", F.concat_ws("/", "file", "sheet"), "n").alias("job_id")
    ).where(F.col("job_id").endswith("7"))
    _, batches, job_rows = jobs.create_jobs(rows, known, F.lit(NOW).cast("timestamp"), 6)
    counted = job_rows.groupBy("job_id", "batch_index").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row")
    )
    return batches.join(counted, ["job_id", "batch_index"], "left").drop("status")


@query(
    "jobs_owed",
    f"""
SELECT r.job_id, r.batch_index, r.source_row FROM job_rows r JOIN batches b USING (job_id, batch_index)
WHERE r.reading IS NULL AND (b.status IN ('pending', 'failed') OR b.status = 'running' AND b.claimed_at < TIMESTAMP '{RUN_AT}' - INTERVAL 15 MINUTE)""",
    ("batches", "job_rows"),
)
def jobs_owed(spark, sf):
    return jobs.owed(
        table(spark, sf, "batches"), table(spark, sf, "job_rows"), F.lit(RUN_AT).cast("timestamp")
    ).select("job_id", "batch_index", "source_row")


def _applied(spark, sf):
    state = table(spark, sf, "jobs")
    for name in ("model_requested", "model_served", "prompt_sha256"):
        state = state.withColumn(name, F.lit(None).cast("string"))
    rows = table(spark, sf, "job_rows")
    readings = rows.where("source_row % 2 = 0").select("job_id", "source_row", F.lit("new").alias("reading"), F.lit(1).alias("ord"))
    return jobs.apply_results(
        state, table(spark, sf, "batches"), rows, readings, table(spark, sf, "outcomes"), F.lit(NOW).cast("timestamp")
    )


@query(
    "jobs_applied_batches",
    f"""
WITH last AS (SELECT job_id, batch_index, error, count(*) OVER (PARTITION BY job_id, batch_index) AS tries FROM outcomes
  QUALIFY row_number() OVER (PARTITION BY job_id, batch_index ORDER BY ord DESC) = 1)
SELECT b.job_id, b.batch_index, CASE WHEN l.error IS NULL THEN 'done' ELSE 'failed' END AS status, CAST(b.attempts + l.tries AS BIGINT) AS attempts,
  CASE WHEN l.error IS NULL THEN TIMESTAMP '{NOW}' ELSE b.completed_at END AS completed_at,
  CASE WHEN l.error LIKE '%429%' THEN 'PROVIDER_RATE_LIMITED' WHEN l.error LIKE '%schema validation%' THEN 'EXTRACTION_MALFORMED'
    WHEN l.error LIKE '%truncated%' THEN 'EXTRACTION_TRUNCATED' WHEN l.error LIKE '%refus%' THEN 'PROVIDER_REFUSED' WHEN l.error IS NOT NULL THEN 'PROVIDER_ERROR' END AS reason_code,
  l.error AS reason_human
FROM batches b JOIN last l USING (job_id, batch_index)""",
    ("batches", "outcomes"),
)
def jobs_applied_batches(spark, sf):
    return _applied(spark, sf)[1].select(
        "job_id", "batch_index", "status", "attempts", "completed_at", "reason_code", "reason_human"
    )


@query(
    "jobs_applied_jobs",
    """
WITH first AS (SELECT job_id, arg_min(provider, batch_index * 10 + ord) FILTER (WHERE provider IS NOT NULL) AS provider,
  arg_min(model_served, batch_index * 10 + ord) AS model_served FROM outcomes WHERE error IS NULL GROUP BY 1)
SELECT j.job_id, coalesce(j.provider, f.provider) AS provider, f.model_served FROM jobs j LEFT JOIN first f USING (job_id)""",
    ("jobs", "outcomes"),
)
def jobs_applied_jobs(spark, sf):
    return _applied(spark, sf)[0].select("job_id", "provider", "model_served")


@query(
    "jobs_applied_rows",
    """
SELECT job_id, source_row, CASE WHEN source_row % 2 = 0 THEN 'new' ELSE reading END AS reading FROM job_rows""",
    ("job_rows",),
)
def jobs_applied_rows(spark, sf):
    return _applied(spark, sf)[2].select("job_id", "source_row", "reading")


PROGRESS_SQL = """
b AS (SELECT job_id, count(*) AS batches_total, count(*) FILTER (WHERE status = 'done') AS batches_done, count(*) FILTER (WHERE status = 'failed') AS batches_failed FROM batches GROUP BY 1),
r AS (SELECT job_id, count(reading) AS rows_extracted FROM job_rows GROUP BY 1),
progress AS (SELECT j.job_id, j.rows_total, coalesce(batches_total, 0) AS batches_total, coalesce(batches_done, 0) AS batches_done,
  coalesce(batches_failed, 0) AS batches_failed, coalesce(rows_extracted, 0) AS rows_extracted FROM jobs j LEFT JOIN b USING (job_id) LEFT JOIN r USING (job_id))"""
PROGRESS_TABLES = ("jobs", "batches", "job_rows")


def _progress(spark, sf):
    return jobs.progress(table(spark, sf, "jobs"), table(spark, sf, "batches"), table(spark, sf, "job_rows"))


@query("jobs_progress", "WITH " + PROGRESS_SQL.strip() + " SELECT * FROM progress", PROGRESS_TABLES)
def jobs_progress(spark, sf):
    return _progress(spark, sf).select(
        "job_id", "rows_total", "batches_total", "batches_done", "batches_failed", "rows_extracted"
    )


@query(
    "jobs_status",
    "WITH " + PROGRESS_SQL.strip() + """
SELECT job_id, CASE WHEN batches_failed > 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN batches_failed > 0 THEN 'INGEST_BATCHES_FAILED' END AS reason_code,
  CASE WHEN batches_failed > 0 THEN batches_failed || ' of ' || batches_total || ' batches failed; ' || (rows_total - rows_extracted) || ' rows unread' END AS reason_human FROM progress""",
    PROGRESS_TABLES,
)
def jobs_status(spark, sf):
    return jobs.job_status(_progress(spark, sf)).select("job_id", "status", "reason_code", "reason_human")


@query("jobs_failures", "SELECT job_id, batch_index, reason_code, reason_human FROM batches WHERE status = 'failed'", ("batches",))
def jobs_failures(spark, sf):
    return jobs.failures(table(spark, sf, "batches"))


@query(
    "jobs_failed_rows",
    """
SELECT r.job_id, r.source_row, r.batch_index, b.reason_code, b.reason_human FROM job_rows r JOIN batches b USING (job_id, batch_index)
WHERE b.status = 'failed' AND r.reading IS NULL""",
    ("batches", "job_rows"),
)
def jobs_failed_rows(spark, sf):
    return jobs.failed_rows(table(spark, sf, "job_rows"), table(spark, sf, "batches"))


@query(
    "jobs_assembled",
    "WITH " + NORM_SQL.strip() + """
SELECT merchant_id, sheet, "row", option_ord, variant_id, product_id, title, array_to_string(flags, ',') AS flags FROM variants""",
    NORM_TABLES,
)
def jobs_assembled(spark, sf):
    """Stores rows with their readings as a job does, and assembles the products from that."""
    rows = _data_rows(spark, sf)
    stored = normalize.attach_readings(rows, _readings(spark, sf)).select(
        F.concat_ws("/", "file", "sheet").alias("job_id"), F.col("row").alias("source_row"), F.col("cells").alias("raw_cells"), "reading"
    )
    facts = rows.groupBy("merchant_id", "file", "sheet").agg(F.min("headers").alias("headers")).select(
        F.concat_ws("/", "file", "sheet").alias("job_id"), "merchant_id", F.col("file").alias("source_file"),
        F.col("sheet").alias("sheet_name"), "headers",
    )
    made, _ = jobs.assemble(facts, stored)
    return made.select(
        "merchant_id", "sheet", "row", "option_ord", "variant_id", "product_id", "title",
        F.array_join(F.array_sort("flags"), ",").alias("flags"),
    )


# --- invariants ---------------------------------------------------------------------------
@query(
    "quality_jobs",
    """
SELECT 'batch' AS "table", job_id || '/' || batch_index AS key, 'done_has_completed_at' AS rule FROM batches WHERE status = 'done' AND completed_at IS NULL
UNION ALL SELECT 'batch', job_id || '/' || batch_index, 'only_failed_has_reason' FROM batches WHERE status <> 'failed' AND reason_code IS NOT NULL
UNION ALL SELECT 'batch', job_id || '/' || batch_index, 'running_has_claimed_at' FROM batches WHERE status = 'running' AND claimed_at IS NULL
UNION ALL SELECT 'job', job_id, 'job_only_failed_has_reason' FROM jobs WHERE status <> 'failed' AND reason_code IS NOT NULL""",
    ("jobs", "batches"),
)
def quality_jobs(spark, sf):
    return quality.check_jobs(table(spark, sf, "jobs"), table(spark, sf, "batches"))


@query(
    "quality_variants",
    "WITH " + NORM_SQL.strip() + """,
altered AS (SELECT *, CASE WHEN "row" % 7 = 0 AND inventory_count > 0 THEN 'unknown' WHEN "row" % 5 = 0 AND inventory_count = 0 THEN 'in_stock' ELSE availability END AS stock FROM variants)
SELECT 'variant' AS "table", variant_id AS key, 'counted_is_in_stock' AS rule FROM altered WHERE inventory_count > 0 AND stock <> 'in_stock'
UNION ALL SELECT 'variant', variant_id, 'zero_is_out_of_stock' FROM altered WHERE inventory_count = 0 AND stock <> 'out_of_stock'
UNION ALL SELECT 'variant', variant_id, 'unknown_has_no_count' FROM altered WHERE stock = 'unknown' AND inventory_count IS NOT NULL""",
    NORM_TABLES,
)
def quality_variants(spark, sf):
    """Variants with faults planted into the stock column; as made they break no rule."""
    stock = (
        F.when((F.col("row") % 7 == 0) & (F.col("inventory_count") > 0), "unknown")
        .when((F.col("row") % 5 == 0) & (F.col("inventory_count") == 0), "in_stock")
        .otherwise(F.col("availability"))
    )
    return quality.check_variants(_variants(spark, sf).withColumn("availability", stock))


@query(
    "quality_catalog",
    """
WITH spoiled AS (SELECT *, CAST(substr(variant_id, 5) AS BIGINT) AS n FROM catalog), s AS (SELECT *, CAST(substr(session_id, 4) AS BIGINT) AS n FROM sessions)
SELECT 'catalog' AS "table", merchant_id || '/' || variant_id AS key, 'price_not_negative' AS rule FROM spoiled WHERE n % 71 = 0
UNION ALL SELECT 'catalog', merchant_id || '/' || variant_id, 'currency_code' FROM spoiled WHERE n % 73 = 0
UNION ALL SELECT 'catalog', merchant_id || '/' || variant_id, 'availability_known' FROM spoiled WHERE n % 79 = 0
UNION ALL SELECT 'session', session_id, 'status_known' FROM s WHERE n % 83 = 0
UNION ALL SELECT 'session', session_id, 'currency_code' FROM s WHERE n % 89 = 0""",
    ("catalog", "sessions"),
)
def quality_catalog(spark, sf):
    n = F.substr("variant_id", F.lit(5)).cast("bigint")
    spoiled = (
        table(spark, sf, "catalog").withColumn("price_minor", F.when(n % 71 == 0, -1).otherwise(F.col("price_minor")))
        .withColumn("currency", F.when(n % 73 == 0, "Rs").otherwise(F.col("currency")))
        .withColumn("availability", F.when(n % 79 == 0, "maybe").otherwise(F.col("availability")))
    )
    m = F.substr("session_id", F.lit(4)).cast("bigint")
    sessions = (
        table(spark, sf, "sessions").withColumn("status", F.when(m % 83 == 0, "done").otherwise(F.col("status")))
        .withColumn("currency", F.when(m % 89 == 0, "inr").otherwise(F.col("currency")))
    )
    return quality.check_catalog(spoiled, sessions)


@query(
    "quality_keys",
    """
WITH fewer AS (SELECT * FROM jobs WHERE job_id NOT LIKE '%3'), kept AS (SELECT * FROM batches WHERE attempts <> 2)
SELECT 'row' AS "table", job_id || '/' || source_row AS key, 'key_repeated' AS rule FROM job_rows GROUP BY job_id, source_row HAVING count(*) > 1
UNION ALL SELECT 'batch', job_id || '/' || batch_index, 'parent_missing' FROM kept WHERE job_id LIKE '%3'
UNION ALL SELECT 'row', job_id || '/' || source_row, 'parent_missing' FROM job_rows r WHERE NOT EXISTS (SELECT 1 FROM kept s WHERE s.job_id = r.job_id AND s.batch_index = r.batch_index)""",
    ("jobs", "batches", "job_rows"),
)
def quality_keys(spark, sf):
    fewer = table(spark, sf, "jobs").where("job_id NOT LIKE '%3'")
    return quality.check_keys(fewer, table(spark, sf, "batches").where("attempts <> 2"), table(spark, sf, "job_rows"))


# --- evaluation ------------------------------------------------------------------------------
LABELS_SQL = """
SELECT file, sheet, "row" AS source_row, item AS raw_item,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'nothing like it' ELSE upper(substr(p_name, 1, 4)) || '|zzz' END AS title_text,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'food' ELSE 'Apparel| home |KITCHEN|footwear|jewellery|unmapped' END AS category_text,
  CASE WHEN p_partkey % 3 = 0 THEN 'red, blue, black|green' ELSE NULL END AS colour_text,
  CASE WHEN p_partkey % 4 = 0 THEN 's/m/l' ELSE NULL END AS size_text,
  p_partkey % 31 = 0 AS title_inferred, p_partkey % 17 = 9 AS price_ambiguous,
  CASE WHEN p_partkey % 17 = 0 THEN CAST((900 + p_partkey % 100) * 100 AS BIGINT) WHEN p_partkey % 17 = 2 THEN CAST(1 AS BIGINT) ELSE NULL END AS price
FROM {sheet_parts}"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.sql(LABELS_SQL.replace('"row"', "`row`"), sheet_parts=table(spark, sf, "sheet_parts"))

    def listed(name: str):
        text = F.col(name)
        return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.split(text, "\\|"))

    return raw.select(
        "file", "sheet", "source_row", F.create_map(F.lit("Item"), F.col("raw_item")).alias("raw"),
        listed("title_text").alias("title"), listed("category_text").alias("category"), listed("colour_text").alias("colour"),
        listed("size_text").alias("size"), "title_inferred", "price_ambiguous", "price",
    )


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.score(_labels(spark, sf), _readings(spark, sf), _variants(spark, sf))


SCORE_SQL = (
    NORM_SQL + ", labels_ AS (" + LABELS_SQL.replace("{sheet_parts}", "sheet_parts") + f"""),
first_variants AS (SELECT * FROM variants WHERE option_ord = 0),
compared AS (SELECT b.*, r.title AS said_title, r.title_inferred AS said_inferred, nullif(r.colour, '') AS said_colour, nullif(r.size, '') AS said_size,
  v.category AS got_category, v.price_minor AS got_price, v.flags AS got_flags, r.title IS NOT NULL AS returned
  FROM labels_ b LEFT JOIN read r ON r.file = b.file AND r.sheet = b.sheet AND r.source_row = b.source_row
  LEFT JOIN first_variants v ON v.file = b.file AND v.sheet = b.sheet AND v."row" = b.source_row WHERE title_text <> '' OR category_text <> ''),
scored AS (SELECT file, sheet, source_row, raw_item, unnest([
  {{'field': 'row_returned', 'ok': returned, 'got': CASE WHEN returned THEN 'ok' ELSE 'MISSING' END, 'want': 'an entry'}},
  CASE WHEN returned AND title_text <> '' THEN {{'field': 'title', 'ok': len(list_filter(string_split(title_text, '|'), lambda k: contains({fold_sql('said_title')}, lower(k)))) > 0, 'got': said_title, 'want': title_text}} END,
  CASE WHEN returned AND category_text <> '' THEN {{'field': 'category', 'ok': len(list_filter(string_split(category_text, '|'), lambda k: lower(trim(k)) = got_category)) > 0, 'got': got_category, 'want': category_text}} END,
  CASE WHEN returned THEN {{'field': 'title_inferred', 'ok': said_inferred = title_inferred, 'got': CAST(said_inferred AS VARCHAR), 'want': CAST(title_inferred AS VARCHAR)}} END,
  CASE WHEN returned AND colour_text IS NOT NULL THEN {{'field': 'colour', 'ok': coalesce(list_contains(string_split(colour_text, '|'), lower(said_colour)), false), 'got': coalesce(said_colour, '—'), 'want': colour_text}} END,
  CASE WHEN returned AND size_text IS NOT NULL THEN {{'field': 'size', 'ok': coalesce(size_text = lower(said_size), false), 'got': coalesce(said_size, '—'), 'want': size_text}} END,
  CASE WHEN returned AND price_ambiguous THEN {{'field': 'price_ambiguous_flagged', 'ok': list_contains(got_flags, 'PRICE_AMBIGUOUS'), 'got': CASE WHEN list_contains(got_flags, 'PRICE_AMBIGUOUS') THEN 'PRICE_AMBIGUOUS' ELSE 'other' END, 'want': 'PRICE_AMBIGUOUS'}} END,
  CASE WHEN returned AND NOT price_ambiguous AND price IS NOT NULL THEN {{'field': 'price_parsed', 'ok': got_price = price, 'got': CAST(got_price AS VARCHAR), 'want': CAST(price AS VARCHAR)}} END]) AS s FROM compared),
scores AS (SELECT file, sheet, source_row, raw_item, s.field AS field, s.ok AS ok, s.got AS got, s.want AS want FROM scored WHERE s IS NOT NULL)"""
)


def _comparable(scores: DataFrame) -> DataFrame:
    # Which other flags an unflagged price carries depends on their order; not compared.
    other = (F.col("field") == "price_ambiguous_flagged") & (F.col("got") != "PRICE_AMBIGUOUS")
    return scores.withColumn("got", F.when(other, "other").otherwise(F.col("got")))


@query(
    "eval_scores",
    "WITH " + SCORE_SQL.strip() + " SELECT file, sheet, source_row, field, ok, got, want, raw_item AS raw FROM scores",
    NORM_TABLES,
)
def eval_scores(spark, sf):
    return _comparable(_scores(spark, sf))


@query(
    "eval_accuracy",
    "WITH " + SCORE_SQL.strip() + """
SELECT field, count(*) FILTER (WHERE ok) AS ok, count(*) AS total, CAST(round(count(*) FILTER (WHERE ok) * 100 / count(*)) AS INTEGER) AS percent
FROM scores GROUP BY GROUPING SETS ((field), ())""",
    NORM_TABLES,
)
def eval_accuracy(spark, sf):
    return evaluate.accuracy(_scores(spark, sf))


@query(
    "eval_misses",
    "WITH " + SCORE_SQL.strip() + " SELECT file, sheet, source_row, field, got, want, raw_item AS raw FROM scores WHERE NOT ok",
    NORM_TABLES,
)
def eval_misses(spark, sf):
    return evaluate.misses(_comparable(_scores(spark, sf)))


@query(
    "eval_guards",
    "WITH " + SCORE_SQL.strip() + """
SELECT 'unscored_field' AS guard, 'colour' AS subject FROM (SELECT 1 FROM labels_ WHERE colour_text IS NOT NULL AND (title_text <> '' OR category_text <> '') LIMIT 1)
UNION ALL SELECT 'single_valued_field', 'size' FROM (SELECT 1 FROM labels_ WHERE size_text IS NOT NULL AND (title_text <> '' OR category_text <> '') LIMIT 1)
UNION ALL SELECT 'provenance_missing', n_name FROM nation WHERE n_nationkey % 5 = 0""",
    NORM_TABLES,
)
def eval_guards(spark, sf):
    """A scorer that loses the colour field, labels with one size, half-filled provenance."""
    scores = _scores(spark, sf).where("field <> 'colour'")
    provenance = table(spark, sf, "nation").select(
        F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, "TODO: who").otherwise("a shop").alias("value")
    )
    return evaluate.eval_guards(_labels(spark, sf), scores, provenance)


@query(
    "eval_label_skeleton",
    """
SELECT file, sheet, "row" AS source_row, true AS blank FROM sheet_parts UNION ALL SELECT DISTINCT file, sheet, 1, true FROM sheet_parts WHERE NOT headed""",
    ("sheet_parts",),
)
def eval_label_skeleton(spark, sf):
    blank = (F.size("title") == 0) & (F.size("category") == 0) & F.col("colour").isNull() & (F.size("raw") > 0)
    return evaluate.label_skeleton(_data_rows(spark, sf)).select("file", "sheet", "source_row", blank.alias("blank"))


# Three providers read the labelled documents; each is wrong on other rows.
PROVIDERS = ["first", "second", "third"]
PROVIDER_SQL = """
SELECT provider, source AS file, lang AS sheet, CAST(d.doc_id AS BIGINT) AS source_row, quality,
  CASE WHEN (d.doc_id + provider_no) % 4 = 0 THEN 'other words' ELSE 'document ' || lang END AS title,
  (d.doc_id * provider_no) % 9 = 0 AS title_inferred
FROM {documents} AS d JOIN {labels} AS b ON d.doc_id = b.doc_id
JOIN (SELECT 'first' AS provider, 1 AS provider_no UNION ALL SELECT 'second', 2 UNION ALL SELECT 'third', 3) AS p ON b.quality >= 0"""


def _provider_scores(spark: SparkSession, sf: str) -> DataFrame:
    sql = PROVIDER_SQL.replace("JOIN (SELECT 'first' AS provider, 1 AS provider_no UNION ALL SELECT 'second', 2 UNION ALL SELECT 'third', 3) AS p ON b.quality >= 0",
                               "LATERAL VIEW inline(array(struct('first', 1), struct('second', 2), struct('third', 3))) p AS provider, provider_no")
    rows = spark.sql(sql, documents=table(spark, sf, "documents"), labels=table(spark, sf, "labels"))
    empty = F.array().cast("array<string>")
    labels = rows.select(
        "provider", "file", "sheet", "source_row", F.create_map(F.lit("doc"), F.col("source_row").cast("string")).alias("raw"),
        F.array(F.concat(F.lit("Document "), F.col("sheet"))).alias("title"), empty.alias("category"),
        F.lit(None).cast("array<string>").alias("colour"), F.lit(None).cast("array<string>").alias("size"),
        (F.col("quality") == 0).alias("title_inferred"), F.lit(False).alias("price_ambiguous"), F.lit(None).cast("bigint").alias("price"),
    )
    readings = rows.select(
        "provider", "file", "sheet", "source_row", F.lit(0).alias("ord"), "title", "title_inferred",
        F.create_map().cast("map<string,string>").alias("options"),
    )
    variants = rows.select(
        "provider", "file", "sheet", F.col("source_row").alias("row"), F.lit(0).alias("option_ord"),
        F.lit("unmapped").alias("category"), F.lit(0).cast("bigint").alias("price_minor"), F.array().cast("array<string>").alias("flags"),
    )
    return evaluate.score(labels, readings, variants, by=["provider"])


PROVIDER_SCORES_SQL = (
    "rows_ AS (" + PROVIDER_SQL.replace("{documents}", "documents").replace("{labels}", "labels") + """),
scores AS (SELECT provider, file, sheet, source_row, 'row_returned' AS field, true AS ok, 'ok' AS got FROM rows_
  UNION ALL SELECT provider, file, sheet, source_row, 'title', contains(title, 'document ' || sheet), title FROM rows_
  UNION ALL SELECT provider, file, sheet, source_row, 'title_inferred', title_inferred = (quality = 0), CAST(title_inferred AS VARCHAR) FROM rows_)"""
)


@query(
    "eval_bakeoff",
    "WITH " + PROVIDER_SCORES_SQL + " SELECT field, " + ", ".join(
        f"count(*) FILTER (WHERE provider = '{p}' AND ok) AS {p}_ok, count(*) FILTER (WHERE provider = '{p}') AS {p}_total" for p in PROVIDERS
    ) + " FROM scores GROUP BY 1",
)
def eval_bakeoff(spark, sf):
    return evaluate.bakeoff(_provider_scores(spark, sf), PROVIDERS)


@query(
    "eval_disagreements",
    "WITH " + PROVIDER_SCORES_SQL + """
SELECT file, sheet, source_row, field, count(*) FILTER (WHERE NOT ok) AS n_wrong, count(*) FILTER (WHERE ok) AS n_right,
  string_agg(provider || ':' || got, ',' ORDER BY provider) FILTER (WHERE NOT ok) AS wrong FROM scores GROUP BY ALL HAVING count(*) FILTER (WHERE NOT ok) > 0""",
)
def eval_disagreements(spark, sf):
    said = evaluate.disagreements(_provider_scores(spark, sf)).drop("want")
    return said.withColumn(
        "wrong", F.array_join(F.transform("wrong", lambda w: F.concat(w["provider"], F.lit(":"), w["got"])), ",")
    )


RUNS_SQL = """
SELECT c_mktsegment AS suite, c_custkey AS run_no, CAST(DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) AS STRING) AS run_date,
  'served_' || CAST(c_nationkey AS STRING) AS model_served, 'sha256_of_prompt_' || CAST(c_nationkey AS STRING) AS prompt_sha256,
  CAST(100 + c_custkey % 70 AS BIGINT) AS ok, CAST(170 AS BIGINT) AS total, CASE WHEN c_custkey % 4 = 0 THEN 'new prompt' ELSE '' END AS note FROM {customer}"""


@query(
    "eval_run_history",
    "WITH runs AS (" + RUNS_SQL.replace("{customer}", "customer") + """)
SELECT suite, row_number() OVER w AS run, run_date, model_served, prompt_sha256 AS prompt, ok, total, CAST(round(ok * 100 / total) AS INTEGER) AS percent,
  ok - lag(ok) OVER w AS ok_change, total - lag(total) OVER w AS total_change, note FROM runs WINDOW w AS (PARTITION BY suite ORDER BY run_no)""",
)
def eval_run_history(spark, sf):
    """Runs appended to a stored history in two steps, then reported."""
    folder = shared_folder(spark, "runs")
    runs = spark.sql(RUNS_SQL, customer=table(spark, sf, "customer"))
    append(runs.where("note = ''"), folder)
    append(runs.where("note <> ''"), folder)
    return evaluate.run_history(spark.read.parquet(folder))


CALLS_SQL = """
SELECT c_mktsegment AS provider, CASE c_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 25 WHEN 2 THEN 50 ELSE 100 END AS size,
  CAST(round(c_acctbal) AS BIGINT) + 10000 + (c_custkey % 4) * 7000 AS ms,
  CASE c_custkey % 13 WHEN 0 THEN 'HTTP 429: rate limit reached for the model, wait a little and try the very same call again later, please' WHEN 1 THEN 'socket hang up' ELSE NULL END AS error
FROM {customer}"""


@query(
    "eval_latency",
    "WITH calls AS (" + CALLS_SQL.replace("{customer}", "customer") + """),
sizes AS (SELECT provider, size, avg(ms) AS ms FROM calls WHERE error IS NULL GROUP BY ALL),
ends AS (SELECT provider, min(size) AS smallest, max(size) AS largest, arg_min(ms, size) AS ms_smallest, arg_max(ms, size) AS ms_largest,
  arg_min(size, ms / size) AS best_size, min(ms / size) AS best_ms_per_row FROM sizes GROUP BY 1)
SELECT *, (ms_largest / ms_smallest) / (largest / smallest) AS scaling, CASE WHEN (ms_largest / ms_smallest) / (largest / smallest) < 0.5 THEN 'per_call'
  WHEN (ms_largest / ms_smallest) / (largest / smallest) > 0.8 THEN 'per_row' ELSE 'mixed' END AS driver FROM ends""",
)
def eval_latency(spark, sf):
    return evaluate.latency_summary(spark.sql(CALLS_SQL, customer=table(spark, sf, "customer")))


@query(
    "eval_failure_reasons",
    "WITH calls AS (" + CALLS_SQL.replace("{customer}", "customer") + """)
SELECT error AS reason, sum(size)::BIGINT AS n_rows, count(*) AS n_calls FROM calls WHERE error IS NOT NULL GROUP BY 1""",
)
def eval_failure_reasons(spark, sf):
    return evaluate.failure_reasons(spark.sql(CALLS_SQL, customer=table(spark, sf, "customer")))
