"""Registered queries over cells, sheets, products and feeds, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, flags, money, options, quantity, text
from ..functions.fixed import CATEGORIES, FAILURE_PATTERNS, KNOWN_HEADERS, OTHER_FAILURE, UNITS
from ..operators import catalog, feed, grid, normalize
from ..session import shared_folder, written
from ..sources.cells import cells_from_arrays, read_cells
from ..sources.readings import read_extractions
from ..sources.tables import feed_digest, publish, read_feed, write_feed
from .checkout_queries import hmac_sql
from .tables import table, with_tables

STAMP = "2024-05-01 10:00:00"
HASH_KEY = "another key"

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, tables: tuple[str, ...] = ()):
    def add(build):
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = with_tables(check, *tables) if tables else check
        return build

    return add


# --- pieces of check SQL -------------------------------------------------------------
_S = r"[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim_sql(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{_S}+|{_S}+$', '', 'g')"


def fold_sql(c: str) -> str:
    return f"regexp_replace(lower({trim_sql(c)}), '{_S}+', ' ', 'g')"


def _minor_sql(token: str) -> str:
    short = f"replace(regexp_extract({token}, '(?i)^([\\d.,]+)\\s*k$', 1), ',', '')"
    plain = f"regexp_extract(replace({token}, ',', ''), '\\d+(?:\\.\\d+)?')"
    return (
        f"CASE WHEN regexp_matches({token}, '(?i)^[\\d.,]+\\s*k$') THEN CAST(round(try_cast({short} AS DECIMAL(28,10)) * 100000) AS BIGINT) "
        f"ELSE CAST(round(try_cast(nullif({plain}, '') AS DECIMAL(28,10)) * 100) AS BIGINT) END"
    )


def price_sql(source: str, column: str, name: str) -> str:
    """WITH items ending in `name`: `source` plus name_amount, name_compare, name_unit, name_flags."""
    n = name
    return f"""
{n}1 AS (SELECT *, {trim_sql(column)} AS {n}_t FROM {source}),
{n}2 AS (SELECT *, regexp_matches({n}_t, '(?i)^[^\\d]*[\\d.,]+\\s*(?:-|–|—|to)\\s*[\\d.,]+[^\\d]*$') AS {n}_range,
  nullif(regexp_extract({n}_t, '(?i)(?:/|\\bper\\b)\\s*([A-Za-z]+)', 1), '') AS {n}_unit,
  regexp_extract({n}_t, '(?i)^(.+?)\\s*[({{\\[]\\s*(?:MRP|M\\.R\\.P\\.?|List)?\\s*:?\\s*([\\d.,]+)\\s*[)}}\\]]$', 1) AS {n}_m1,
  regexp_extract({n}_t, '(?i)^(.+?)\\s*[({{\\[]\\s*(?:MRP|M\\.R\\.P\\.?|List)?\\s*:?\\s*([\\d.,]+)\\s*[)}}\\]]$', 2) AS {n}_m2 FROM {n}1),
{n}3 AS (SELECT *, CASE WHEN {n}_m1 <> '' THEN {n}_m1 ELSE {n}_t END AS {n}_tok FROM {n}2),
{n}4 AS (SELECT *, {_minor_sql(n + '_tok')} AS {n}_minor, {_minor_sql(n + '_m2')} AS {n}_ref FROM {n}3),
{n} AS (SELECT * EXCLUDE ({n}_m1, {n}_m2), CASE WHEN NOT {n}_range THEN {n}_minor END AS {n}_amount,
  CASE WHEN NOT {n}_range AND {n}_ref > {n}_minor THEN {n}_ref END AS {n}_compare,
  CASE WHEN {n}_t = '' THEN ['MISSING_REQUIRED_FIELD'] WHEN {n}_range THEN ['PRICE_AMBIGUOUS'] ELSE list_filter([
    CASE WHEN NOT regexp_matches({n}_t, '(?i)₹|\\bRs\\.?\\b|\\bINR\\b') THEN 'CURRENCY_ASSUMED' END,
    CASE WHEN {n}_minor IS NULL THEN 'MISSING_REQUIRED_FIELD' END,
    CASE WHEN {n}_minor IS NOT NULL AND NOT regexp_matches({n}_tok, '(?i)k$') AND regexp_matches(replace({n}_tok, ',', ''), '^\\D*\\d+\\.\\d\\d\\d*[1-9]') THEN 'PRICE_AMBIGUOUS' END,
    CASE WHEN {n}_minor < 100 OR {n}_minor > 100000000 THEN 'PRICE_OUT_OF_BAND' END], lambda x: x IS NOT NULL) END AS {n}_flags FROM {n}4)"""


UNITS_SQL = "(VALUES " + ", ".join(f"('{u}', '{d}', {f})" for u, (d, f) in UNITS.items()) + ") AS units(unit, dimension, factor)"
_Q = r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)"


def stock_sql(c: str) -> tuple[str, str]:
    t = trim_sql(c)
    count = f"CAST(nullif(regexp_extract({t}, '(?i)^(\\d+)\\s*(?:pcs?|pieces?|nos?\\.?|units?|qty)?$', 1), '') AS BIGINT)"
    out = r"(?i)\b(?:out\s*of\s*stock|sold\s*out|not\s*available|unavailable|no\s*stock|nil|none|finished)\b|^n$|^no$|^✗$|^x$|^✘$|^❌$"
    have = r"(?i)\b(?:in\s*stock|available|ready|yes|have|stock)\b|^y$|^✓$|^✔$|^☑$|^✅$"
    state = (
        f"CASE WHEN {count} > 0 THEN 'in_stock' WHEN {count} = 0 THEN 'out_of_stock' WHEN regexp_matches({t}, '{out}') THEN 'out_of_stock' "
        f"WHEN regexp_matches({t}, '{have}') THEN 'in_stock' ELSE 'unknown' END"
    )
    return state, count


def split_sql(c: str) -> str:
    t = trim_sql(c)
    parts = f"list_filter(list_transform(regexp_split_to_array({t}, '\\s*[,|;]\\s*|\\s*/\\s*'), lambda p: trim(p)), lambda p: p <> '')"
    return (
        f"CASE WHEN {t} = '' THEN CAST([] AS VARCHAR[]) WHEN len({parts}) < 2 THEN [{t}] "
        f"WHEN regexp_matches({t}, '\\S/\\S') AND len(list_filter({parts}, lambda p: regexp_matches(p, '\\s'))) > 0 THEN [{t}] ELSE {parts} END"
    )


# --- cells ----------------------------------------------------------------------------
@query(
    "cells_text",
    f"""
SELECT doc_id, line_no, {trim_sql('line')} AS text, {fold_sql('line')} AS dedupe_key, regexp_matches(line, '[\\x{{0900}}-\\x{{0DFF}}]') AS indic
FROM doc_lines""",
    ("doc_lines",),
)
def cells_text(spark, sf):
    return table(spark, sf, "doc_lines").select(
        "doc_id", "line_no", text.as_text("line").alias("text"), text.dedupe_key("line").alias("dedupe_key"),
        text.has_indic("line").alias("indic"),
    )


@query(
    "cells_price",
    "WITH " + price_sql("sheet_parts", "price_text", "p").strip() + """
SELECT p_partkey, p_amount AS amount_minor, p_compare AS compare_at_minor, p_unit AS rate_unit, array_to_string(p_flags, ',') AS flags FROM p""",
    ("sheet_parts",),
)
def cells_price(spark, sf):
    parsed = money.with_price(table(spark, sf, "sheet_parts"), "price_text", "price")
    return parsed.select(
        "p_partkey", "price.amount_minor", "price.compare_at_minor", "price.rate_unit",
        F.array_join("price.flags", ",").alias("flags"),
    )


@query(
    "cells_to_minor",
    f"SELECT p_partkey, {_minor_sql('price_text')} AS minor FROM sheet_parts",
    ("sheet_parts",),
)
def cells_to_minor(spark, sf):
    return table(spark, sf, "sheet_parts").select("p_partkey", money.to_minor(F.col("price_text"))["minor"].alias("minor"))


@query(
    "cells_price_of_prose",
    "WITH " + price_sql("doc_lines", "line", "p").strip() + """
SELECT doc_id, line_no, p_range AS is_range, p_unit AS rate_unit, p_minor IS NOT NULL AS has_number FROM p""",
    ("doc_lines",),
)
def cells_price_of_prose(spark, sf):
    return table(spark, sf, "doc_lines").select(
        "doc_id", "line_no", money.is_price_range("line").alias("is_range"), money.rate_unit("line").alias("rate_unit"),
        money.to_minor(money.split_reference("line")["token"])["minor"].isNotNull().alias("has_number"),
    )


@query(
    "cells_split_reference",
    "WITH " + price_sql("sheet_parts", "price_text", "p").strip() + """
SELECT p_partkey, p_tok AS token, CASE WHEN p_tok <> p_t THEN regexp_extract(p_t, '([\\d.,]+)\\s*[)}\\]]$', 1) END AS reference FROM p""",
    ("sheet_parts",),
)
def cells_split_reference(spark, sf):
    found = table(spark, sf, "sheet_parts").withColumn("r", money.split_reference("price_text"))
    return found.select("p_partkey", "r.token", "r.reference")


_QUANTITY_SQL = f"""
SELECT k, u.dimension, CAST(try_cast(number AS DECIMAL(18,3)) * u.factor AS DOUBLE) AS base FROM
(SELECT {{key}} AS k, regexp_extract(replace({{text}}, ',', ''), '{_Q}', 1) AS number, lower(regexp_extract(replace({{text}}, ',', ''), '{_Q}', 2)) AS name FROM {{source}}) AS q
LEFT JOIN {UNITS_SQL.replace('AS units(', 'AS u(')} ON u.unit = q.name"""


@query(
    "cells_quantity",
    _QUANTITY_SQL.format(key="p_partkey", text="pack_text", source="sheet_parts"),
    ("sheet_parts",),
)
def cells_quantity(spark, sf):
    q = table(spark, sf, "sheet_parts").select(F.col("p_partkey").alias("k"), quantity.parse_quantity("pack_text").alias("q"))
    return q.select("k", "q.dimension", F.col("q.base").cast("double").alias("base"))


@query(
    "cells_measure_rate",
    "WITH " + price_sql("sheet_parts", "price_text", "p").strip() + f"""
SELECT p_partkey, p_unit AS rate_unit, u.dimension, CAST(u.factor AS DOUBLE) AS base
FROM p LEFT JOIN {UNITS_SQL.replace('AS units(', 'AS u(')} ON u.unit = lower(p_unit)""",
    ("sheet_parts",),
)
def cells_measure_rate(spark, sf):
    unit = table(spark, sf, "sheet_parts").select("p_partkey", money.rate_unit("price_text").alias("rate_unit"))
    return unit.withColumn("m", quantity.measure_rate("rate_unit")).select(
        "p_partkey", "rate_unit", "m.dimension", F.col("m.base").cast("double").alias("base")
    )


@query(
    "cells_stock",
    f"SELECT p_partkey, {stock_sql('stock_text')[0]} AS availability, {stock_sql('stock_text')[1]} AS inventory_count FROM sheet_parts",
    ("sheet_parts",),
)
def cells_stock(spark, sf):
    return table(spark, sf, "sheet_parts").withColumn("s", quantity.parse_stock("stock_text")).select("p_partkey", "s.*")


@query(
    "cells_split_list",
    f"""
SELECT source_row, file, sheet, ord, array_to_string({split_sql('size')}, '#') AS sizes, len({split_sql('size')}) AS n_sizes,
  array_to_string({split_sql('colour')}, '#') AS colours FROM readings""",
    ("readings",),
)
def cells_split_list(spark, sf):
    return table(spark, sf, "readings").select(
        "source_row", "file", "sheet", "ord", F.array_join(options.split_list("size"), "#").alias("sizes"),
        F.size(options.split_list("size")).cast("bigint").alias("n_sizes"),
        F.array_join(options.split_list("colour"), "#").alias("colours"),
    )


@query(
    "cells_ids",
    f"""
SELECT c_custkey, 'var_' || substr(sha256(c_name || ' ' || c_mktsegment || ' ' || c_nationkey), 1, 16) AS stable_id,
  'job_' || substr(sha256('mer_' || c_nationkey || ' ' || c_name || ' ' || c_custkey), 1, 16) AS job_id,
  'feed_' || c_nationkey AS feed_id, sha256(c_name) AS digest, {hmac_sql('c_name', HASH_KEY)} AS keyed,
  regexp_matches(c_mktsegment, '^[A-Za-z0-9_-]{{1,64}}$') AS feed_id_ok, regexp_matches(c_name, '^[A-Za-z0-9_-]{{1,64}}$') AS merchant_id_ok,
  nullif(regexp_extract('order_' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '-x' ELSE 'Ab' END, '^(?:[a-z]+_)?([A-Za-z0-9]+)$', 1), '') AS canonical_id
FROM customer""",
)
def cells_ids(spark, sf):
    tail = F.when(F.col("c_custkey") % 3 == 0, "-x").otherwise("Ab")
    order = F.concat(F.lit("order_"), F.col("c_custkey").cast("string"), tail)
    merchant = F.concat(F.lit("mer_"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select(
        "c_custkey", digest.stable_id("var", "c_name", "c_mktsegment", "c_nationkey").alias("stable_id"),
        digest.job_id(merchant, "c_name", "c_custkey").alias("job_id"), digest.feed_id(merchant).alias("feed_id"),
        digest.sha256_hex("c_name").alias("digest"), digest.hmac_sha256("c_name", HASH_KEY).alias("keyed"),
        text.valid_feed_id("c_mktsegment").alias("feed_id_ok"), text.valid_merchant_id("c_name").alias("merchant_id_ok"),
        text.canonical_id(order).alias("canonical_id"),
    )


_ASKED = """SELECT c_custkey, kind, CASE c_custkey % 5 WHEN 0 THEN upper(id) WHEN 1 THEN id || '/..' WHEN 2 THEN substr(id, 2) ELSE id END AS id FROM (
  SELECT c_custkey, 'job' AS kind, 'job_' || substr(sha256(c_name), 1, 16) AS id FROM customer UNION ALL
  SELECT c_custkey, 'session', 'cs_' || substr(sha256(c_name), 1, 24) FROM customer UNION ALL
  SELECT c_custkey, 'feed', 'feed_' || c_name FROM customer UNION ALL SELECT c_custkey, 'merchant', replace(c_name, '#', '-') FROM customer)"""


@query(
    "cells_id_shapes",
    f"""
SELECT c_custkey, kind, id, CASE kind WHEN 'job' THEN regexp_matches(id, '^job_[0-9a-f]{{16}}$') WHEN 'session' THEN regexp_matches(id, '^cs_[0-9a-f]{{24}}$')
  ELSE regexp_matches(id, '^[A-Za-z0-9_-]{{1,64}}$') END AS admitted FROM ({_ASKED})""",
)
def cells_id_shapes(spark, sf):
    """Ids as requests name them: admitted to storage by their shape, or turned away."""
    hashed = lambda n: F.left(F.sha2("c_name", 256), F.lit(n))
    asked = {
        "job": F.concat(F.lit("job_"), hashed(16)), "session": F.concat(F.lit("cs_"), hashed(24)),
        "feed": F.concat(F.lit("feed_"), "c_name"), "merchant": F.replace("c_name", F.lit("#"), F.lit("-")),
    }
    rules = {"job": text.valid_job_id, "session": text.valid_session_id, "feed": text.valid_feed_id, "merchant": text.valid_merchant_id}
    spoilt = lambda c: F.when(F.col("c_custkey") % 5 == 0, F.upper(c)).when(F.col("c_custkey") % 5 == 1, F.concat(c, F.lit("/.."))).when(
        F.col("c_custkey") % 5 == 2, F.substring(c, 2, 1000)).otherwise(c)
    ids = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), spoilt(c).alias("id")) for k, c in asked.items()))).alias("x")
    named = table(spark, sf, "customer").select("c_custkey", ids).select("c_custkey", "x.*")
    admitted = F.lit(False)
    for kind, rule in rules.items():
        admitted = F.when(F.col("kind") == kind, rule("id")).otherwise(admitted)
    return named.withColumn("admitted", admitted)


@query(
    "cells_report_forms",
    """
SELECT o_orderkey, '₹' || (minor // 100) || '.' || lpad(CAST(minor % 100 AS VARCHAR), 2, '0') AS money,
  strftime(o_orderdate + INTERVAL 330 MINUTE, '%d %b, %I:%M ') || CASE WHEN hour(o_orderdate + INTERVAL 330 MINUTE) < 12 THEN 'AM' ELSE 'PM' END AS stamp
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS minor FROM orders)""",
)
def cells_report_forms(spark, sf):
    minor = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf, "orders").select(
        "o_orderkey", text.format_minor(minor).alias("money"), text.local_stamp("o_orderdate").alias("stamp")
    )


@query(
    "cells_urls",
    """
SELECT page_id, 0 AS variation, true AS absolute FROM pages WHERE regexp_matches(url, '^https?://[^/]+')
UNION ALL SELECT page_id, 0, false FROM pages WHERE NOT regexp_matches(url, '^https?://[^/]+')
UNION ALL SELECT page_id, 1, false FROM pages UNION ALL SELECT page_id, 2, false FROM pages""",
)
def cells_urls(spark, sf):
    relative = F.regexp_replace("url", "^https?:/", "")
    ftp = F.regexp_replace("url", "^https?", "ftp")
    forms = table(spark, sf, "pages").select("page_id", F.posexplode(F.array("url", relative, ftp)).alias("variation", "u"))
    return forms.select("page_id", "variation", text.is_absolute_url("u").alias("absolute"))


@query(
    "cells_labels",
    """
SELECT doc_id, line_no, upper(spaced[1:1]) || spaced[2:] AS label FROM (SELECT doc_id, line_no,
  trim(regexp_replace(regexp_replace(lower(regexp_extract(line, '[A-Za-z]+[ _-][A-Za-z]+')), ' ', '_', 'g'), '[_-]+', ' ', 'g')) AS spaced FROM doc_lines)""",
    ("doc_lines",),
)
def cells_labels(spark, sf):
    key = F.regexp_replace(F.lower(F.regexp_extract("line", "[A-Za-z]+[ _-][A-Za-z]+", 0)), " ", "_")
    return table(spark, sf, "doc_lines").select("doc_id", "line_no", text.label(key).alias("label"))


@query(
    "cells_failure_codes",
    f"""
SELECT batch_index, ord, CASE {' '.join(f"WHEN regexp_matches(error, '{p}') THEN '{c}'" for p, c in FAILURE_PATTERNS)} ELSE '{OTHER_FAILURE}' END AS code
FROM outcomes WHERE error IS NOT NULL""",
    ("outcomes",),
)
def cells_failure_codes(spark, sf):
    return table(spark, sf, "outcomes").where("error IS NOT NULL").select(
        "batch_index", "ord", text.classify_failure("error").alias("code")
    )


# --- sheets -----------------------------------------------------------------------------
def _cells(spark: SparkSession, sf: str, name: str = "sheet_cells") -> DataFrame:
    return table(spark, sf, name).withColumn("master_row", F.lit(None).cast("int"))


def _sheets(spark: SparkSession, sf: str):
    return grid.structure_sheets(_cells(spark, sf), table(spark, sf, "merges"))


PROFILE_SQL = f"""
cleaned AS (SELECT file, sheet, "row", col, {trim_sql('text')} AS t FROM {{source}}),
profile AS (SELECT file, sheet, "row", count(*) FILTER (WHERE t <> '') AS n_filled, coalesce(bool_or(regexp_matches(t, '[0-9]')), false) AS has_digits,
  arg_min(t, col) FILTER (WHERE t <> '') AS first_text, coalesce(max(col) FILTER (WHERE t <> ''), 0) AS width FROM cleaned GROUP BY ALL),
following AS (SELECT *, lead(has_digits) OVER (PARTITION BY file, sheet ORDER BY "row") AS next_digits FROM profile WHERE n_filled > 0),
found AS (SELECT file, sheet, min("row") AS header_row FROM following WHERE "row" <= 15 AND n_filled >= 2 AND NOT has_digits AND next_digits GROUP BY ALL),
sheets AS (SELECT p.file, p.sheet, f.header_row, p.max_width, p.height FROM
  (SELECT file, sheet, max(width) AS max_width, max("row") AS height FROM profile GROUP BY ALL) p LEFT JOIN found f USING (file, sheet)),
names AS (SELECT s.file, s.sheet, c.col, c.t AS name FROM sheets s JOIN profile p ON p.file = s.file AND p.sheet = s.sheet AND p."row" = s.header_row
  JOIN cleaned c ON c.file = s.file AND c.sheet = s.sheet AND c."row" = s.header_row AND c.col <= p.width)"""
_JUNK_SQL = (
    r"(?i)^(?:grand\s+)?(?:sub\s*)?total\b|^\*+|^-{3,}|^note\b|^n\.?b\.?\b|\bcontact\b|^call\b|\bgst\b|subject\s+to\s+change|^terms\b"
    r"|^conditions\b|\bwhatsapp\b|^address\b|(?:\+?91[-\s]?)?\b\d{5}\s?\d{5}\b|\b\d{10}\b"
)
CLASSIFY_SQL = f"""
classified AS (SELECT p.*, s.header_row, CASE WHEN p."row" < s.header_row THEN 'preamble' WHEN p."row" = s.header_row THEN 'header'
  WHEN n_filled = 0 THEN 'blank' WHEN regexp_matches(coalesce(first_text, ''), '{_JUNK_SQL}') THEN 'junk' END AS reason
  FROM profile p JOIN sheets s USING (file, sheet))"""


@query(
    "cells_read_back",
    f"""
SELECT fmt, file, sheet, "row", col, {trim_sql('text')} AS text, "row" AS master_row
FROM sheet_cells, (SELECT unnest(['parquet', 'csv', 'json']) AS fmt) f""",
    ("sheet_cells",),
)
def cells_read_back(spark, sf):
    """The cell table stored in every readable format and read again."""
    stored = _cells(spark, sf).withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int"))
    parts = []
    for fmt in ("parquet", "csv", "json"):
        folder = shared_folder(spark, f"cells-{fmt}")
        stored.write.options(header="true", escape='"').format(fmt).save(folder)
        parts.append(read_cells(spark, folder, fmt, line_breaks=True).withColumn("fmt", F.lit(fmt)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "cells_of_arrays",
    f"""
SELECT 'documents' AS file, source AS sheet, CAST(doc_id AS INTEGER) AS "row", CAST(i AS INTEGER) AS col, {trim_sql('v')} AS text, CAST(doc_id AS INTEGER) AS master_row
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
)
def cells_of_arrays(spark, sf):
    """Rows that come as arrays of values: the lines of every document as the cells of one row."""
    rows = table(spark, sf, "documents").select(
        F.lit("documents").alias("file"), F.col("source").alias("sheet"), F.col("doc_id").alias("row"), F.split("text", "\n").alias("values")
    )
    return cells_from_arrays(rows)


@query(
    "grid_fill_merges",
    """
SELECT c.file, c.sheet, c."row", c.col, coalesce(m.text, c.text) AS text, coalesce(m.r1, c."row") AS master_row FROM sheet_cells c
LEFT JOIN (SELECT g.*, t.text FROM merges g JOIN sheet_cells t ON t.file = g.file AND t.sheet = g.sheet AND t."row" = g.r1 AND t.col = g.c1) m
  ON m.file = c.file AND m.sheet = c.sheet AND c."row" BETWEEN m.r1 AND m.r2 AND c.col BETWEEN m.c1 AND m.c2""",
    ("sheet_cells", "merges"),
)
def grid_fill_merges(spark, sf):
    return grid.fill_merges(_cells(spark, sf), table(spark, sf, "merges"))


@query(
    "grid_row_profile",
    "WITH " + PROFILE_SQL.replace("{source}", "doc_cells").strip() + """
SELECT file, sheet, "row", CAST(n_filled AS INTEGER) AS n_filled, has_digits, first_text, width FROM profile""",
    ("doc_cells",),
)
def grid_row_profile(spark, sf):
    return grid.row_profile(_cells(spark, sf, "doc_cells")).drop("row_cells")


def _header_check(source: str) -> str:
    known = ", ".join(f"'{h}'" for h in KNOWN_HEADERS)
    return (
        "WITH " + PROFILE_SQL.replace("{source}", source).strip() + f"""
SELECT s.file, s.sheet, s.header_row, coalesce(string_agg(n.name, '|' ORDER BY n.col), CASE WHEN s.header_row IS NULL AND max(s.max_width) > 0
    THEN array_to_string(list_transform(generate_series(1, max(s.max_width)), lambda i: 'col_' || i), '|') ELSE '' END) AS headers,
  coalesce(avg(CASE WHEN lower(n.name) IN ({known}) THEN 1.0 ELSE 0.0 END) FILTER (WHERE n.name <> ''), 0) AS header_score, max(s.height) AS height
FROM sheets s LEFT JOIN names n USING (file, sheet) GROUP BY s.file, s.sheet, s.header_row"""
    )


def _headers(spark, sf, name):
    headers = grid.sheet_headers(grid.row_profile(_cells(spark, sf, name)))
    return headers.withColumn("headers", F.array_join("headers", "|"))


@query("grid_headers_of_sheets", _header_check("sheet_cells"), ("sheet_cells",))
def grid_headers_of_sheets(spark, sf):
    return _headers(spark, sf, "sheet_cells")


@query("grid_headers_of_prose", _header_check("doc_cells"), ("doc_cells",))
def grid_headers_of_prose(spark, sf):
    return _headers(spark, sf, "doc_cells")


@query(
    "grid_skipped_rows",
    "WITH " + PROFILE_SQL.replace("{source}", "sheet_cells").strip() + "," + CLASSIFY_SQL + """
SELECT file, sheet, "row", reason FROM classified WHERE reason IN ('preamble', 'blank', 'junk')
UNION ALL SELECT s.file, s.sheet, g."row", CASE WHEN g."row" < s.header_row THEN 'preamble' ELSE 'blank' END FROM sheets s,
  LATERAL (SELECT CAST(unnest(generate_series(1, s.height)) AS INTEGER) AS "row") g
  WHERE NOT EXISTS (SELECT 1 FROM profile p WHERE p.file = s.file AND p.sheet = s.sheet AND p."row" = g."row")""",
    ("sheet_cells",),
)
def grid_skipped_rows(spark, sf):
    return _sheets(spark, sf)[2]


@query(
    "grid_classes_of_prose",
    "WITH " + PROFILE_SQL.replace("{source}", "doc_cells").strip() + "," + CLASSIFY_SQL + """
SELECT file, sheet, coalesce(reason, 'data') AS reason, count(*) AS n_rows FROM classified GROUP BY ALL""",
    ("doc_cells",),
)
def grid_classes_of_prose(spark, sf):
    profile = grid.row_profile(_cells(spark, sf, "doc_cells"))
    classes = grid.classify_rows(profile, grid.sheet_headers(profile))
    return classes.groupBy("file", "sheet", F.coalesce("reason", F.lit("data")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "grid_rows_of_prose",
    "WITH " + PROFILE_SQL.replace("{source}", "doc_cells").strip() + "," + CLASSIFY_SQL + """,
keyed AS (SELECT c.file, c.sheet, c."row", c.col, c.t, coalesce(nullif(n.name, ''), 'col_' || c.col) AS key
  FROM cleaned c JOIN classified k USING (file, sheet, "row") LEFT JOIN names n ON n.file = c.file AND n.sheet = c.sheet AND n.col = c.col
  WHERE k.reason IS NULL AND c.t <> ''),
last AS (SELECT file, sheet, "row", key, arg_max(t, col) AS t FROM keyed GROUP BY ALL),
joined AS (SELECT file, sheet, "row", string_agg(key || '=' || t, ';' ORDER BY key) AS cells FROM last GROUP BY ALL)
SELECT k.file, k.sheet, k."row", md5(j.cells) AS cells, CAST(k.width AS INTEGER) AS n_values FROM classified k JOIN joined j USING (file, sheet, "row") WHERE k.reason IS NULL""",
    ("doc_cells",),
)
def grid_rows_of_prose(spark, sf):
    profile = grid.row_profile(_cells(spark, sf, "doc_cells"))
    rows = grid.assemble_rows(grid.classify_rows(profile, grid.sheet_headers(profile)))
    entries = F.transform(F.array_sort(F.map_entries("cells")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(
        "file", "sheet", "row", F.md5(F.array_join(entries, ";")).alias("cells"), F.size("values").alias("n_values")
    )


def _data_rows(spark: SparkSession, sf: str) -> DataFrame:
    number = F.substr("sheet", F.lit(7)).cast("bigint")
    return _sheets(spark, sf)[1].withColumn(
        "merchant_id", F.concat(F.lit("mer_"), (number % 7).cast("string"))
    )


@query(
    "grid_duplicates",
    f"""
WITH named AS (SELECT *, {fold_sql('item')} AS key, CASE WHEN sheet_no % 3 = 0 THEN first_value(kind) OVER (PARTITION BY sheet ORDER BY "row") ELSE kind END AS shown
  FROM sheet_parts WHERE headed),
stated AS (SELECT file, key, unnest([{{'f': 'Type', 'v': shown}}, {{'f': 'Price', 'v': {trim_sql('price_text')}}}, {{'f': 'MRP', 'v': listed_text}},
  {{'f': 'Stock', 'v': CASE WHEN stocked THEN stock_text ELSE '' END}}, {{'f': 'Pack Size', 'v': pack_text}}]) AS s FROM named),
fields AS (SELECT file, key, s.f AS field FROM stated WHERE s.v <> '' GROUP BY ALL HAVING count(DISTINCT s.v) > 1),
sizes AS (SELECT file, key, count(*) AS n_rows FROM named GROUP BY ALL HAVING count(*) > 1)
SELECT file, key, n_rows, coalesce(string_agg(field, ',' ORDER BY field), '') AS conflicting FROM sizes LEFT JOIN fields USING (file, key) GROUP BY ALL""",
    ("sheet_parts",),
)
def grid_duplicates(spark, sf):
    groups, _ = grid.find_duplicates(_data_rows(spark, sf), "Item", ["file"])
    return groups.withColumn("conflicting", F.array_join("conflicting", ","))


@query(
    "grid_chunks",
    """
SELECT source_row, job_id, CAST((row_number() OVER (PARTITION BY job_id ORDER BY source_row) - 1) // 10 AS INTEGER) AS batch_index
FROM (SELECT DISTINCT job_id, source_row FROM job_rows)""",
    ("job_rows",),
)
def grid_chunks(spark, sf):
    rows = table(spark, sf, "job_rows").select("job_id", "source_row").distinct()
    return grid.chunk(rows, ["job_id"], "source_row", 10)


@query(
    "grid_roles",
    """
SELECT DISTINCT file, sheet, CASE WHEN headed THEN 'Price' END AS price_field, CASE WHEN headed THEN 'MRP' END AS list_price_field,
  CASE WHEN headed AND stocked THEN 'Stock' END AS stock_field, CASE WHEN headed THEN 'Pack Size' END AS pack_size_field FROM sheet_parts""",
    ("sheet_parts",),
)
def grid_roles(spark, sf):
    return grid.with_roles(_sheets(spark, sf)[0]).select(
        "file", "sheet", "price_field", "list_price_field", "stock_field", "pack_size_field"
    )


@query(
    "cells_semantic",
    """
SELECT file, sheet, "row", CASE WHEN headed THEN array_to_string(list_filter(['Item=' || trim(item), 'Pack Size=' || nullif(pack_text, ''), 'Type=' || shown], lambda x: x IS NOT NULL), ';')
  ELSE array_to_string(list_filter(['col_1=' || trim(item), 'col_2=' || shown, 'col_3=' || trim(price_text), 'col_4=' || nullif(listed_text, ''),
    'col_5=' || nullif(CASE WHEN stocked THEN stock_text ELSE pack_text END, ''), 'col_6=' || nullif(CASE WHEN stocked THEN pack_text ELSE '' END, '')], lambda x: x IS NOT NULL), ';') END AS cells
FROM (SELECT *, CASE WHEN sheet_no % 3 = 0 THEN first_value(kind) OVER (PARTITION BY sheet ORDER BY "row") ELSE kind END AS shown FROM sheet_parts)
UNION ALL SELECT DISTINCT file, sheet, 1, 'col_1=Price list' FROM sheet_parts WHERE NOT headed""",
    ("sheet_parts",),
)
def cells_semantic(spark, sf):
    rows = grid.with_roles(_data_rows(spark, sf))
    consumed = F.array_compact(F.array("price_field", "list_price_field", "stock_field"))
    kept = rows.withColumn("kept", options.semantic_cells("cells", consumed))
    entries = F.transform(F.array_sort(F.map_entries("kept")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return kept.select("file", "sheet", "row", F.array_join(entries, ";").alias("cells"))


# --- readings ------------------------------------------------------------------------------
def _readings(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).alias("value"))
    return table(spark, sf, "readings").withColumn(
        "options", options.pairs_to_map(F.array(pair("Colour", "colour"), pair("Size", "size")))
    ).withColumn("attributes", options.pairs_to_map(F.array(pair("inner_material", "material"))))


BATCH_SQL = """
wire AS (SELECT file, sheet, source_row, ord, sheet_key, title, category, CASE WHEN sheet_key % 6 = 1 AND source_row = 5 THEN 1.5 ELSE confidence END AS conf,
  sheet_key % 6 AS kind FROM (SELECT *, CAST(substr(sheet, 7) AS BIGINT) AS sheet_key FROM readings)),
verdict AS (SELECT file, sheet, kind = 0 AS broken, min(CASE WHEN category NOT IN ({cats}) THEN source_row END) AS bad_category,
  min(CASE WHEN conf > 1 THEN source_row END) AS bad_conf, any_value(kind) AS kind FROM wire GROUP BY file, sheet, kind)"""
_BATCH_CHECK = BATCH_SQL.replace("{cats}", ", ".join(f"'{c}'" for c in CATEGORIES))


def _batches(spark, sf):
    """One JSON payload per sheet; some are cut off, some hold a row outside the schema."""
    key = F.substr("sheet", F.lit(7)).cast("bigint")
    pair = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).alias("value"))
    rows = table(spark, sf, "readings").withColumn("kind", key % 6)
    conf = F.when((F.col("kind") == 1) & (F.col("source_row") == 5), 1.5).otherwise(F.col("confidence").cast("double"))
    wire = F.struct(
        "source_row", "title", "title_inferred", "category", F.col("category_confidence").cast("double").alias("category_confidence"),
        F.array(pair("Colour", "colour"), pair("Size", "size")).alias("options"),
        F.array(pair("inner_material", "material")).alias("attributes"), "brand", "description", "variant_group", conf.alias("confidence"),
    )
    body = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("source_row", "ord", wire.alias("w")))), lambda e: e["w"]).alias("rows")),
                     {"ignoreNullFields": "false"})
    return rows.groupBy("file", "sheet", "kind").agg(body.alias("payload")).withColumn(
        "payload", F.when(F.col("kind") == 0, F.left("payload", F.length("payload") - 2)).otherwise(F.col("payload"))
    ).drop("kind")


@query(
    "readings_valid",
    "WITH " + _BATCH_CHECK.strip() + """
SELECT r.file, r.sheet, CAST(r.source_row AS INTEGER) AS source_row, r.title, r.category, CASE WHEN r.colour <> '' THEN r.colour END AS colour, r.brand, r.variant_group
FROM readings r JOIN verdict v USING (file, sheet) WHERE NOT broken AND bad_category IS NULL AND bad_conf IS NULL""",
    ("readings",),
)
def readings_valid(spark, sf):
    valid, _ = read_extractions(_batches(spark, sf), ["file", "sheet"])
    return valid.select(
        "file", "sheet", "source_row", "title", "category", F.try_element_at("options", F.lit("Colour")).alias("colour"), "brand", "variant_group"
    )


@query(
    "readings_rejected",
    "WITH " + _BATCH_CHECK.strip() + """
SELECT file, sheet, CASE WHEN broken THEN 'extraction was not valid JSON' WHEN bad_category IS NOT NULL AND (bad_conf IS NULL OR bad_category <= bad_conf)
  THEN 'extraction failed schema validation: category must be equal to one of the allowed values'
  ELSE 'extraction failed schema validation: confidence must be number between 0 and 1' END AS reason
FROM verdict WHERE broken OR bad_category IS NOT NULL OR bad_conf IS NOT NULL""",
    ("readings",),
)
def readings_rejected(spark, sf):
    return read_extractions(_batches(spark, sf), ["file", "sheet"])[1]


# --- normalisation ----------------------------------------------------------------------------
def _variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = grid.with_roles(_data_rows(spark, sf)).drop("values", "inherited")
    return normalize.variants(rows, _readings(spark, sf))


_ROWS_SQL = """
shown AS (SELECT *, CASE WHEN sheet_no % 3 = 0 THEN first_value(kind) OVER (PARTITION BY sheet ORDER BY "row") ELSE kind END AS type_text,
  CASE WHEN headed THEN price_text END AS use_price, CASE WHEN headed THEN listed_text END AS use_listed,
  CASE WHEN headed AND stocked THEN stock_text END AS use_stock, CASE WHEN headed THEN pack_text END AS use_pack,
  headed AND stocked AS has_stock FROM sheet_parts),"""
NORM_SQL = (
    _ROWS_SQL
    + price_sql("shown", "use_price", "p").strip() + "," + price_sql("p", "use_listed", "l").strip()
    + f""",
measured AS (SELECT x.*, u.dimension AS pack_dimension, try_cast(pack_number AS DECIMAL(18,3)) * u.factor AS pack_base, v.dimension AS rate_dimension, v.factor AS rate_base,
  {stock_sql('use_stock')[0]} AS availability, {stock_sql('use_stock')[1]} AS inventory_count
  FROM (SELECT *, regexp_extract(replace(coalesce(use_pack, ''), ',', ''), '{_Q}', 1) AS pack_number, lower(regexp_extract(replace(coalesce(use_pack, ''), ',', ''), '{_Q}', 2)) AS pack_unit FROM l) x
  LEFT JOIN {UNITS_SQL.replace('AS units(', 'AS u(')} ON u.unit = x.pack_unit LEFT JOIN {UNITS_SQL.replace('AS units(', 'AS v(')} ON v.unit = lower(x.p_unit)),
read AS (SELECT DISTINCT * EXCLUDE (ord) FROM readings),
joined AS (SELECT m.*, r.title, r.title_inferred, r.category AS said, r.category_confidence, r.colour, r.size, r.material, r.brand, r.description, r.variant_group, r.confidence,
  CASE WHEN r.category IN ({', '.join(f"'{c}'" for c in CATEGORIES)}) THEN r.category ELSE 'unmapped' END AS category,
  {split_sql('r.colour')} AS colours, {split_sql('r.size')} AS sizes,
  array_to_string(list_sort(list_filter(CASE WHEN headed THEN ['item=' || {fold_sql('item')}, 'type=' || {fold_sql('type_text')}, CASE WHEN pack_text <> '' THEN 'pack size=' || {fold_sql('pack_text')} END]
    ELSE ['col_1=' || {fold_sql('item')}, 'col_2=' || {fold_sql('type_text')}, 'col_3=' || {fold_sql('price_text')}, CASE WHEN listed_text <> '' THEN 'col_4=' || {fold_sql('listed_text')} END,
      CASE WHEN (CASE WHEN stocked THEN stock_text ELSE pack_text END) <> '' THEN 'col_5=' || {fold_sql('CASE WHEN stocked THEN stock_text ELSE pack_text END')} END,
      CASE WHEN stocked AND pack_text <> '' THEN 'col_6=' || {fold_sql('pack_text')} END] END, lambda x: x IS NOT NULL)), ';') AS identity
  FROM measured m JOIN read r ON r.file = m.file AND r.sheet = m.sheet AND r.source_row = m."row"),
axes AS (SELECT *, CASE WHEN len(colours) = 0 THEN [NULL] ELSE colours END AS ca, CASE WHEN len(sizes) = 0 THEN [NULL] ELSE sizes END AS sa FROM joined),
combos AS (SELECT *, ca[1 + CAST(option_ord // len(sa) AS BIGINT)] AS c1, sa[1 + CAST(option_ord % len(sa) AS BIGINT)] AS s1
  FROM (SELECT *, unnest(generate_series(0, len(ca) * len(sa) - 1)) AS option_ord FROM axes)),
extracted AS (SELECT merchant_id, file, sheet, "row", option_ord, coalesce(variant_group, '__row_' || "row") AS product_key,
  'var_' || substr(sha256(merchant_id || ' ' || identity || ' ' || array_to_string(list_filter(['Colour=' || c1, 'Size=' || s1], lambda x: x IS NOT NULL), ';')), 1, 16) AS variant_id,
  title || CASE WHEN c1 IS NULL AND s1 IS NULL THEN '' ELSE ' - ' || array_to_string(list_filter([c1, s1], lambda x: x IS NOT NULL), ' / ') END AS title,
  category, CASE WHEN said <> category THEN said END AS category_raw, coalesce(p_amount, 0) AS price_minor, coalesce(l_amount, p_compare) AS compare_at_minor,
  availability, inventory_count, confidence, title AS base_title, title_inferred, brand, description, material, c1, s1,
  list_sort(list_distinct(list_filter(list_concat(p_flags, [CASE WHEN category = 'unmapped' OR category_confidence < 0.7 THEN 'CATEGORY_UNMAPPED' END,
    CASE WHEN title_inferred THEN 'TITLE_INFERRED' END, CASE WHEN confidence < 0.6 OR p_amount IS NULL THEN
      CASE WHEN confidence < 0.6 OR NOT list_contains(p_flags, 'MISSING_REQUIRED_FIELD') THEN 'MISSING_REQUIRED_FIELD' END END,
    CASE WHEN availability = 'unknown' THEN CASE WHEN has_stock THEN 'STOCK_UNKNOWN' ELSE 'STOCK_NOT_TRACKED' END END,
    CASE WHEN rate_dimension IS NOT NULL AND pack_dimension IS NOT NULL AND (rate_dimension <> pack_dimension OR pack_base < rate_base) THEN 'PRICE_AMBIGUOUS' END,
    CASE WHEN regexp_matches(item, '[\\x{{0900}}-\\x{{0DFF}}]') THEN 'MULTILINGUAL_SOURCE' END, CASE WHEN len(ca) * len(sa) > 1 THEN 'VARIANTS_SPLIT' END]), lambda x: x IS NOT NULL))) AS flags
  FROM combos),
unread AS (SELECT merchant_id, file, sheet, "row", {trim_sql('item')} AS title FROM shown s WHERE NOT EXISTS (SELECT 1 FROM read r WHERE r.file = s.file AND r.sheet = s.sheet AND r.source_row = s."row")
  UNION ALL SELECT DISTINCT merchant_id, file, sheet, 1, 'Price list' FROM shown WHERE NOT headed),
placeholders AS (SELECT merchant_id, file, sheet, "row", 0 AS option_ord, '__unextracted_' || "row" AS product_key,
  'var_' || substr(sha256(merchant_id || ' ' || sheet || ' ' || "row"), 1, 16) AS variant_id, title, 'unmapped' AS category, NULL AS category_raw,
  0 AS price_minor, NULL AS compare_at_minor, 'unknown' AS availability, NULL AS inventory_count, 0 AS confidence, '' AS base_title, true AS title_inferred,
  NULL AS brand, NULL AS description, '' AS material, NULL AS c1, NULL AS s1, ['CATEGORY_UNMAPPED', 'MISSING_REQUIRED_FIELD'] AS flags FROM unread),
variants AS (SELECT *, 'prod_' || substr(sha256(merchant_id || ' ' || product_key), 1, 16) AS product_id,
  len(list_filter(flags, lambda f: f IN ('MISSING_REQUIRED_FIELD', 'PRICE_AMBIGUOUS', 'PRICE_OUT_OF_BAND', 'TITLE_INFERRED'))) = 0 AS servable,
  len(list_filter(flags, lambda f: f IN ('MISSING_REQUIRED_FIELD', 'PRICE_AMBIGUOUS', 'PRICE_OUT_OF_BAND', 'TITLE_INFERRED', 'CATEGORY_UNMAPPED', 'STOCK_UNKNOWN'))) > 0 AS needs_review
  FROM (SELECT * FROM extracted UNION ALL BY NAME SELECT * FROM placeholders)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY file, sheet, product_key ORDER BY title_inferred, "row", option_ord) AS best,
  row_number() OVER (PARTITION BY file, sheet, product_key ORDER BY "row", option_ord) AS first FROM variants),
products AS (SELECT merchant_id, file, sheet, product_key, product_id, any_value(base_title) FILTER (WHERE best = 1) AS named, any_value(title) FILTER (WHERE first = 1) AS first_title,
  any_value(brand) FILTER (WHERE best = 1) AS brand, any_value(description) FILTER (WHERE best = 1) AS description, any_value(confidence) FILTER (WHERE best = 1) AS confidence,
  bool_and(title_inferred) AS inferred, min("row") AS source_row, count(*) AS n_variants, bool_or(servable) AS any_servable FROM ordered GROUP BY ALL)"""
)
NORM_TABLES = ("sheet_parts", "readings")


@query(
    "norm_variants",
    "WITH " + NORM_SQL.strip() + """
SELECT merchant_id, file, sheet, "row", option_ord, product_key, product_id, variant_id, title, category, category_raw, price_minor,
  CAST(compare_at_minor AS BIGINT) AS compare_at_minor, availability, CAST(inventory_count AS BIGINT) AS inventory_count, CAST(confidence AS DOUBLE) AS confidence,
  array_to_string(flags, ',') AS flags, needs_review FROM variants""",
    NORM_TABLES,
)
def norm_variants(spark, sf):
    return _variants(spark, sf).select(
        "merchant_id", "file", "sheet", "row", "option_ord", "product_key", "product_id", "variant_id", "title", "category",
        "category_raw", "price_minor", "compare_at_minor", "availability", "inventory_count",
        F.col("confidence").cast("double").alias("confidence"), F.array_join(F.array_sort("flags"), ",").alias("flags"), "needs_review",
    )


@query(
    "norm_products",
    "WITH " + NORM_SQL.strip() + """
SELECT merchant_id, file, sheet, product_id, CASE WHEN named = '' THEN first_title ELSE named END AS title, brand, description, inferred AS needs_review,
  source_row, n_variants FROM products""",
    NORM_TABLES,
)
def norm_products(spark, sf):
    return normalize.products(_variants(spark, sf)).select(
        "merchant_id", "file", "sheet", "product_id", "title", "brand", "description", "needs_review",
        F.col("provenance.source_row").alias("source_row"), "n_variants",
    )


@query(
    "norm_options",
    "WITH " + NORM_SQL.strip() + """
SELECT file, sheet, "row", option_ord, array_to_string(list_filter(['Colour=' || c1, 'Size=' || s1], lambda x: x IS NOT NULL), ';') AS signature FROM variants""",
    NORM_TABLES,
)
def norm_options(spark, sf):
    return _variants(spark, sf).select("file", "sheet", "row", "option_ord", options.option_signature("options").alias("signature"))


@query(
    "norm_money_stock",
    "WITH " + NORM_SQL.strip() + """
SELECT file, sheet, "row", p_amount AS amount_minor, coalesce(l_amount, p_compare) AS compare_at_minor, availability, inventory_count,
  coalesce(rate_dimension IS NOT NULL AND pack_dimension IS NOT NULL AND (rate_dimension <> pack_dimension OR pack_base < rate_base), false) AS rate_disagrees FROM measured
UNION ALL SELECT DISTINCT file, sheet, 1, NULL, NULL, 'unknown', NULL, false FROM shown WHERE NOT headed""",
    NORM_TABLES,
)
def norm_money_stock(spark, sf):
    rows = normalize.read_money_stock(grid.with_roles(_data_rows(spark, sf)))
    return rows.select(
        "file", "sheet", "row", "price.amount_minor", "compare_at_minor", "stock.availability", "stock.inventory_count",
        normalize.rate_disagrees_with_pack().alias("rate_disagrees"),
    )


@query(
    "norm_attached_readings",
    "WITH " + NORM_SQL.strip() + """
SELECT s.file, s.sheet, s."row", r.title, r.title IS NOT NULL AS has_reading FROM shown s LEFT JOIN read r ON r.file = s.file AND r.sheet = s.sheet AND r.source_row = s."row"
UNION ALL SELECT DISTINCT file, sheet, 1, NULL, false FROM shown WHERE NOT headed""",
    NORM_TABLES,
)
def norm_attached_readings(spark, sf):
    attached = normalize.attach_readings(_data_rows(spark, sf), _readings(spark, sf))
    return attached.select(
        "file", "sheet", "row", "reading.title", F.col("reading").isNotNull().alias("has_reading")
    )


@query(
    "norm_review_queue",
    "WITH " + NORM_SQL.strip() + """
SELECT merchant_id, file, sheet, "row", variant_id, title, array_to_string(flags, ',') AS flags FROM variants WHERE needs_review""",
    NORM_TABLES,
)
def norm_review_queue(spark, sf):
    return normalize.review_queue(_variants(spark, sf)).withColumn("flags", F.array_join(F.array_sort("flags"), ","))


@query(
    "norm_flag_counts",
    "WITH " + NORM_SQL.strip() + """
SELECT merchant_id, flag, count(*) AS n_variants FROM (SELECT merchant_id, unnest(flags) AS flag FROM variants) GROUP BY ALL""",
    NORM_TABLES,
)
def norm_flag_counts(spark, sf):
    return normalize.flag_counts(_variants(spark, sf))


@query(
    "norm_provenance",
    "WITH " + NORM_SQL.strip() + """
SELECT variant_id, option_ord, file AS source_file, sheet AS source_sheet, "row" AS source_row, count(*) OVER (PARTITION BY file, sheet, "row", option_ord) AS copies
FROM variants""",
    NORM_TABLES,
)
def norm_provenance(spark, sf):
    cells = normalize.provenance_trace(_variants(spark, sf))
    return cells.groupBy("variant_id", "option_ord", "source_file", "source_sheet", "source_row").agg(
        (F.count(F.lit(1)) / F.count_distinct("header")).cast("bigint").alias("copies")
    )


# --- feed -----------------------------------------------------------------------------------------
def _published(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(products, variants), the variants written out once: publishing reads them several times."""
    made = written(_variants(spark, sf), "variants")
    return normalize.products(made), made


FEED_SQL = NORM_SQL + """,
judged AS (SELECT v.*, NOT p.inferred AS product_servable, CASE WHEN p.named = '' THEN p.first_title ELSE p.named END AS product_title, p.brand AS product_brand,
  p.description AS product_description FROM variants v JOIN products p USING (file, sheet, product_key)),
served AS (SELECT *, 'feed_' || substr(merchant_id, 5) AS feed_id FROM judged WHERE product_servable AND servable)"""


def _reason_sql(flag_list: str) -> str:
    return f"array_to_string(list_filter({flag_list}, lambda f: f IN ('MISSING_REQUIRED_FIELD', 'PRICE_AMBIGUOUS', 'PRICE_OUT_OF_BAND', 'TITLE_INFERRED')), ',')"


@query(
    "feed_variants",
    "WITH " + FEED_SQL.strip() + """
SELECT feed_id, product_id, file, sheet, "row", option_ord, variant_id AS id, title, price_minor AS amount, CAST(compare_at_minor AS BIGINT) AS list_amount,
  CASE WHEN availability <> 'unknown' THEN availability END AS status, CASE availability WHEN 'in_stock' THEN true WHEN 'out_of_stock' THEN false END AS available,
  category || CASE WHEN category_raw IS NOT NULL THEN ',' || category_raw ELSE '' END AS categories,
  nullif(array_to_string(list_filter(['Colour=' || c1, 'Size=' || s1], lambda x: x IS NOT NULL), ';'), '') AS options,
  CASE WHEN material <> '' THEN 'Inner material: ' || material END AS prose FROM served""",
    NORM_TABLES,
)
def feed_variants(spark, sf):
    v = F.col("variant")
    return feed.feed_variants(*_published(spark, sf)).select(
        "feed_id", "product_id", "file", "sheet", "row", "option_ord", v["id"].alias("id"), v["title"].alias("title"),
        v["price"]["amount"].alias("amount"), v["list_price"]["amount"].alias("list_amount"),
        v["availability"]["status"].alias("status"), v["availability"]["available"].alias("available"),
        F.array_join(F.transform(v["categories"], lambda c: c["value"]), ",").alias("categories"),
        F.array_join(F.transform(v["variant_options"], lambda o: F.concat(o["name"], F.lit("="), o["value"])), ";").alias("options"),
        v["description"]["plain"].alias("prose"),
    )


@query(
    "feed_products",
    "WITH " + FEED_SQL.strip() + """
SELECT feed_id, product_id AS id, file, sheet, product_title AS title, nullif(array_to_string(list_filter([product_description, 'Brand: ' || product_brand], lambda x: x IS NOT NULL), chr(10)), '') AS prose,
  count(*) AS n_variants, string_agg(variant_id, ',' ORDER BY "row", option_ord) AS variant_ids FROM served GROUP BY ALL""",
    NORM_TABLES,
)
def feed_products(spark, sf):
    p = F.col("product")
    return feed.project_products(*_published(spark, sf)).select(
        "feed_id", p["id"].alias("id"), "file", "sheet", p["title"].alias("title"), p["description"]["plain"].alias("prose"),
        F.size(p["variants"]).cast("bigint").alias("n_variants"),
        F.array_join(F.transform(p["variants"], lambda v: v["id"]), ",").alias("variant_ids"),
    )


WITHHELD_SQL = FEED_SQL + f""",
withheld AS (SELECT merchant_id, product_id AS id, 'product' AS kind, 'TITLE_INFERRED' AS reason FROM products WHERE inferred
  UNION ALL SELECT merchant_id, variant_id, 'variant', {_reason_sql('flags')} FROM judged WHERE product_servable AND NOT servable
  UNION ALL SELECT merchant_id, product_id, 'product', 'all_variants_withheld' FROM products WHERE NOT inferred AND NOT any_servable)"""


@query(
    "feed_withheld",
    "WITH " + WITHHELD_SQL.strip() + " SELECT merchant_id, id, kind, reason FROM withheld",
    NORM_TABLES,
)
def feed_withheld(spark, sf):
    held = feed.withheld(*_published(spark, sf))
    return held.withColumn("reason", F.array_join(F.array_sort(F.split("reason", ",")), ","))


@query(
    "feed_publish_summary",
    "WITH " + WITHHELD_SQL.strip() + """
SELECT merchant_id, (SELECT count(DISTINCT (file, sheet, product_key)) FROM served s WHERE s.merchant_id = m.merchant_id) AS served,
  (SELECT count(*) FROM withheld w WHERE w.merchant_id = m.merchant_id) AS withheld, (SELECT count(*) FROM served s WHERE s.merchant_id = m.merchant_id) AS stocked
FROM (SELECT DISTINCT merchant_id FROM products) m""",
    NORM_TABLES,
)
def feed_publish_summary(spark, sf):
    return feed.publish_summary(*_published(spark, sf))


@query(
    "feed_metadata",
    f"SELECT DISTINCT 'feed_' || substr(merchant_id, 5) AS id, 'IN' AS target_country, '2024-05-01T10:00:00.000Z' AS updated_at FROM sheet_parts",
    ("sheet_parts",),
)
def feed_metadata(spark, sf):
    return feed.feed_metadata(table(spark, sf, "sheet_parts"), "IN", F.lit(STAMP).cast("timestamp"))


def _spoiled_lines(spark, sf):
    """Feed lines of the catalogue with faults planted by part number."""
    n = F.substr("variant_id", F.lit(5)).cast("bigint")
    price = F.struct(
        F.when(n % 11 == 0, -1).when(n % 12 != 0, F.col("price_minor")).cast("bigint").alias("amount"),
        F.when(n % 13 == 0, "rs").otherwise(F.col("currency")).alias("currency"),
    )
    media = F.array(F.struct(F.lit("image").alias("type"), F.when(n % 17 == 0, "a.jpg").otherwise("https://x.example/a.jpg").alias("url"), F.lit("a").alias("alt_text")))
    variant = F.struct(
        F.col("variant_id").alias("id"), F.when(n % 19 != 0, F.col("title")).alias("title"),
        F.lit(None).cast("struct<plain:string>").alias("description"), price.alias("price"),
        F.lit(None).cast("struct<amount:bigint,currency:string>").alias("list_price"),
        F.array(F.struct(F.when(n % 23 != 0, F.col("category")).alias("value"), F.lit("t").alias("taxonomy"))).alias("categories"),
        F.lit(None).cast("array<struct<name:string,value:string>>").alias("variant_options"), media.alias("media"),
        F.lit(None).cast("struct<available:boolean,status:string>").alias("availability"),
    )
    product = F.struct(
        F.when(n % 29 != 0, F.col("variant_id")).alias("id"), F.col("title"), F.lit(None).cast("struct<plain:string>").alias("description"),
        F.array(variant).alias("variants"),
    )
    return table(spark, sf, "catalog").select(F.col("merchant_id").alias("feed_id"), product.alias("product"))


@query(
    "feed_check",
    """
WITH numbered AS (SELECT *, CAST(substr(variant_id, 5) AS BIGINT) AS n FROM catalog),
faults AS (SELECT merchant_id AS feed_id, n, CASE WHEN n % 29 <> 0 THEN variant_id END AS id, unnest([
  CASE WHEN n % 29 = 0 THEN {'p': '/id', 'm': 'is required'} END, CASE WHEN n % 19 = 0 THEN {'p': '/variants/0/title', 'm': 'is required'} END,
  CASE WHEN n % 11 = 0 THEN {'p': '/variants/0/price/amount', 'm': 'must be >= 0'} WHEN n % 12 = 0 THEN {'p': '/variants/0/price/amount', 'm': 'is required'} END,
  CASE WHEN n % 13 = 0 THEN {'p': '/variants/0/price/currency', 'm': 'must match ^[A-Z]{3}$'} END,
  CASE WHEN n % 23 = 0 THEN {'p': '/variants/0/categories', 'm': 'value is required'} END,
  CASE WHEN n % 17 = 0 THEN {'p': '/variants/0/media', 'm': 'url must match format uri'} END]) AS f FROM numbered)
SELECT feed_id, id, f.p AS path, f.m AS message FROM faults WHERE f IS NOT NULL""",
    ("catalog",),
)
def feed_check(spark, sf):
    return feed.check_feed(_spoiled_lines(spark, sf))


@query(
    "feed_discover",
    "WITH " + FEED_SQL.strip() + """
, hits AS (SELECT feed_id, variant_id AS id, title, price_minor, 'INR' AS currency, availability, category FROM served WHERE contains(lower(title), 'red'))
SELECT *, NULL AS n_matched FROM (SELECT * FROM hits ORDER BY feed_id, id LIMIT 100) UNION ALL BY NAME SELECT count(*) AS n_matched FROM hits""",
    NORM_TABLES,
)
def feed_discover(spark, sf):
    lines = written(feed.project_products(*_published(spark, sf)), "lines")
    count, first = feed.discover(lines, "RED", 100)
    return first.unionByName(count, allowMissingColumns=True)


@query(
    "feed_catalog_diff",
    "WITH " + FEED_SQL.strip() + """,
stale AS (SELECT DISTINCT merchant_id, variant_id FROM served WHERE "row" % 3 = 0), fresh AS (SELECT DISTINCT merchant_id, variant_id FROM served WHERE "row" % 4 <> 0)
(SELECT *, 'published_not_buyable' AS problem FROM (FROM fresh EXCEPT FROM stale)) UNION ALL (SELECT *, 'buyable_not_published' FROM (FROM stale EXCEPT FROM fresh))""",
    NORM_TABLES,
)
def feed_catalog_diff(spark, sf):
    sold = feed.servable_variants(*_published(spark, sf))
    # Yesterday's catalogue and today's feed each miss other rows.
    return feed.feed_catalog_diff(sold.where("row % 4 <> 0"), sold.where("row % 3 = 0"))


@query(
    "feed_digests",
    """
WITH lines AS (SELECT merchant_id AS feed_id, CAST(substr(variant_id, 5) AS BIGINT) AS ord, title || ' ' || price_minor AS line FROM catalog),
placed AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY ord) - 1 AS pos FROM lines),
blocks AS (SELECT feed_id, pos // 4096 AS block, sha256(string_agg(line, chr(10) ORDER BY pos)) AS h FROM placed GROUP BY ALL),
middle AS (SELECT feed_id, block // 4096 AS block, sha256(string_agg(h, chr(10) ORDER BY block)) AS h FROM blocks GROUP BY feed_id, block // 4096),
tops AS (SELECT feed_id, sha256(string_agg(h, chr(10) ORDER BY block)) AS h FROM middle GROUP BY feed_id, block // 4096)
SELECT feed_id, substr(h, 1, 32) AS digest FROM tops""",
    ("catalog",),
)
def feed_digests(spark, sf):
    lines = table(spark, sf, "catalog").select(
        F.col("merchant_id").alias("feed_id"), F.substr("variant_id", F.lit(5)).cast("bigint").alias("ord"),
        F.concat("title", F.lit(" "), F.col("price_minor").cast("string")).alias("line"),
    )
    return feed_digest(lines)


@query(
    "feed_roundtrip",
    "WITH " + FEED_SQL.strip() + """
SELECT feed_id, count(DISTINCT (file, sheet, product_key)) AS n_products, count(*) AS n_variants, sum(price_minor)::BIGINT AS price_minor, 'IN' AS target_country FROM served GROUP BY 1""",
    NORM_TABLES,
)
def feed_roundtrip(spark, sf):
    """Publishes every feed as JSON lines and reads it back."""
    made_products, made = _published(spark, sf)
    folder = shared_folder(spark, "feeds")
    metadata = feed.feed_metadata(made_products, "IN", F.lit(STAMP).cast("timestamp"))
    write_feed(feed.project_products(made_products, made), metadata, folder)
    lines, stored = read_feed(spark, folder)
    prices = F.aggregate("product.variants", F.lit(0).cast("bigint"), lambda n, v: n + v["price"]["amount"])
    counted = lines.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("n_products"), F.sum(F.size("product.variants")).alias("n_variants"), F.sum(prices).alias("price_minor")
    )
    return counted.join(stored.select("feed_id", "target_country"), "feed_id")


def _feed_counts(spark, folder):
    lines, _ = read_feed(spark, folder)
    return lines.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n_products"))


@query(
    "feed_republish",
    "WITH " + FEED_SQL.strip() + """
SELECT feed_id, count(DISTINCT (file, sheet, product_key)) AS n_products FROM served
WHERE feed_id <> (SELECT min(feed_id) FROM served) GROUP BY 1""",
    NORM_TABLES,
)
def feed_republish(spark, sf):
    """All feeds published, then published again with everything of the first one withheld: it ends empty."""
    made_products, made = _published(spark, sf)
    folder = shared_folder(spark, "feeds")
    metadata = feed.feed_metadata(made_products, "IN", F.lit(STAMP).cast("timestamp"))
    lines = written(feed.project_products(made_products, made), "lines")
    write_feed(lines, metadata, folder)
    first = lines.agg(F.min("feed_id").alias("first"))
    write_feed(lines.join(first, F.col("feed_id") != F.col("first")).drop("first"), metadata, folder)
    return _feed_counts(spark, folder)


@query(
    "feed_publish_gate",
    "WITH " + FEED_SQL.strip() + """
SELECT feed_id, count(DISTINCT (file, sheet, product_key)) AS n_products FROM served
WHERE feed_id <> (SELECT max(feed_id) FROM served) GROUP BY 1""",
    NORM_TABLES,
)
def feed_publish_gate(spark, sf):
    """All feeds go through the publish gate; one names a country that is none and is not published."""
    made_products, made = _published(spark, sf)
    folder = shared_folder(spark, "feeds")
    lines = written(feed.project_products(made_products, made), "lines")
    last = lines.agg(F.max("feed_id").alias("last"))
    metadata = feed.feed_metadata(made_products, "IN", F.lit(STAMP).cast("timestamp")).join(last, F.col("id") == F.col("last"), "left")
    country = F.when(F.col("last").isNotNull(), "india").otherwise(F.col("target_country"))
    publish(lines, metadata.withColumn("target_country", country).drop("last"), folder)
    return _feed_counts(spark, folder)


@query(
    "catalog_publish",
    "WITH " + FEED_SQL.strip() + """,
last AS (SELECT * FROM served QUALIFY row_number() OVER (PARTITION BY merchant_id, variant_id ORDER BY file DESC, sheet DESC, "row" DESC, option_ord DESC) = 1)
SELECT coalesce(l.merchant_id, c.merchant_id) AS merchant_id, coalesce(l.variant_id, c.variant_id) AS variant_id, coalesce(l.title, c.title) AS title,
  coalesce(l.price_minor, c.price_minor) AS price_minor, coalesce(l.availability, c.availability) AS availability
FROM catalog c FULL JOIN last l ON c.merchant_id = l.merchant_id AND c.variant_id = l.variant_id""",
    (*NORM_TABLES, "catalog"),
)
def catalog_publish(spark, sf):
    sold = catalog.catalog_rows(feed.servable_variants(*_published(spark, sf)), STAMP)
    return catalog.upsert_catalog(table(spark, sf, "catalog"), sold).select(
        "merchant_id", "variant_id", "title", "price_minor", "availability"
    )


@query(
    "feed_latest_shelf",
    "WITH " + FEED_SQL.strip() + """,
runs AS (SELECT DISTINCT merchant_id, sheet AS job_id, CAST(substr(sheet, 7) AS BIGINT) AS n FROM variants),
newest AS (SELECT merchant_id, arg_max(job_id, n) AS job_id FROM runs WHERE n % 4 <> 1 GROUP BY 1)
SELECT v.merchant_id, n.job_id, v.variant_id, v.title, v.price_minor, v."row", CASE WHEN servable THEN 'published' ELSE 'withheld' END AS shelf,
  """ + _reason_sql("flags") + """ AS reasons
FROM variants v JOIN newest n ON n.merchant_id = v.merchant_id AND n.job_id = v.sheet""",
    NORM_TABLES,
)
def feed_latest_shelf(spark, sf):
    made = written(_variants(spark, sf), "variants").withColumn("job_id", F.col("sheet"))
    number = F.substr("job_id", F.lit(7)).cast("bigint")
    runs = made.select("merchant_id", "job_id").distinct().select(
        "merchant_id", "job_id", number.alias("created_at"), F.when(number % 4 == 1, "failed").otherwise("complete").alias("status")
    )
    return feed.latest_shelf(runs, made).withColumn("reasons", F.array_join(F.array_sort("reasons"), ","))


@query(
    "cells_flag_tiers",
    "WITH " + NORM_SQL.strip() + f"""
SELECT variant_id, "row", sheet, option_ord, servable, needs_review, CASE WHEN servable THEN 'withheld' ELSE {_reason_sql('flags')} END AS reason FROM variants""",
    NORM_TABLES,
)
def cells_flag_tiers(spark, sf):
    return _variants(spark, sf).withColumn("flags", F.array_sort("flags")).select(
        "variant_id", "row", "sheet", "option_ord", flags.is_servable("flags").alias("servable"),
        flags.needs_review("flags").alias("needs_review"), flags.withholding_reason("flags").alias("reason"),
    )
