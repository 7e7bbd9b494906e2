"""Text columns: trimming, folding, scripts, labels, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import FAILURE_PATTERNS, OTHER_FAILURE

# Whitespace as spreadsheets contain it: ASCII, no-break, full-width and BOM.
# Java's own \s covers ASCII only. For use inside a character class.
WS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# ASCII word edges, independent of the JVM's idea of \b.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column) -> Column:
    """The same value, computed once per row.

    The optimizer copies the expression behind a column into every filter it moves
    towards the scan. It does not do so with the output of an explode, which makes
    this the form for costly values that later steps filter on.
    """
    return F.explode(F.array(value))


def as_text(c: ColumnOrName) -> Column:
    """Text of a cell without surrounding whitespace; absent becomes ''."""
    text = F.regexp_replace(col(c).cast("string"), rf"^[{WS}]+|[{WS}]+\z", "")
    return F.coalesce(text, F.lit(""))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS}]+", " ")


def fold(c: ColumnOrName) -> Column:
    """Case-, padding- and inner-whitespace-insensitive form, for comparing."""
    return collapse(F.lower(as_text(c)))


def dedupe_key(c: ColumnOrName) -> Column:
    """The key under which two rows count as the same product."""
    return fold(c)


def has_indic(c: ColumnOrName) -> Column:
    """True when the text contains a letter of an Indic script."""
    return F.coalesce(col(c).rlike(r"[\u0900-\u0DFF]"), F.lit(False))


def label(c: ColumnOrName) -> Column:
    """`inner_material` -> `Inner material`."""
    spaced = as_text(F.regexp_replace(col(c), r"[_-]+", " "))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substr(spaced, F.lit(2)))


def is_absolute_url(c: ColumnOrName) -> Column:
    """True for an http(s) address with a host."""
    url = col(c)
    protocol = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(protocol.isin("http", "https") & host.isNotNull(), F.lit(False))


def classify_failure(c: ColumnOrName) -> Column:
    """Coarse reason code for the error text of a failed batch; first match wins."""
    code = F.lit(OTHER_FAILURE)
    for pattern, name in reversed(FAILURE_PATTERNS):
        code = F.when(col(c).rlike(pattern), name).otherwise(code)
    return code


def canonical_id(c: ColumnOrName) -> Column:
    """`order_ABC1` and `ABC1` -> `ABC1`; any other shape -> NULL."""
    return none_if_empty(F.regexp_extract(col(c), r"^(?:[a-z]+_)?([A-Za-z0-9]+)\z", 1))


def _shaped(c: ColumnOrName, pattern: str) -> Column:
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def valid_feed_id(c: ColumnOrName) -> Column:
    return _shaped(c, r"^[A-Za-z0-9_-]{1,64}\z")


def valid_merchant_id(c: ColumnOrName) -> Column:
    return _shaped(c, r"^[A-Za-z0-9_-]{1,64}\z")


def valid_job_id(c: ColumnOrName) -> Column:
    return _shaped(c, r"^job_[0-9a-f]{16}\z")


def valid_session_id(c: ColumnOrName) -> Column:
    return _shaped(c, r"^cs_[0-9a-f]{24}\z")


def bearer(c: ColumnOrName) -> Column:
    """Token of an authorization header, whatever the case of the scheme."""
    token = F.regexp_extract(as_text(c), rf"(?i)^bearer[{WS}]+([^{WS}]+)\z", 1)
    return none_if_empty(token)


def local_stamp(c: ColumnOrName, zone: str = "Asia/Kolkata", fmt: str = "dd MMM, hh:mm a") -> Column:
    """Report stamp of a UTC timestamp in a fixed zone."""
    return F.date_format(F.from_utc_timestamp(col(c), zone), fmt)


def format_minor(c: ColumnOrName) -> Column:
    """Minor units as rupees for a report: 89950 -> ₹899.50."""
    amount = col(c).cast("bigint")
    size = F.abs(amount)
    sign = F.when(amount < 0, "-").otherwise("")
    whole = (size - size % 100) / 100
    return F.concat(
        F.lit("₹"), sign, whole.cast("bigint").cast("string"), F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )
