"""Payment-link events: raw JSON text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_id, once

_LINK = "$.payload.payment_link.entity"
_PAYMENT = "$.payload.payment.entity"


def _text(body: Column, path: str) -> Column:
    """A JSON string that is not empty; anything else is NULL."""
    is_text = F.schema_of_variant(F.try_variant_get(body, path, "variant")) == "STRING"
    return F.when(is_text, F.nullif(F.try_variant_get(body, path, "string"), F.lit("")))


def _whole(body: Column, path: str) -> Column:
    """A JSON number without fraction, as BIGINT; "10", 10.5 and true are NULL."""
    kind = F.schema_of_variant(F.try_variant_get(body, path, "variant"))
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(body, path, "decimal(38,10)"))
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def parse_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds `is_json`, `recognised` and the event fields; keeps every row.

    A path that meets an array, null or nothing yields NULL, as `notes` does.
    """
    v = "__event"
    parsed = raw.withColumn(v, once(F.try_parse_json(body)))
    c = F.col(v)
    recognised = (_text(c, "$.entity") == "event") & _text(c, "$.event").isNotNull()
    return (
        parsed.withColumn("is_json", c.isNotNull())
        .withColumn("recognised", F.coalesce(recognised, F.lit(False)))
        .withColumn("event", _text(c, "$.event"))
        .withColumn("session_id", _text(c, f"{_LINK}.reference_id"))
        .withColumn("link_id", _text(c, f"{_LINK}.id"))
        .withColumn("order_id_raw", _text(c, f"{_LINK}.order_id"))
        .withColumn("order_id", canonical_id("order_id_raw"))
        .withColumn("payment_id", _text(c, f"{_PAYMENT}.id"))
        .withColumn("amount_minor", _whole(c, f"{_LINK}.amount"))
        .withColumn("amount_paid_minor", _whole(c, f"{_LINK}.amount_paid"))
        .withColumn("currency", _text(c, f"{_LINK}.currency"))
        .drop(v)
    )


def payment_events(raw: DataFrame) -> DataFrame:
    """The recognised events of already authenticated raw rows."""
    return parse_events(raw).where("recognised").drop("is_json", "recognised")
