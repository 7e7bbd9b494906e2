"""Quantities with units, measure rates, and stock cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import UNITS
from .text import WORD_END, WORD_START, WS, as_text, col

_QUANTITY = rf"(\d+(?:\.\d+)?)[{WS}]*([A-Za-z]+)"

# --- fixed values: what stock cells say; negatives are tried first ---------------
_OUT = (
    rf"(?i){WORD_START}(?:out[{WS}]*of[{WS}]*stock|sold[{WS}]*out|not[{WS}]*available|unavailable"
    rf"|no[{WS}]*stock|nil|none|finished){WORD_END}|^n\z|^no\z|^✗\z|^x\z|^✘\z|^❌\z"
)
_IN = (
    rf"(?i){WORD_START}(?:in[{WS}]*stock|available|ready|yes|have|stock){WORD_END}"
    r"|^y\z|^✓\z|^✔\z|^☑\z|^✅\z"
)
_COUNT = rf"(?i)^(\d+)[{WS}]*(?:pcs?|pieces?|nos?\.?|units?|qty)?\z"


def _unit_map(position: int) -> Column:
    pairs: list[Column] = []
    for unit, facts in UNITS.items():
        pairs += [F.lit(unit), F.lit(facts[position])]
    return F.create_map(*pairs)


def _unit(name: Column, position: int) -> Column:
    return F.try_element_at(_unit_map(position), F.lower(name))


def parse_quantity(c: Column | str) -> Column:
    """First number with its unit -> struct(dimension, base in g or ml); else NULL."""
    text = F.regexp_replace(as_text(c), ",", "")
    number = F.regexp_extract(text, _QUANTITY, 1)
    unit = F.regexp_extract(text, _QUANTITY, 2)
    dimension = _unit(unit, 0)
    base = (number.try_cast("decimal(18,3)") * _unit(unit, 1)).cast("decimal(18,3)")
    return F.when(
        dimension.isNotNull() & base.isNotNull(),
        F.struct(dimension.alias("dimension"), base.alias("base")),
    )


def measure_rate(unit: Column | str) -> Column:
    """A rate unit that is a unit of measure -> struct(dimension, base); else NULL."""
    name = col(unit)
    return F.when(
        _unit(name, 0).isNotNull(),
        F.struct(
            _unit(name, 0).alias("dimension"),
            _unit(name, 1).cast("decimal(18,3)").alias("base"),
        ),
    )


def parse_stock(c: Column | str) -> Column:
    """Stock text -> struct(availability, inventory_count); unreadable is unknown."""
    text = as_text(c)
    digits = F.regexp_extract(text, _COUNT, 1)
    # More digits than a BIGINT holds: in stock, in a number that is not stated.
    count = F.when(digits != "", digits.try_cast("bigint"))
    countless = (digits != "") & count.isNull()
    availability = (
        F.when((count > 0) | countless, "in_stock")
        .when(count.isNotNull(), "out_of_stock")
        .when(text.rlike(_OUT), "out_of_stock")
        .when(text.rlike(_IN), "in_stock")
        .otherwise("unknown")
    )
    return F.struct(availability.alias("availability"), count.alias("inventory_count"))
