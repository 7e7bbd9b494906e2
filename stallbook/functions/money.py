"""Price text -> exact minor units, with what was doubtful about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import MAX_PLAUSIBLE_MINOR, MIN_PLAUSIBLE_MINOR
from .text import WORD_END, WORD_START, WS, as_text, col, none_if_empty, once

PRICE_TYPE = (
    "struct<amount_minor:bigint,compare_at_minor:bigint,rate_unit:string,flags:array<string>>"
)

# --- fixed values: what price cells look like -----------------------------------
_CURRENCY = rf"(?i)₹|{WORD_START}(?:Rs|INR){WORD_END}"
_RANGE = rf"(?i)^[^\d]*[\d.,]+[{WS}]*(?:-|–|—|to)[{WS}]*[\d.,]+[^\d]*\z"
_WITH_REFERENCE = (
    rf"(?i)^(.+?)[{WS}]*[(\{{\[][{WS}]*(?:MRP|M\.R\.P\.?|List)?[{WS}]*:?[{WS}]*([\d.,]+)[{WS}]*[)\}}\]]\z"
)
_THOUSANDS = rf"(?i)^([\d.,]+)[{WS}]*k\z"
_NUMBER = r"(\d+(?:\.\d{1,10})?)"
_RATE_UNIT = rf"(?i)(?:/|{WORD_START}per{WORD_END})[{WS}]*([A-Za-z]+)"


def rate_unit(c: Column | str) -> Column:
    """Unit the price is quoted per, verbatim: `₹ 100/Kg` -> Kg. `1,299/-` -> NULL."""
    return none_if_empty(F.regexp_extract(as_text(c), _RATE_UNIT, 1))


def is_price_range(c: Column | str) -> Column:
    return as_text(c).rlike(_RANGE)


def _scaled(number: Column, factor: int) -> Column:
    # 18 whole digits fit; longer digit runs are no price and have no amount.
    exact = F.round(number.try_cast("decimal(28,10)") * F.lit(factor), 0)
    return F.when(number != "", exact.try_cast("bigint"))


def to_minor(token: Column) -> Column:
    """One numeric token -> struct(minor, imprecise); minor NULL without digits."""
    plain = F.regexp_replace(token, ",", "")
    short = F.regexp_replace(F.regexp_extract(token, _THOUSANDS, 1), ",", "")
    # A separator without any digit counts as zero thousands, two points as unreadable.
    short_value = (
        F.when(short == "", F.lit("0"))
        .when(short.rlike(r"^(?:\d+\.?\d*|\.\d+)\z"), short)
        .otherwise("")
    )
    finer = plain.rlike(r"^\D*\d+\.\d{2}\d*[1-9]")
    return F.when(
        token.rlike(_THOUSANDS),
        F.struct(_scaled(short_value, 100_000).alias("minor"), F.lit(False).alias("imprecise")),
    ).otherwise(
        F.struct(
            _scaled(F.regexp_extract(plain, _NUMBER, 1), 100).alias("minor"),
            finer.alias("imprecise"),
        )
    )


def split_reference(c: Column | str) -> Column:
    """`2799 (MRP 3499)` -> struct(token, reference); reference NULL when absent."""
    text = as_text(c)
    first = F.regexp_extract(text, _WITH_REFERENCE, 1)
    return F.struct(
        F.when(first != "", first).otherwise(text).alias("token"),
        F.when(first != "", F.regexp_extract(text, _WITH_REFERENCE, 2)).alias("reference"),
    )


def with_price(df: DataFrame, source: str, target: str) -> DataFrame:
    """Adds `target`: struct of amount, reference amount, rate unit and flags.

    Steps are separate columns so that each pattern runs once per row.
    """
    t = lambda name: f"__{target}_{name}"
    temporary = [t(n) for n in ("text", "split", "range", "price", "reference")]
    staged = (
        df.withColumn(t("text"), as_text(source))
        .withColumn(t("split"), split_reference(t("text")))
        .withColumn(t("range"), col(t("text")).rlike(_RANGE))
        .withColumn(t("price"), to_minor(F.col(f"{t('split')}.token")))
        .withColumn(t("reference"), to_minor(F.col(f"{t('split')}.reference")))
    )
    text, is_range = F.col(t("text")), F.col(t("range"))
    minor = F.col(f"{t('price')}.minor")
    reference = F.col(f"{t('reference')}.minor")
    readable = ~is_range & minor.isNotNull()
    too_long = minor.isNull() & F.col(f"{t('split')}.token").rlike(r"\d{18}")
    flags = (
        F.when(text == "", F.array(F.lit("MISSING_REQUIRED_FIELD")))
        .when(is_range, F.array(F.lit("PRICE_AMBIGUOUS")))
        .otherwise(
            F.array_compact(
                F.array(
                    F.when(~text.rlike(_CURRENCY), F.lit("CURRENCY_ASSUMED")),
                    F.when(minor.isNull() & ~too_long, F.lit("MISSING_REQUIRED_FIELD")),
                    F.when(minor.isNotNull() & F.col(f"{t('price')}.imprecise"), F.lit("PRICE_AMBIGUOUS")),
                    F.when(
                        too_long | ~minor.between(MIN_PLAUSIBLE_MINOR, MAX_PLAUSIBLE_MINOR),
                        F.lit("PRICE_OUT_OF_BAND"),
                    ),
                )
            )
        )
    )
    value = F.struct(
        F.when(readable, minor).alias("amount_minor"),
        F.when(readable & (reference > minor), reference).alias("compare_at_minor"),
        rate_unit(text).alias("rate_unit"),
        flags.alias("flags"),
    )
    return staged.withColumn(target, once(value)).drop(*temporary)
