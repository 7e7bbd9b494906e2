"""Mandate headers: base64url JSON to columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, once

MANDATE_TYPE = (
    "struct<mandate_id:string,issued_at:string,expires_at:string,"
    "constraints:struct<max_amount:struct<value:bigint,currency:string>,"
    "categories:array<string>,max_items:int,single_use:boolean>,"
    "intent_text:string,signature:string>"
)


def _header_text(header: Column) -> Column:
    """JSON text of a base64url header, padded or not; NULL when it is no base64."""
    bare = F.regexp_replace(F.translate(header, "-_", "+/"), r"=+\z", "")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def _well_shaped(body: Column) -> Column:
    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(body, path, "variant"))

    shaped = kind("$.constraints").startswith("OBJECT")
    shaped = shaped & kind("$.constraints.max_amount").rlike("^(OBJECT|ARRAY|VOID)")
    for field in ("mandate_id", "issued_at", "expires_at", "signature"):
        shaped = shaped & (kind(f"$.{field}") == "STRING")
    return F.coalesce(shaped, F.lit(False))


def decode_mandates(df: DataFrame, header: str) -> DataFrame:
    """Adds the flat mandate columns of a header; malformed or misshapen gives NULLs, no error."""
    m = "__mandate"
    text, body = "__text", "__body"
    decoded = (
        df.withColumn(text, once(_header_text(col(header))))
        .withColumn(body, once(F.try_parse_json(text)))
        .withColumn(m, once(F.when(_well_shaped(F.col(body)), F.from_json(text, MANDATE_TYPE))))
    )
    return decoded.select(
        *df.columns,
        F.col(f"{m}.mandate_id").alias("mandate_id"),
        F.col(f"{m}.issued_at").alias("issued_at"),
        F.col(f"{m}.expires_at").alias("expires_at"),
        F.col(f"{m}.constraints.max_amount.value").alias("max_value"),
        F.col(f"{m}.constraints.max_amount.currency").alias("max_currency"),
        F.col(f"{m}.constraints.categories").alias("categories"),
        F.col(f"{m}.constraints.max_items").alias("max_items"),
        F.col(f"{m}.constraints.single_use").alias("single_use"),
        F.col(f"{m}.intent_text").alias("intent_text"),
        F.col(f"{m}.signature").alias("signature"),
    )


def encode_mandates(df: DataFrame, target: str = "mandate_header") -> DataFrame:
    """Adds the header text of the flat mandate columns; absent keys are left out."""
    constraints = F.struct(
        F.struct(F.col("max_value").alias("value"), F.col("max_currency").alias("currency")).alias("max_amount"),
        "categories", "max_items", "single_use",
    )
    body = F.to_json(
        F.struct("mandate_id", "issued_at", "expires_at", constraints.alias("constraints"), "intent_text", "signature")
    )
    encoded = F.regexp_replace(F.base64(F.encode(body, "UTF-8")), "[\r\n=]", "")
    return df.withColumn(target, F.translate(encoded, "+/", "-_"))
