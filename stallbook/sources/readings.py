"""Model readings: JSON batches checked against the closed wire form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CATEGORIES
from ..functions.options import pairs_to_map

_ROW_FIELDS = [
    "source_row", "title", "title_inferred", "category", "category_confidence", "options",
    "attributes", "brand", "description", "variant_group", "confidence",
]
_WIRE = """
source_row int, title string, title_inferred boolean, category string,
category_confidence double, options array<struct<name:string,value:string>>,
attributes array<struct<name:string,value:string>>, brand string, description string,
variant_group string, confidence double
"""


def _type(row: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(row, f"$.{field}", "variant"))


def _problem(row: Column) -> Column:
    """Why a wire row breaks the schema; NULL when it conforms."""

    def number(field: str) -> Column:
        return F.coalesce(_type(row, field).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))

    def text(field: str) -> Column:
        return F.coalesce(_type(row, field) == "STRING", F.lit(False))

    def text_or_null(field: str) -> Column:
        return F.coalesce(_type(row, field).isin("STRING", "VOID"), F.lit(False))

    def share(field: str) -> Column:
        value = F.try_variant_get(row, f"$.{field}", "double")
        return number(field) & value.between(0, 1)

    def pairs(field: str) -> Column:
        kind = _type(row, field)
        closed = kind.isin("ARRAY<OBJECT<name: STRING, value: STRING>>", "ARRAY<VOID>")
        return F.coalesce(closed, F.lit(False))

    whole = F.try_variant_get(row, "$.source_row", "double")
    category = F.try_variant_get(row, "$.category", "string")
    keys = F.json_object_keys(F.to_json(row))
    rules = [
        (F.coalesce(F.schema_of_variant(row).startswith("OBJECT"), F.lit(False)), "row must be object"),
        (number("source_row") & (whole == F.floor(whole)), "source_row must be integer"),
        (text("title"), "title must be string"),
        (F.coalesce(_type(row, "title_inferred") == "BOOLEAN", F.lit(False)), "title_inferred must be boolean"),
        (text("category") & category.isin(*CATEGORIES), "category must be equal to one of the allowed values"),
        (share("category_confidence"), "category_confidence must be number between 0 and 1"),
        (pairs("options"), "options must be array of name and value"),
        (pairs("attributes"), "attributes must be array of name and value"),
        (text_or_null("brand"), "brand must be string or null"),
        (text_or_null("description"), "description must be string or null"),
        (text_or_null("variant_group"), "variant_group must be string or null"),
        (share("confidence"), "confidence must be number between 0 and 1"),
        (F.size(F.array_except(keys, F.array(*[F.lit(f) for f in _ROW_FIELDS]))) == 0,
         "must NOT have additional properties"),
    ]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules])


def read_extractions(batches: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(readings, rejected batches) from `key` columns and a JSON `payload`.

    One bad row rejects its whole batch. Readings come with maps for options and
    attributes and with `ord`, their place in the batch.
    """
    parsed = batches.withColumn("__body", F.try_parse_json("payload"))
    rows = F.try_variant_get("__body", "$.rows", "array<variant>")
    unreadable = (
        F.when(F.col("__body").isNull(), "extraction was not valid JSON")
        .when(
            ~F.coalesce(F.schema_of_variant("__body").startswith("OBJECT"), F.lit(False)) | F.col("__rows").isNull(),
            "extraction failed schema validation: rows must be array",
        )
        .when(
            F.size(F.array_except(F.json_object_keys("payload"), F.array(F.lit("rows")))) > 0,
            "extraction failed schema validation: must NOT have additional properties",
        )
    )
    staged = parsed.withColumn("__rows", rows).withColumn("__fault", unreadable)
    numbered = staged.select(
        *key, "__fault",
        F.posexplode_outer(F.when(F.col("__fault").isNull(), F.col("__rows"))).alias("ord", "__row"),
    ).withColumn("__problem", F.when(F.col("__row").isNotNull(), _problem(F.col("__row"))))
    # All rows of a batch share one small verdict: an aggregate, joined back by batch.
    verdict = numbered.groupBy(*key).agg(
        F.min("__fault").alias("fault"),
        F.min_by("__problem", F.when(F.col("__problem").isNotNull(), F.col("ord"))).alias("problem"),
    )
    reason = F.coalesce(
        "fault", F.concat(F.lit("extraction failed schema validation: "), F.col("problem"))
    )
    rejected = verdict.select(*key, reason.alias("reason")).where("reason IS NOT NULL")
    accepted = verdict.where("fault IS NULL AND problem IS NULL").select(*key)
    wire = F.from_json(F.to_json("__row"), _WIRE)
    valid = (
        numbered.where("__row IS NOT NULL")
        .join(accepted, key)
        .select(*key, "ord", wire.alias("w"))
        .select(*key, "ord", "w.*")
        .withColumn("options", pairs_to_map("options"))
        .withColumn("attributes", pairs_to_map("attributes"))
    )
    return valid, rejected
