"""Data rows and model readings -> variants and products, with provenance and flags.

Money and stock come from the merchant's cells only; a reading supplies titles,
categories and options. No row is dropped: one without a reading becomes a fully
flagged placeholder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import stable_id
from ..functions.fixed import (
    CATEGORIES, CATEGORY_CONFIDENCE_MIN, CURRENCY, ROW_CONFIDENCE_MIN, UNMAPPED,
)
from ..functions.flags import needs_review
from ..functions.money import with_price
from ..functions.options import (
    explode_options, identity_signature, option_signature, variant_title,
)
from ..functions.quantity import measure_rate, parse_quantity, parse_stock
from ..functions.text import has_indic, once

ROW_KEY = ["file", "sheet", "row"]
PRODUCT_KEY = ["file", "sheet", "product_key"]
READING_FIELDS = [
    "title", "title_inferred", "category", "category_confidence", "options", "attributes",
    "brand", "description", "variant_group", "confidence",
]


def attach_readings(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """Rows with their reading; the last reading of a row wins, rows without one stay.

    `readings` has file, sheet, source_row, ord and the reading fields. Duplicates
    are reduced before the join, with partial aggregation.
    """
    last = readings.groupBy("file", "sheet", F.col("source_row").alias("row")).agg(
        F.max_by(F.struct(*READING_FIELDS), "ord").alias("reading")
    )
    return rows.join(last, ROW_KEY, "left")


def _cell(field: str):
    return F.try_element_at(F.col("cells"), F.col(field))


def read_money_stock(rows: DataFrame) -> DataFrame:
    """Adds parsed `price`, `listed`, `stock` and `pack` from the role columns."""
    staged = (
        rows.withColumn("price_text", _cell("price_field"))
        .withColumn("listed_text", _cell("list_price_field"))
        .withColumn("stock", once(parse_stock(_cell("stock_field"))))
        .withColumn("pack", parse_quantity(_cell("pack_size_field")))
    )
    priced = with_price(with_price(staged, "price_text", "price"), "listed_text", "listed")
    # A list-price column beats a reference scraped out of the price cell.
    return priced.withColumn(
        "compare_at_minor", F.coalesce("listed.amount_minor", "price.compare_at_minor")
    ).drop("price_text", "listed_text")


def resolve_category(rows: DataFrame) -> DataFrame:
    """Adds `resolved_category`: a member of the closed list, else unmapped."""
    said = F.col("reading.category")
    return rows.withColumn("resolved_category", F.when(said.isin(*CATEGORIES), said).otherwise(UNMAPPED))


def rate_disagrees_with_pack():
    """A rate per unit of measure beside a smaller pack (or another dimension)."""
    rate = measure_rate("price.rate_unit")
    different = rate["dimension"] != F.col("pack.dimension")
    smaller = F.col("pack.base") < rate["base"]
    return F.coalesce(rate.isNotNull() & F.col("pack").isNotNull() & (different | smaller), F.lit(False))


def flag_rows(rows: DataFrame) -> DataFrame:
    """Adds `flags`: everything doubtful or notable about a row and its reading."""
    category_unsure = (F.col("resolved_category") == UNMAPPED) | (
        F.col("reading.category_confidence") < CATEGORY_CONFIDENCE_MIN
    )
    unknown_stock = F.col("stock.availability") == "unknown"
    extra = F.array_compact(
        F.array(
            F.when(category_unsure, F.lit("CATEGORY_UNMAPPED")),
            F.when(F.col("reading.title_inferred"), F.lit("TITLE_INFERRED")),
            F.when(F.col("reading.confidence") < ROW_CONFIDENCE_MIN, F.lit("MISSING_REQUIRED_FIELD")),
            F.when(unknown_stock & F.col("stock_field").isNull(), F.lit("STOCK_NOT_TRACKED")),
            F.when(unknown_stock & F.col("stock_field").isNotNull(), F.lit("STOCK_UNKNOWN")),
            F.when(rate_disagrees_with_pack(), F.lit("PRICE_AMBIGUOUS")),
            F.when(F.exists(F.map_values("cells"), has_indic), F.lit("MULTILINGUAL_SOURCE")),
        )
    )
    return rows.withColumn("flags", once(F.array_distinct(F.concat("price.flags", extra))))


_EMPTY_MAP = "map<string,string>"


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Variants of rows that carry `reading` (NULL: none) and the role columns, in one pass.

    The variant id hashes the merchant, the merchant's own identifying cells and
    the option combination: neither a new price nor another wording by the model
    changes it.
    """
    parsed = flag_rows(resolve_category(read_money_stock(rows)))
    money_columns = F.array_compact(F.array("price_field", "list_price_field", "stock_field"))
    identity = identity_signature("cells", money_columns)
    no_options = F.create_map().cast(_EMPTY_MAP)
    keyed = parsed.withColumn("identity", F.coalesce(F.nullif(identity, F.lit("")), "reading.title")).withColumn(
        "stated_options", F.coalesce("reading.options", no_options)
    )
    expanded = explode_options(keyed, "stated_options", "chosen", "option_ord")

    unread = F.col("reading").isNull()
    row_text = F.col("row").cast("string")
    strings = "array<string>"

    def known(value):
        return F.when(~unread, value)

    def either(placeholder, value):
        return F.when(unread, placeholder).otherwise(value)

    unpriced = F.col("price.amount_minor").isNull() & ~F.array_contains("flags", "MISSING_REQUIRED_FIELD")
    flags = F.array_distinct(
        F.concat(
            "flags",
            F.when(F.col("chosen_total") > 1, F.array(F.lit("VARIANTS_SPLIT"))).otherwise(F.array().cast(strings)),
            F.when(unpriced, F.array(F.lit("MISSING_REQUIRED_FIELD"))).otherwise(F.array().cast(strings)),
        )
    )
    first_cell = F.coalesce(F.get(F.map_values("cells"), F.lit(0)), F.concat(F.lit("row "), row_text))
    category = F.col("resolved_category")
    own_id = stable_id("var", "merchant_id", "identity", option_signature("chosen"))
    return expanded.select(
        "merchant_id", *ROW_KEY, "sheet_no", "option_ord",
        either(
            F.concat(F.lit("__unextracted_"), row_text),
            F.coalesce("reading.variant_group", F.concat(F.lit("__row_"), row_text)),
        ).alias("product_key"),
        either(stable_id("var", "merchant_id", "sheet", "row"), own_id).alias("variant_id"),
        either(first_cell, variant_title("reading.title", "chosen")).alias("title"),
        either(F.lit(UNMAPPED), category).alias("category"),
        F.when(F.col("reading.category") != category, F.col("reading.category")).alias("category_raw"),
        F.coalesce(F.col("reading.category_confidence").cast("double"), F.lit(0.0)).alias("category_confidence"),
        # Zero only ever beside the flag that withholds it.
        F.coalesce(known(F.col("price.amount_minor")), F.lit(0).cast("bigint")).alias("price_minor"),
        F.lit(CURRENCY).alias("currency"),
        known(F.col("compare_at_minor")).alias("compare_at_minor"),
        either(F.lit("unknown"), F.col("stock.availability")).alias("availability"),
        known(F.col("stock.inventory_count")).alias("inventory_count"),
        F.col("chosen").alias("options"),
        F.coalesce("reading.attributes", no_options).alias("attributes"),
        F.lit(None).cast("string").alias("image_url"),
        F.struct(
            F.col("file").alias("source_file"), F.col("sheet").alias("source_sheet"),
            F.col("row").alias("source_row"), F.col("cells").alias("source_cells"),
        ).alias("provenance"),
        F.coalesce(F.col("reading.confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        either(F.array(F.lit("MISSING_REQUIRED_FIELD"), F.lit("CATEGORY_UNMAPPED")), flags).alias("flags"),
        F.struct(
            F.coalesce("reading.title", F.lit("")).alias("title"),
            F.col("reading.description").alias("description"),
            F.col("reading.brand").alias("brand"),
            F.coalesce("reading.title_inferred", F.lit(True)).alias("title_inferred"),
            F.coalesce(F.col("reading.confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        ).alias("named"),
    )


def variants(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """Variants of all data rows. `rows` carries merchant_id, cells and the role columns.

    A row may carry `sheet_no`; products of a file's first sheet (the default)
    take their id from merchant and group alone, further sheets add their name.
    """
    return assembled_variants(attach_readings(rows, readings))


def assembled_variants(rows: DataFrame) -> DataFrame:
    """Variants with product ids, of rows that already carry their `reading`."""
    if "sheet_no" not in rows.columns:
        rows = rows.withColumn("sheet_no", F.lit(1))
    made = normalize_rows(rows)
    first_sheet = stable_id("prod", "merchant_id", "product_key")
    later_sheet = stable_id("prod", "merchant_id", "sheet", "product_key")
    return made.withColumn(
        "product_id", F.when(F.col("sheet_no") == 1, first_sheet).otherwise(later_sheet)
    ).withColumn("needs_review", needs_review("flags"))


def products(variant_rows: DataFrame) -> DataFrame:
    """One row per product: the identity comes from the first row with a stated title.

    Only aggregates that combine on the map side; variants stay rows of their own.
    """
    order = F.struct("row", "option_ord")
    grouped = variant_rows.groupBy("merchant_id", *PRODUCT_KEY, "product_id").agg(
        F.min_by("named", F.struct(F.col("named.title_inferred"), "row", "option_ord")).alias("named"),
        F.min_by("title", order).alias("first_title"),
        F.min_by("provenance", order).alias("provenance"),
        F.count(F.lit(1)).alias("n_variants"),
    )
    flags = F.when(F.col("named.title_inferred"), F.array(F.lit("TITLE_INFERRED"))).otherwise(
        F.array().cast("array<string>")
    )
    return grouped.select(
        "merchant_id", *PRODUCT_KEY, "product_id",
        F.when(F.col("named.title") == "", F.col("first_title")).otherwise(F.col("named.title")).alias("title"),
        F.col("named.description").alias("description"),
        F.col("named.brand").alias("brand"),
        F.lit(None).cast("string").alias("image_url"),
        "provenance",
        F.col("named.confidence").alias("confidence"),
        flags.alias("flags"),
        needs_review(flags).alias("needs_review"),
        "n_variants",
    )


def review_queue(variant_rows: DataFrame) -> DataFrame:
    """Variants a merchant should look at, with what is doubtful about them."""
    return variant_rows.where("needs_review").select(
        "merchant_id", *ROW_KEY, "variant_id", "title", "flags"
    )


def flag_counts(variant_rows: DataFrame) -> DataFrame:
    return variant_rows.select("merchant_id", F.explode("flags").alias("flag")).groupBy(
        "merchant_id", "flag"
    ).agg(F.count(F.lit(1)).alias("n_variants"))


def provenance_trace(variant_rows: DataFrame) -> DataFrame:
    """Where every variant came from, one row per cell it was made of."""
    return variant_rows.select(
        "merchant_id", "variant_id", "option_ord",
        F.col("provenance.source_file").alias("source_file"),
        F.col("provenance.source_sheet").alias("source_sheet"),
        F.col("provenance.source_row").alias("source_row"),
        F.explode_outer("provenance.source_cells").alias("header", "text"),
    )
