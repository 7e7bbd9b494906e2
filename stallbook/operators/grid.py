"""Sheets as long tables of cells -> header, data rows and explained skips.

All sheets of all files go through one plan. Cells meet once, per sheet row;
everything a sheet decides as a whole (its header) is an aggregate of rows that
combines on the map side, so a sheet of any size needs no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import KNOWN_HEADERS, ROLE_SYNONYMS
from ..functions.text import WORD_END, WORD_START, WS, as_text, dedupe_key
from ..session import written
from .ranking import positions

SHEET = ["file", "sheet"]
HEADER_SEARCH_ROWS = 15

# --- fixed values: first cells that mark a row as no product ---------------------
_JUNK_TOTAL = rf"(?i)^(?:grand[{WS}]+)?(?:sub[{WS}]*)?total{WORD_END}"
_JUNK_TEXT = (
    rf"(?i)^\*+|^-{{3,}}|^note{WORD_END}|^n\.?b\.?{WORD_END}|{WORD_START}contact{WORD_END}"
    rf"|^call{WORD_END}|{WORD_START}gst{WORD_END}|subject[{WS}]+to[{WS}]+change|^terms{WORD_END}"
    rf"|^conditions{WORD_END}|{WORD_START}whatsapp{WORD_END}|^address{WORD_END}"
)
_JUNK_PHONE = (
    rf"(?:\+?91[-{WS}]?)?{WORD_START}\d{{5}}[{WS}]?\d{{5}}{WORD_END}|{WORD_START}\d{{10}}{WORD_END}"
)


def fill_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell inside a merged rectangle takes the text of its top-left cell.

    A rectangle is unfolded into the cells it covers, so cells meet it by
    equality; no cell is compared with all rectangles of its sheet.
    """
    rectangles = merges.select(
        *SHEET, F.col("r1").alias("row"), F.col("c1").alias("col"), "r2", "c2"
    )
    masters = cells.select(*SHEET, "row", "col", "text")
    covered = (
        rectangles.join(masters, [*SHEET, "row", "col"], "left")
        .withColumn("at_row", F.explode(F.sequence("row", "r2")))
        .withColumn("at_col", F.explode(F.sequence("col", "c2")))
        .select(
            *SHEET,
            F.col("at_row").alias("row"),
            F.col("at_col").alias("col"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.col("row").alias("master_row"),
            F.lit(1).alias("rank"),
        )
    )
    own = cells.select(
        *SHEET, "row", "col", "text",
        F.coalesce("master_row", "row").alias("master_row"), F.lit(0).alias("rank"),
    )
    filled = own.unionByName(covered).groupBy(*SHEET, "row", "col").agg(
        F.max_by(F.struct("text", "master_row"), "rank").alias("cell")
    )
    return filled.select(*SHEET, "row", "col", "cell.text", "cell.master_row")


def row_profile(cells: DataFrame) -> DataFrame:
    """One record per sheet row: its cells in order, and what the header search needs."""
    text = as_text("text")
    clean = cells.select(
        *SHEET, F.col("row").cast("int"), F.col("col").cast("int"), text.alias("text"),
        F.coalesce("master_row", "row").cast("int").alias("master_row"),
    )
    filled = F.col("text") != ""
    return clean.groupBy(*SHEET, "row").agg(
        F.count_if(filled).cast("int").alias("n_filled"),
        F.coalesce(F.max(F.when(filled, F.col("text").rlike("[0-9]"))), F.lit(False)).alias("has_digits"),
        F.min_by(F.when(filled, F.col("text")), F.when(filled, F.col("col"))).alias("first_text"),
        F.coalesce(F.max(F.when(filled, F.col("col"))), F.lit(0)).alias("width"),
        F.array_sort(
            F.collect_list(F.when(filled, F.struct("col", "text", "master_row")))
        ).alias("row_cells"),
    )


def _dense_texts(cells: Column, width: Column) -> Column:
    """Texts of columns 1..width, '' where the row has none."""
    by_column = F.map_from_entries(F.transform(cells, lambda c: F.struct(c["col"], c["text"])))
    filled = F.transform(
        F.sequence(F.lit(1), width), lambda i: F.coalesce(F.try_element_at(by_column, i), F.lit(""))
    )
    return F.when(width > 0, filled).otherwise(F.array().cast("array<string>"))


def sheet_headers(profile: DataFrame) -> DataFrame:
    """Header row, header names, score, width and height of every sheet.

    The header is the first of the top rows with two filled cells and no digit
    whose next row that is not blank has a digit. Only the top rows and the first
    filled row below them matter, so the aggregate stays small.
    """
    filled = F.col("n_filled") > 0
    top = filled & (F.col("row") <= HEADER_SEARCH_ROWS)
    facts = profile.groupBy(*SHEET).agg(
        F.array_sort(
            F.collect_list(F.when(top, F.struct("row", "n_filled", "has_digits", "width", "row_cells")))
        ).alias("top"),
        F.min(F.when(filled & (F.col("row") > HEADER_SEARCH_ROWS), F.struct("row", "has_digits"))).alias("below"),
        F.max("width").alias("max_width"),
        F.max("row").alias("height"),
    )

    def candidate(row: Column, i: Column) -> Column:
        following = F.coalesce(F.get(F.col("top"), i + 1)["has_digits"], F.col("below.has_digits"))
        fits = (row["n_filled"] >= 2) & ~row["has_digits"] & F.coalesce(following, F.lit(False))
        return F.when(fits, row)

    header = F.get(F.filter(F.transform("top", candidate), lambda r: r.isNotNull()), F.lit(0))
    positional = F.when(
        F.col("max_width") > 0,
        F.transform(F.sequence(F.lit(1), F.col("max_width")), lambda i: F.concat(F.lit("col_"), i.cast("string"))),
    ).otherwise(F.array().cast("array<string>"))
    named = facts.withColumn("header", header).withColumn(
        "headers",
        F.when(F.col("header").isNull(), positional).otherwise(
            _dense_texts(F.col("header.row_cells"), F.col("header.width"))
        ),
    )
    return named.select(
        *SHEET,
        F.col("header.row").alias("header_row"),
        "headers",
        F.when(F.col("header").isNull(), F.lit(0.0)).otherwise(header_score("headers")).alias("header_score"),
        "height",
    )


def header_score(headers: Column | str) -> Column:
    """Share of the filled headers that are known field names."""
    names = F.filter(F.col(headers) if isinstance(headers, str) else headers, lambda h: h != "")
    known = F.filter(names, lambda h: F.lower(h).isin(*KNOWN_HEADERS))
    return F.when(F.size(names) == 0, F.lit(0.0)).otherwise(
        F.size(known).cast("double") / F.size(names)
    )


def find_field(headers: Column | str, role: str) -> Column:
    """The header that plays `role`; the preferred spelling wins, matching is exact."""
    names = F.col(headers) if isinstance(headers, str) else headers
    lowered = F.transform(names, lambda h: F.lower(as_text(h)))
    return F.coalesce(
        *[
            F.when(F.array_contains(lowered, s), F.get(names, (F.array_position(lowered, s) - 1).cast("int")))
            for s in ROLE_SYNONYMS[role]
        ]
    )


def with_roles(headers: DataFrame) -> DataFrame:
    """Adds price_field, list_price_field, stock_field and pack_size_field."""
    for role in ROLE_SYNONYMS:
        headers = headers.withColumn(f"{role}_field", find_field("headers", role))
    return headers


def blank_rows(profile: DataFrame, headers: DataFrame, slice_rows: int = 1024) -> DataFrame:
    """Rows up to a sheet's height of which a sparse cell table holds nothing at all."""
    present = profile.select(*SHEET, "row", F.floor((F.col("row") - 1) / slice_rows).cast("int").alias("slice"))
    seen = present.groupBy(*SHEET, "slice").agg(F.collect_set("row").alias("seen"))
    slices = headers.select(*SHEET, "height").withColumn(
        "slice",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / slice_rows).cast("int"))),
    )
    first = F.col("slice") * slice_rows + 1
    expected = F.sequence(first, F.least(first + slice_rows - 1, F.col("height")))
    missing = F.array_except(expected, F.coalesce("seen", F.array().cast("array<int>")))
    return slices.join(seen, [*SHEET, "slice"], "left").select(*SHEET, F.explode(missing).alias("row"))


def classify_rows(profile: DataFrame, headers: DataFrame) -> DataFrame:
    """Adds the sheet's header facts and `reason`: preamble, header, blank, junk or NULL for data.

    A junk row announces itself in its first filled cell; only that one is looked at.
    """
    joined = profile.join(headers, SHEET)
    first = F.coalesce(F.col("first_text"), F.lit(""))
    junk = first.rlike(_JUNK_TOTAL) | first.rlike(_JUNK_TEXT) | first.rlike(_JUNK_PHONE)
    reason = (
        F.when(F.col("row") < F.col("header_row"), "preamble")
        .when(F.col("row") == F.col("header_row"), "header")
        .when(F.col("n_filled") == 0, "blank")
        .when(junk, "junk")
    )
    return joined.withColumn("reason", reason)


def skipped_rows(classified: DataFrame, gaps: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows that are no data, each with its reason; rows without any cell included."""
    named = classified.where(F.col("reason").isin("preamble", "blank", "junk")).select(*SHEET, "row", "reason")
    above = F.when(F.col("row") < F.col("header_row"), "preamble").otherwise("blank")
    empty = gaps.join(headers.select(*SHEET, "header_row"), SHEET).select(*SHEET, "row", above.alias("reason"))
    return named.unionByName(empty)


def assemble_rows(classified: DataFrame) -> DataFrame:
    """Data rows: header -> value map, positional values, and rows values were inherited from."""

    def key(cell: Column) -> Column:
        name = F.nullif(F.get(F.col("headers"), cell["col"] - 1), F.lit(""))
        return F.coalesce(name, F.concat(F.lit("col_"), cell["col"].cast("string")))

    own = F.filter("row_cells", lambda c: c["master_row"] != F.col("row"))
    return classified.where(F.col("reason").isNull()).select(
        *SHEET,
        "row",
        "headers",
        F.map_from_entries(F.transform("row_cells", lambda c: F.struct(key(c), c["text"]))).alias("cells"),
        _dense_texts(F.col("row_cells"), F.col("width")).alias("values"),
        F.map_from_entries(F.transform(own, lambda c: F.struct(key(c), c["master_row"]))).alias("inherited"),
    )


def structure_sheets(cells: DataFrame, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sheet headers, data rows, skipped rows) of every sheet in the cell table.

    The row profile is written out: headers, rows and skips all read it, each a
    few of its columns, and the cells are shuffled once instead of for each.
    """
    profile = written(row_profile(fill_merges(cells, merges) if merges is not None else cells), "sheet-rows")
    headers = sheet_headers(profile)
    classified = classify_rows(profile, headers)
    skipped = skipped_rows(classified, blank_rows(profile, headers), headers)
    return headers, assemble_rows(classified), skipped


def find_duplicates(rows: DataFrame, key_field: str, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(groups, members): rows of one scope that name the same product.

    A group lists the fields on which its rows state different values; leaving a
    field blank is no disagreement. Members come as rows, so that a group of any
    size stays spread out.
    """
    keyed = rows.withColumn("key", dedupe_key(F.try_element_at("cells", F.lit(key_field)))).where(
        F.col("key") != ""
    )
    group = [*scope, "key"]
    sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    stated = keyed.select(*group, F.explode("cells").alias("field", "value")).where(
        (F.col("field") != key_field) & (F.col("value") != "")
    )
    conflicts = (
        stated.groupBy(*group, "field")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .where("low <> high")
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list("field")).alias("conflicting"))
    )
    groups = sizes.join(conflicts, group, "left").withColumn(
        "conflicting", F.coalesce("conflicting", F.array().cast("array<string>"))
    )
    return groups, keyed.join(sizes.select(*group), group, "left_semi")


def chunk(rows: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """Adds batch_index: fixed-size batches of a group's rows in order."""
    if size < 1:
        raise ValueError(f"batch size must be at least 1, got {size}")
    placed = positions(rows, group, [order], "__position")
    return placed.withColumn(
        "batch_index", F.floor((F.col("__position") - 1) / size).cast("int")
    ).drop("__position")
