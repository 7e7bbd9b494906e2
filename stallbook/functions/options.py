"""Option lists, their combinations, and the signatures built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, as_text, col, fold


def split_list(c: Column | str) -> Column:
    """`S/M/L` -> [S, M, L]; `1/2 kg` stays whole; blank -> []."""
    text = as_text(c)
    raw = F.split(text, rf"[{WS}]*[,|;][{WS}]*|[{WS}]*/[{WS}]*")
    parts = F.filter(F.transform(raw, as_text), lambda p: p != "")
    spaced = F.exists(parts, lambda p: p.rlike(rf"[{WS}]"))
    tight = text.rlike(rf"[^{WS}]/[^{WS}]")
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when((F.size(parts) < 2) | (tight & spaced), F.array(text))
        .otherwise(parts)
    )


def pairs_to_map(pairs: Column | str) -> Column:
    """array<struct(name, value)> -> map; empty names or values dropped, last one wins."""
    kept = F.filter(col(pairs), lambda p: (p["name"] != "") & (p["value"] != ""))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["name"], p["value"])))


def _axes(options: Column) -> Column:
    named = F.transform(
        F.map_entries(options),
        lambda e: F.struct(e["key"].alias("name"), split_list(e["value"]).alias("values")),
    )
    return F.filter(named, lambda a: F.size(a["values"]) > 0)


def _combinations(axes: Column) -> Column:
    return F.aggregate(axes, F.lit(1).cast("bigint"), lambda n, a: n * F.size(a["values"]))


def explode_options(df: DataFrame, options: str, target: str, ordinal: str) -> DataFrame:
    """One row per combination of the listed option values.

    `target` is the combination as a map and `ordinal` its position, the last
    axis varying fastest. Combinations are decoded from their number while rows
    stream out, so a row never holds its whole product.
    """
    axes, count = f"__{target}_axes", f"__{target}_count"
    numbered = (
        df.withColumn(axes, _axes(F.col(options)))
        .withColumn(count, _combinations(F.col(axes)))
        .withColumn(ordinal, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)))
    )

    def pick(axis: Column, i: Column) -> Column:
        stride = _combinations(F.slice(F.col(axes), i + 2, F.size(F.col(axes))))
        position = F.floor(F.col(ordinal) / stride) % F.size(axis["values"])
        return F.struct(axis["name"], F.get(axis["values"], position.cast("int")))

    chosen = F.map_from_entries(F.transform(F.col(axes), pick))
    return (
        numbered.withColumn(target, chosen)
        .withColumn(f"{target}_total", F.col(count))
        .drop(axes, count)
    )


def option_signature(options: Column | str) -> Column:
    """`Colour=Red;Size=M`, sorted by name."""
    entries = F.array_sort(F.map_entries(col(options)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def variant_title(title: Column | str, options: Column | str) -> Column:
    """Title followed by the option values in the order they were given."""
    values = F.map_values(col(options))
    return F.when(F.size(values) == 0, col(title)).otherwise(
        F.concat(col(title), F.lit(" - "), F.array_join(values, " / "))
    )


def identity_signature(cells: Column | str, excluded: Column) -> Column:
    """The merchant's own cells without the excluded columns, folded and sorted."""
    kept = F.filter(F.map_entries(col(cells)), lambda e: ~F.array_contains(excluded, e["key"]))
    parts = F.transform(
        kept, lambda e: F.concat(F.lower(as_text(e["key"])), F.lit("="), fold(e["value"]))
    )
    return F.array_join(F.array_sort(parts), ";")


def semantic_cells(cells: Column | str, consumed: Column) -> Column:
    """Cells without the money and stock columns."""
    return F.map_filter(col(cells), lambda k, v: ~F.array_contains(consumed, k))
