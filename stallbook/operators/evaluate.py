"""Readings against hand labels: scores, accuracy, misses, guards, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .ranking import positions

ROW = ["file", "sheet", "source_row"]
_STRINGS = "array<string>"


def label_skeleton(rows: DataFrame) -> DataFrame:
    """A blank label for every data row, beside its raw cells."""
    empty, none = F.array().cast(_STRINGS), F.lit(None).cast(_STRINGS)
    return rows.select(
        "file", "sheet", F.col("row").alias("source_row"), F.col("cells").alias("raw"),
        empty.alias("title"), empty.alias("category"), none.alias("colour"), none.alias("size"),
        F.lit(False).alias("title_inferred"),
    )


def is_labelled() -> Column:
    return (F.size("title") > 0) | (F.size("category") > 0)


def _one_of(value: Column, accepted: Column) -> Column:
    return F.coalesce(F.exists(accepted, lambda a: fold(a) == fold(value)) & value.isNotNull(), F.lit(False))


def _option(options: Column, names: list[str]) -> Column:
    hits = F.filter(F.map_entries(options), lambda e: fold(e["key"]).isin(*names))
    return F.get(hits, F.lit(0))["value"]


def _scored(field: str, when: Column, ok: Column, got: Column, want: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(field).alias("field"), F.coalesce(ok, F.lit(False)).alias("ok"),
            got.cast("string").alias("got"), want.cast("string").alias("want"),
        ),
    )


def first_variants(variants: DataFrame, by: list[str]) -> DataFrame:
    """The first variant of every row."""
    kept = F.struct("category", "price_minor", "flags")
    return variants.groupBy(*by, "file", "sheet", F.col("row").alias("source_row")).agg(
        F.min_by(kept, "option_ord").alias("variant")
    )


def score(labels: DataFrame, readings: DataFrame, variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long scores: one row per labelled row and field with ok, got and want.

    `by` names further key columns that labels, readings and variants all carry,
    such as a provider under comparison.
    """
    by = by or []
    labelled = labels.where(is_labelled())
    last = readings.groupBy(*by, *ROW).agg(
        F.max_by(F.struct("title", "title_inferred", "options"), "ord").alias("reading")
    )
    joined = labelled.join(last, [*by, *ROW], "left").join(first_variants(variants, by), [*by, *ROW], "left")
    read = F.col("reading").isNotNull() & F.col("variant").isNotNull()
    title, inferred = F.col("reading.title"), F.col("reading.title_inferred")
    colour = _option(F.col("reading.options"), ["colour", "color"])
    size = _option(F.col("reading.options"), ["size"])
    joined_labels = lambda c: F.array_join(c, "|")
    flagged = F.array_contains("variant.flags", "PRICE_AMBIGUOUS")
    raised = F.array_join("variant.flags", ",")
    ambiguous = F.coalesce(F.col("price_ambiguous"), F.lit(False))
    scores = F.array(
        _scored("row_returned", F.lit(True), read, F.when(read, "ok").otherwise("MISSING"), F.lit("an entry")),
        _scored("title", read & (F.size("title") > 0),
                F.exists("title", lambda k: F.contains(fold(title), fold(k))), title, joined_labels("title")),
        _scored("category", read & (F.size("category") > 0),
                _one_of(F.col("variant.category"), F.col("category")), F.col("variant.category"), joined_labels("category")),
        _scored("title_inferred", read, inferred == F.col("title_inferred"), inferred, F.col("title_inferred")),
        _scored("colour", read & F.col("colour").isNotNull(), _one_of(colour, F.col("colour")),
                F.coalesce(colour, F.lit("—")), joined_labels("colour")),
        _scored("size", read & F.col("size").isNotNull(), _one_of(size, F.col("size")),
                F.coalesce(size, F.lit("—")), joined_labels("size")),
        _scored("price_ambiguous_flagged", read & ambiguous, flagged,
                F.when(flagged, "PRICE_AMBIGUOUS").when(raised != "", raised).otherwise("no flag"),
                F.lit("PRICE_AMBIGUOUS")),
        _scored("price_parsed", read & ~ambiguous & F.col("price").isNotNull(),
                F.col("variant.price_minor") == F.col("price"), F.col("variant.price_minor"), F.col("price")),
    )
    raw = F.array_join(F.map_values("raw"), " | ")
    return joined.select(*by, *ROW, raw.alias("raw"), F.explode(F.array_compact(scores)).alias("s")).select(
        *by, *ROW, "s.*", "raw"
    )


def accuracy(scores: DataFrame) -> DataFrame:
    """Correct and total per field, and over all fields (field NULL)."""
    return scores.rollup("field").agg(
        F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("total")
    ).withColumn("percent", F.round(F.col("ok") * 100 / F.col("total"), 0).cast("int"))


def misses(scores: DataFrame) -> DataFrame:
    return scores.where("NOT ok").select(*ROW, "field", "got", "want", "raw")


def eval_guards(labels: DataFrame, scores: DataFrame, provenance: DataFrame) -> DataFrame:
    """Reasons not to trust an accuracy number: (guard, subject).

    A labelled field that scored nothing; a field with one distinct label; label
    provenance still to be filled in. `provenance` has name and value.
    """
    labelled = labels.where(is_labelled())
    ambiguous = F.coalesce("price_ambiguous", F.lit(False))
    present = F.array_compact(
        F.array(
            F.when(F.size("title") > 0, F.lit("title")),
            F.when(F.size("category") > 0, F.lit("category")),
            F.when(F.col("colour").isNotNull(), F.lit("colour")),
            F.when(F.col("size").isNotNull(), F.lit("size")),
            F.when(~ambiguous & F.col("price").isNotNull(), F.lit("price_parsed")),
            F.when(ambiguous, F.lit("price_ambiguous_flagged")),
        )
    )
    expected = labelled.select(F.explode(present).alias("field")).distinct()
    unscored = expected.join(scores.select("field").distinct(), "field", "left_anti").select(
        F.lit("unscored_field").alias("guard"), F.col("field").alias("subject")
    )
    stated = labelled.select(
        F.explode(
            F.create_map(F.lit("category"), F.col("category"), F.lit("colour"), F.col("colour"),
                         F.lit("size"), F.col("size"))
        ).alias("field", "values")
    ).select("field", F.explode("values").alias("value"))
    single = (
        stated.groupBy("field")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .where("low = high")
        .select(F.lit("single_valued_field").alias("guard"), F.col("field").alias("subject"))
    )
    todo = provenance.where(F.col("value").rlike("^TODO")).select(
        F.lit("provenance_missing").alias("guard"), F.col("name").alias("subject")
    )
    return unscored.unionByName(single).unionByName(todo)


def bakeoff(scores: DataFrame, providers: list[str]) -> DataFrame:
    """Accuracy matrix: one row per field, ok and total of every provider."""
    return (
        scores.groupBy("field")
        .pivot("provider", providers)
        .agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("total"))
    )


def disagreements(scores: DataFrame) -> DataFrame:
    """What each provider got wrong, for rows and fields where any did."""
    wrong = F.when(~F.col("ok"), F.struct("provider", "got"))
    return (
        scores.groupBy(*ROW, "field", "want")
        .agg(
            F.count_if(~F.col("ok")).alias("n_wrong"),
            F.count_if("ok").alias("n_right"),
            # One entry per provider: as many as are compared.
            F.array_sort(F.collect_set(wrong)).alias("wrong"),
        )
        .where("n_wrong > 0")
    )


def run_history(runs: DataFrame) -> DataFrame:
    """Runs of each suite in order, with the movement of the score.

    `runs`: suite, run_no (distinct in a suite), run_date, model_served,
    prompt_sha256, ok, total, note. A run meets its predecessor by position.
    """
    placed = positions(runs, ["suite"], ["run_no"], "place")
    before = placed.select(
        "suite", (F.col("place") + 1).alias("place"),
        F.col("ok").alias("ok_before"), F.col("total").alias("total_before"),
    )
    return placed.join(before, ["suite", "place"], "left").select(
        "suite", F.col("place").alias("run"), "run_date", "model_served",
        F.col("prompt_sha256").alias("prompt"), "ok", "total",
        F.round(F.col("ok") * 100 / F.col("total"), 0).cast("int").alias("percent"),
        (F.col("ok") - F.col("ok_before")).alias("ok_change"),
        (F.col("total") - F.col("total_before")).alias("total_change"),
        "note",
    )


def latency_summary(calls: DataFrame) -> DataFrame:
    """Per provider: how call time scales with batch size, and the cheapest size.

    `calls`: provider, size, ms, error. Sizes are averaged first.
    """
    sizes = calls.where("error IS NULL").groupBy("provider", "size").agg(F.avg("ms").alias("ms"))
    per_row = F.col("ms") / F.col("size")
    ends = sizes.groupBy("provider").agg(
        F.min("size").alias("smallest"), F.max("size").alias("largest"),
        F.min_by("ms", "size").alias("ms_smallest"), F.max_by("ms", "size").alias("ms_largest"),
        F.min_by("size", F.struct(per_row, "size")).alias("best_size"),
        F.min(per_row).alias("best_ms_per_row"),
    )
    scaling = (F.col("ms_largest") / F.col("ms_smallest")) / (F.col("largest") / F.col("smallest"))
    return ends.withColumn("scaling", scaling).withColumn(
        "driver",
        F.when(F.col("scaling") < 0.5, "per_call").when(F.col("scaling") > 0.8, "per_row").otherwise("mixed"),
    )


def failure_reasons(calls: DataFrame) -> DataFrame:
    """Rows lost per reason, the reason being the whole error."""
    return calls.where("error IS NOT NULL").groupBy(F.col("error").alias("reason")).agg(
        F.sum("size").alias("n_rows"), F.count(F.lit(1)).alias("n_calls")
    )
