"""What a buyer could have instead: the dearest permitted items a mandate affords.

Comparing every refusal with every item of its merchant would square the largest
merchant. Items are ranked once per shelf instead, a shelf being a merchant's
whole stock or one category of it; a refusal then asks for the few ranks below
its price bound. The rows it reads grow with its cart and the window, not with
the shelf, and nothing affordable is missed. Ranks are prefix sums over range
partitions of (price, tie), in which the bounds asked for stand as rows that count
nothing: items of one price are spread like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import (
    ALTERNATIVES_OFFERED, ALTERNATIVES_WINDOW, DELIVERY_FLAT_MINOR, FREE_DELIVERY_FROM_MINOR,
    TAX_BASIS_POINTS,
)
from ..session import written
from .cart import total_for
from .ranking import prefix_sums, tie_digest

SHELF = ["merchant_id", "shelf"]
ALL_SHELVES = "*"
RANK_BLOCK = 16


def _highest_price(budget, fee: int):
    """Largest price whose total with `fee` stays within the budget (may be negative)."""
    # total(p) = p + fee + half-up 5 % of both: start at the unrounded bound, settle by one step.
    guess = F.floor(budget * 10000 / F.lit(10000 + TAX_BASIS_POINTS)).cast("bigint") - fee

    def total(price):
        base = price + fee
        return base + F.floor((base * TAX_BASIS_POINTS + 5000) / 10000).cast("bigint")

    steps = [guess + 1, guess, guess - 1, guess - 2]
    bound = F.lit(None).cast("bigint")
    for step in reversed(steps):
        bound = F.when(total(step) <= budget, step).otherwise(bound)
    return bound


def price_bounds(refusals: DataFrame) -> DataFrame:
    """One row per affordable price interval of a refusal: at most two.

    Delivery is free from a price on, so the total falls there once: a budget can
    afford prices above that step and still not those right below it.
    """
    budget = F.col("max_value")
    step = FREE_DELIVERY_FROM_MINOR
    low = F.least(_highest_price(budget, DELIVERY_FLAT_MINOR), F.lit(step - 1))
    high = _highest_price(budget, 0)
    intervals = F.array_compact(
        F.array(
            F.when(high >= step, F.struct(F.lit(step).cast("bigint").alias("from"), high.alias("to"))),
            F.when(low >= 1, F.struct(F.lit(1).cast("bigint").alias("from"), low.cast("bigint").alias("to"))),
        )
    )
    # Two intervals that touch are one.
    joined = F.when(
        (F.size(intervals) == 2) & (F.col("__low") == step - 1),
        F.array(F.struct(F.lit(1).cast("bigint").alias("from"), F.col("__high").alias("to"))),
    ).otherwise(intervals)
    return (
        refusals.withColumn("__low", low).withColumn("__high", high)
        .withColumn("interval", F.explode(joined))
        .withColumn("price_from", F.col("interval.from"))
        .withColumn("price_to", F.col("interval.to"))
        .drop("interval", "__low", "__high")
    )


def shelves(catalog: DataFrame) -> DataFrame:
    """Items that can be offered, on the merchant's whole shelf and on their category's."""
    offered = catalog.where("price_minor > 0 AND availability <> 'out_of_stock'").select(
        "merchant_id", "variant_id", "title", "price_minor", "currency", "category"
    )
    return offered.withColumn(
        "shelf", F.explode(F.array(F.lit(ALL_SHELVES), F.col("category")))
    ).withColumn("__tie", tie_digest("variant_id"))


def alternatives(
    refusals: DataFrame,
    lines: DataFrame,
    catalog: DataFrame,
    limit: int = ALTERNATIVES_OFFERED,
) -> DataFrame:
    """Ranked alternatives per refused session.

    `refusals` has session_id, merchant_id, max_value, categories (NULL: any) and
    cart_categories; `lines` are the priced cart lines. Not offered: what is in the
    cart, out of stock or not permitted. The dearest fitting items form a window; in
    it, items of the cart's own categories come first.
    """
    window = max(limit * 4, ALTERNATIVES_WINDOW)
    in_cart = lines.where("error IS NULL").select("session_id", F.col("item_id").alias("variant_id"), "category")

    bounds = price_bounds(
        refusals.where("max_value > 0").select("session_id", "merchant_id", "max_value", "categories")
    )
    wanted = F.when(F.col("categories").isNull(), F.array(F.lit(ALL_SHELVES))).otherwise(
        F.array_distinct("categories")
    )
    asked = bounds.withColumn("shelf", F.explode(wanted)).select(
        "session_id", *SHELF, "price_from", F.col("price_to").alias("price_minor")
    )

    asked = written(asked, "asked")
    # Shelves that no refusal asks for are not ranked.
    stocked = shelves(catalog).join(asked.select(*SHELF).distinct(), SHELF, "left_semi").withColumn("counts", F.lit(1))
    # A bound stands before the items of its price: '' sorts before any digest.
    marks = asked.select(*SHELF, "price_minor").distinct().withColumns({"__tie": F.lit(""), "counts": F.lit(0)})
    ranked = prefix_sums(
        stocked.unionByName(marks, allowMissingColumns=True), SHELF, [F.desc("price_minor"), "__tie", "variant_id"], "counts", "position"
    )
    ranked = written(ranked, "ranked")
    starts = ranked.where("counts = 0").select(*SHELF, "price_minor", F.col("position").alias("above"))
    ladder = ranked.where("counts = 1").select(
        *SHELF, F.floor(F.col("position") / RANK_BLOCK).alias("block"), "position", "variant_id", "title",
        F.col("price_minor").alias("item_price"), "currency", "category",
    )
    # Each cart item can hide one rank, so a shelf is read that much deeper.
    hidden = (
        in_cart.withColumn("shelf", F.explode(F.array(F.lit(ALL_SHELVES), F.col("category"))))
        .groupBy("session_id", "shelf")
        .agg(F.count(F.lit(1)).alias("n_hidden"))
    )
    reads = (
        asked.join(starts, [*SHELF, "price_minor"])
        .join(hidden, ["session_id", "shelf"], "left")
        .withColumn("first", F.col("above") + 1)
        .withColumn("last", F.col("above") + window + F.coalesce("n_hidden", F.lit(0)))
        .withColumn(
            "block",
            F.explode(
                F.sequence(F.floor(F.col("first") / RANK_BLOCK), F.floor(F.col("last") / RANK_BLOCK))
            ),
        )
        .select("session_id", *SHELF, "block", "first", "last", "price_from")
    )
    # Written, so that the shuffles behind it are gone before the items are dealt.
    found = (
        written(reads, "reads").join(ladder, [*SHELF, "block"])
        .where("position BETWEEN first AND last AND item_price >= price_from")
        .select("session_id", "merchant_id", "variant_id", "title", "item_price", "currency", "category")
    )
    # What is in the cart stands beside what was found, so that both are dealt by session once, for the windows too.
    held = in_cart.where("session_id IS NOT NULL AND variant_id IS NOT NULL").select("session_id", "variant_id", F.lit(True).alias("held"))
    same = Window.partitionBy("session_id", "variant_id")
    found = (
        found.withColumn("held", F.lit(False)).unionByName(held, allowMissingColumns=True)
        .repartition("session_id")
        .withColumn("hidden", F.max("held").over(same))
        .where("NOT hidden")
        .drop("held", "hidden")
    )
    dearest = Window.partitionBy("session_id").orderBy(F.desc("item_price"), tie_digest("variant_id"))
    item = F.struct("variant_id", "title", "item_price", "currency", "category")
    topped = (
        found.withColumn("place", F.row_number().over(dearest))
        .where(F.col("place") <= window)
        .groupBy("session_id", "merchant_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))).alias("dearest"))
        .join(refusals.select("session_id", "cart_categories"), "session_id")
    )
    near = lambda e: F.array_contains("cart_categories", e["item"]["category"])
    ordered = F.concat(F.filter("dearest", near), F.filter("dearest", lambda e: ~near(e)))
    return topped.select(
        "session_id", "merchant_id", F.posexplode(F.slice(ordered, 1, limit)).alias("i", "e")
    ).select(
        "session_id", "merchant_id", (F.col("i") + 1).alias("rank"),
        F.col("e.item.variant_id").alias("id"), F.col("e.item.title").alias("title"),
        F.col("e.item.item_price").alias("price_minor"), F.col("e.item.currency").alias("currency"),
        F.col("e.item.category").alias("category"),
    )


def affordable(price, budget):
    """The gate's own test for a cart of one item; for checking what is offered."""
    return total_for(price, F.lit(1)) <= budget
