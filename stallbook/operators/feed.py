"""Products and variants -> published feed, withheld report, shelf and discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import feed_id
from ..functions.fixed import MERCHANT_TAXONOMY_NAME, TAXONOMY_NAME
from ..functions.flags import is_servable, withholding_flags, withholding_reason
from ..functions.text import is_absolute_url, label
from .normalize import PRODUCT_KEY

_PRODUCT = ["merchant_id", *PRODUCT_KEY, "product_id"]


def _price(amount: Column, currency: Column) -> Column:
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency")))


def _description(parts: list[Column]) -> Column:
    kept = F.filter(F.array_compact(F.array(*parts)), lambda p: p != "")
    return F.when(F.size(kept) > 0, F.struct(F.array_join(kept, "\n").alias("plain")))


def _media(url: Column, alt: Column) -> Column:
    image = F.struct(F.lit("image").alias("type"), url.alias("url"), alt.alias("alt_text"))
    return F.when(is_absolute_url(url), F.array(image))


def project_variant() -> Column:
    """The published form of a variant row. What is not known is NULL, hence left out."""
    stated = F.col("availability")
    raw = F.col("category_raw")
    own = F.struct(F.col("category").alias("value"), F.lit(TAXONOMY_NAME).alias("taxonomy"))
    merchants = F.struct(raw.alias("value"), F.lit(MERCHANT_TAXONOMY_NAME).alias("taxonomy"))
    prose = F.transform(
        F.map_entries("attributes"), lambda e: F.concat(label(e["key"]), F.lit(": "), e["value"])
    )
    return F.struct(
        F.col("variant_id").alias("id"),
        F.col("title"),
        F.when(F.size(prose) > 0, F.struct(F.array_join(prose, "\n").alias("plain"))).alias("description"),
        _price(F.col("price_minor"), F.col("currency")).alias("price"),
        _price(F.col("compare_at_minor"), F.col("currency")).alias("list_price"),
        F.when(stated == "in_stock", F.struct(F.lit(True).alias("available"), stated.alias("status")))
        .when(stated == "out_of_stock", F.struct(F.lit(False).alias("available"), stated.alias("status")))
        .alias("availability"),
        F.when(raw != "", F.array(own, merchants)).otherwise(F.array(own)).alias("categories"),
        F.when(
            F.size("options") > 0,
            F.transform(
                F.map_entries("options"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))
            ),
        ).alias("variant_options"),
        _media(F.col("image_url"), F.col("title")).alias("media"),
    )


def _with_product_flags(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants beside the servability of their product and of themselves."""
    identity = products.select(
        *_PRODUCT, is_servable("flags").alias("product_servable")
    )
    return variants.join(identity, _PRODUCT).withColumn("variant_servable", is_servable("flags"))


def servable_variants(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants that may be published and bought."""
    return _with_product_flags(products, variants).where("product_servable AND variant_servable").drop(
        "product_servable", "variant_servable"
    )


def feed_variants(products: DataFrame, variants: DataFrame) -> DataFrame:
    """The feed in flat form: one row per published variant."""
    return servable_variants(products, variants).select(
        feed_id("merchant_id").alias("feed_id"), "merchant_id", *PRODUCT_KEY, "product_id",
        "row", "option_ord", project_variant().alias("variant"),
    )


def project_products(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Feed lines: one line per product with its published variants, in sheet order.

    A line is one record of the feed format; it holds the variants of one product.
    """
    lines = feed_variants(products, variants).groupBy("feed_id", *_PRODUCT).agg(
        F.array_sort(F.collect_list(F.struct("row", "option_ord", "variant"))).alias("ordered")
    )
    return lines.join(products, _PRODUCT).select(
        "feed_id", "merchant_id", *PRODUCT_KEY,
        F.get("ordered", F.lit(0))["row"].alias("first_row"),
        F.struct(
            F.col("product_id").alias("id"),
            F.col("title"),
            _description(
                [F.col("description"), F.concat(F.lit("Brand: "), F.col("brand"))]
            ).alias("description"),
            _media(F.col("image_url"), F.col("title")).alias("media"),
            F.transform("ordered", lambda o: o["variant"]).alias("variants"),
        ).alias("product"),
    )


def withheld(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Everything not published, with the true reason.

    A product withheld for its own flags stands for its variants as well.
    """
    flagged = products.where(~is_servable("flags")).select(
        "merchant_id", F.col("product_id").alias("id"), F.lit("product").alias("kind"),
        withholding_reason("flags").alias("reason"),
    )
    judged = _with_product_flags(products, variants).where("product_servable")
    unsafe = judged.where("NOT variant_servable").select(
        "merchant_id", F.col("variant_id").alias("id"), F.lit("variant").alias("kind"),
        withholding_reason("flags").alias("reason"),
    )
    emptied = (
        judged.groupBy(*_PRODUCT)
        .agg(F.max("variant_servable").alias("any_servable"))
        .where("NOT any_servable")
        .select(
            "merchant_id", F.col("product_id").alias("id"), F.lit("product").alias("kind"),
            F.lit("all_variants_withheld").alias("reason"),
        )
    )
    return flagged.unionByName(unsafe).unionByName(emptied)


def feed_metadata(merchants: DataFrame, country: str | None, updated_at: Column) -> DataFrame:
    stamp = F.date_format(updated_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return merchants.select("merchant_id").distinct().select(
        feed_id("merchant_id").alias("id"),
        F.lit(country).cast("string").alias("target_country"),
        stamp.alias("updated_at"),
    )


def publish_summary(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Per merchant: products served, records withheld, variants put on sale."""
    stocked = servable_variants(products, variants)
    served = stocked.select(*_PRODUCT).distinct().groupBy("merchant_id").agg(F.count(F.lit(1)).alias("served"))
    sold = stocked.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("stocked"))
    held = withheld(products, variants).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("withheld"))
    merchants = products.select("merchant_id").distinct()
    return (
        merchants.join(served, "merchant_id", "left")
        .join(held, "merchant_id", "left")
        .join(sold, "merchant_id", "left")
        .fillna(0, ["served", "withheld", "stocked"])
    )


def check_feed(lines: DataFrame) -> DataFrame:
    """Every violation of the published schema: feed_id, product id, path, message.

    `lines` has feed_id and product (the feed line as a struct).
    """

    def broken(test: Column, path: Column | str, message: str) -> Column:
        where = path if isinstance(path, Column) else F.lit(path)
        return F.when(
            F.coalesce(test, F.lit(False)),
            F.struct(where.alias("path"), F.lit(message).alias("message")),
        )

    product = F.col("product")
    on_product = [
        broken(product["id"].isNull(), "/id", "is required"),
        broken(product["variants"].isNull(), "/variants", "is required"),
        broken(product["description"].isNotNull() & product["description"]["plain"].isNull(),
               "/description", "must NOT have fewer than 1 properties"),
    ]

    def on_variant(v: Column, i: Column) -> Column:
        base = F.concat(F.lit("/variants/"), i.cast("string"))

        def at(suffix: str) -> Column:
            return F.concat(base, F.lit(suffix))

        checks = [
            broken(v["id"].isNull(), at("/id"), "is required"),
            broken(v["title"].isNull(), at("/title"), "is required"),
            broken(v["description"].isNotNull() & v["description"]["plain"].isNull(),
                   at("/description"), "must NOT have fewer than 1 properties"),
        ]
        for money in ("price", "list_price"):
            amount, currency = v[money]["amount"], v[money]["currency"]
            checks += [
                broken(v[money].isNotNull() & amount.isNull(), at(f"/{money}/amount"), "is required"),
                broken(amount < 0, at(f"/{money}/amount"), "must be >= 0"),
                broken(v[money].isNotNull() & currency.isNull(), at(f"/{money}/currency"), "is required"),
                broken(~currency.rlike(r"^[A-Z]{3}\z"), at(f"/{money}/currency"), "must match ^[A-Z]{3}$"),
            ]
        for items, fields in (("categories", ["value"]), ("variant_options", ["name", "value"]), ("media", ["type", "url"])):
            for field in fields:
                checks.append(
                    broken(F.exists(v[items], lambda e: e[field].isNull()), at(f"/{items}"), f"{field} is required")
                )
        checks.append(
            broken(F.exists(v["media"], lambda m: ~m["url"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")),
                   at("/media"), "url must match format uri")
        )
        return F.array_compact(F.array(*checks))

    found = F.concat(
        F.array_compact(F.array(*on_product)),
        F.flatten(F.coalesce(F.transform(product["variants"], on_variant), F.array())),
    )
    return lines.select("feed_id", product["id"].alias("id"), F.explode(found).alias("v")).select(
        "feed_id", "id", "v.path", "v.message"
    )


def check_metadata(metadata: DataFrame) -> DataFrame:
    """Violations of the feed's own record: it needs an id, and a country of two capital letters if it names one."""
    found = F.array_compact(F.array(
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.struct(F.lit("id").alias("path"), F.lit("is required").alias("message"))),
        F.when(~F.col("target_country").rlike(r"^[A-Z]{2}\z"), F.struct(F.lit("target_country").alias("path"), F.lit("is not two capital letters").alias("message"))),
    ))
    return metadata.select(F.col("id").alias("feed_id"), F.lit(None).cast("string").alias("id"), F.explode(found).alias("v")).select(
        "feed_id", "id", "v.path", "v.message"
    )


def discover(lines: DataFrame, query: str | None = None, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(matches count, first matches) of a case-insensitive title search in a feed.

    Availability has three states: a feed without it says unknown, not sold out.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    flat = lines.select("feed_id", "product", F.explode("product.variants").alias("v"))
    available = F.col("v.availability.available")
    found = flat.select(
        "feed_id",
        F.col("v.id").alias("id"),
        F.coalesce("v.title", "product.title").alias("title"),
        F.col("v.price.amount").alias("price_minor"),
        F.coalesce("v.price.currency", F.lit("INR")).alias("currency"),
        F.when(available, "in_stock").when(~available, "out_of_stock").otherwise("unknown").alias("availability"),
        F.get("v.categories", F.lit(0))["value"].alias("category"),
    )
    if query:
        found = found.where(F.contains(F.lower("title"), F.lit(query.lower())))
    count = found.agg(F.count(F.lit(1)).alias("n_matched"))
    return count, found.orderBy("feed_id", "id").limit(limit)


def feed_catalog_diff(feed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Variants published but not buyable, and buyable but not published."""
    key = ["merchant_id", "variant_id"]
    published, buyable = feed.select(*key).distinct(), catalog.select(*key).distinct()
    return (
        published.join(buyable, key, "left_anti").withColumn("problem", F.lit("published_not_buyable"))
        .unionByName(
            buyable.join(published, key, "left_anti").withColumn("problem", F.lit("buyable_not_published"))
        )
    )


def latest_shelf(jobs: DataFrame, variants: DataFrame, merchant: str | None = None) -> DataFrame:
    """Variants of each merchant's newest completed job, published or withheld with reasons."""
    complete = jobs.where("status = 'complete'")
    if merchant is not None:
        complete = complete.where(F.col("merchant_id") == merchant)
    newest = complete.groupBy("merchant_id").agg(
        F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id")
    )
    blocking = withholding_flags("flags")
    return variants.join(newest, ["merchant_id", "job_id"]).select(
        "merchant_id", "job_id", "variant_id", "title", "price_minor", "row",
        F.when(F.size(blocking) > 0, "withheld").otherwise("published").alias("shelf"),
        blocking.alias("reasons"),
    )
