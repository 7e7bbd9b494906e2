import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from stallbook.functions import digest, flags, money, options, quantity, text

PRICES = [
    # text, amount, reference, unit, flags
    ("2799", 279900, None, None, ["CURRENCY_ASSUMED"]),
    ("2,799", 279900, None, None, ["CURRENCY_ASSUMED"]),
    ("₹2799", 279900, None, None, []),
    ("₹ 2,799", 279900, None, None, []),
    ("Rs. 1,299/-", 129900, None, None, []),
    ("2799/-", 279900, None, None, ["CURRENCY_ASSUMED"]),
    ("2.8k", 280000, None, None, ["CURRENCY_ASSUMED"]),
    ("1.5K", 150000, None, None, ["CURRENCY_ASSUMED"]),
    ("₹2.8k", 280, None, None, []),
    ("2799 (MRP 3499)", 279900, 349900, None, ["CURRENCY_ASSUMED"]),
    ("2799 [M.R.P. : 3,499]", 279900, 349900, None, ["CURRENCY_ASSUMED"]),
    ("2799 (MRP 2000)", 279900, None, None, ["CURRENCY_ASSUMED"]),
    ("899.50", 89950, None, None, ["CURRENCY_ASSUMED"]),
    ("899.567", 89957, None, None, ["CURRENCY_ASSUMED", "PRICE_AMBIGUOUS"]),
    ("279242.16", 27924216, None, None, ["CURRENCY_ASSUMED"]),
    ("500-700", None, None, None, ["PRICE_AMBIGUOUS"]),
    ("500 to 700", None, None, None, ["PRICE_AMBIGUOUS"]),
    ("₹500 – 700", None, None, None, ["PRICE_AMBIGUOUS"]),
    ("Call for price", None, None, None, ["CURRENCY_ASSUMED", "MISSING_REQUIRED_FIELD"]),
    ("", None, None, None, ["MISSING_REQUIRED_FIELD"]),
    (None, None, None, None, ["MISSING_REQUIRED_FIELD"]),
    (" 　 ", None, None, None, ["MISSING_REQUIRED_FIELD"]),
    ("0.50", 50, None, None, ["CURRENCY_ASSUMED", "PRICE_OUT_OF_BAND"]),
    ("50,00,000", 500000000, None, None, ["CURRENCY_ASSUMED", "PRICE_OUT_OF_BAND"]),
    ("₹ 57/Pack", 5700, None, "Pack", []),
    ("₹ 100/Kg", 10000, None, "Kg", []),
    ("INR 80 per litre", 8000, None, "litre", []),
    ("1" * 25, None, None, None, ["CURRENCY_ASSUMED", "PRICE_OUT_OF_BAND"]),
]


def test_prices(spark):
    rows = [(i, p[0]) for i, p in enumerate(PRICES)]
    parsed = money.with_price(spark.createDataFrame(rows, "i int, t string"), "t", "p").orderBy("i").collect()
    got = [(r.t, r.p.amount_minor, r.p.compare_at_minor, r.p.rate_unit, r.p.flags) for r in parsed]
    assert got == [tuple(p) for p in PRICES]


STOCK = [
    ("yes", "in_stock", None), ("no", "out_of_stock", None), ("✓", "in_stock", None), ("✗", "out_of_stock", None),
    ("Y", "in_stock", None), ("N", "out_of_stock", None), (None, "unknown", None), ("10 pcs", "in_stock", 10),
    ("0", "out_of_stock", 0), ("24", "in_stock", 24), ("out of stock", "out_of_stock", None),
    ("not available", "out_of_stock", None), ("available", "in_stock", None), ("ask", "unknown", None),
    ("-", "unknown", None), ("12 nos.", "in_stock", 12), ("X", "out_of_stock", None),
]


def test_stock(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(STOCK)], "i int, t string")
    got = df.withColumn("s", quantity.parse_stock("t")).orderBy("i").collect()
    assert [(r.t, r.s.availability, r.s.inventory_count) for r in got] == STOCK


LISTS = [
    ("S/M/L", ["S", "M", "L"]), ("Red, Blue, Black", ["Red", "Blue", "Black"]), ("30 / 32 / 34", ["30", "32", "34"]),
    ("1/2 kg", ["1/2 kg"]), ("5 kg / 10 kg", ["5 kg", "10 kg"]), ("Half Sleeve/Full Sleeve", ["Half Sleeve/Full Sleeve"]),
    ("Half Sleeve / Full Sleeve", ["Half Sleeve", "Full Sleeve"]), ("Blk RunShoe M-9", ["Blk RunShoe M-9"]),
    ("Free Size", ["Free Size"]), (None, []), ("  ", []), ("a;b|c", ["a", "b", "c"]),
]


def test_lists(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(LISTS)], "i int, t string")
    got = df.select("i", "t", options.split_list("t").alias("p")).orderBy("i").collect()
    assert [(r.t, r.p) for r in got] == LISTS


QUANTITIES = [
    ("250g", "mass", 250), ("1 kg", "mass", 1000), ("1,000 gms", "mass", 1000), ("1.5 Ltr", "volume", 1500),
    ("2 x 500 g", None, None), ("dozen", None, None), (None, None, None), ("500 ML", "volume", 500),
]


def test_quantities(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(QUANTITIES)], "i int, t string")
    got = df.withColumn("q", quantity.parse_quantity("t")).orderBy("i").select("t", "q.dimension", "q.base").collect()
    assert [(r[0], r[1], None if r[2] is None else float(r[2])) for r in got] == QUANTITIES


@pytest.mark.parametrize(
    "build, source, wanted",
    [
        (text.has_indic, "பருத்தி சேலை", True),
        (text.has_indic, "Paruthi Sattai", False),
        (text.has_indic, "₹ ✓", False),
        (text.dedupe_key, "  Canvas   SHOE ", "canvas shoe"),
        (text.label, "inner_material", "Inner material"),
        (text.is_absolute_url, "https://a.example/x.jpg", True),
        (text.is_absolute_url, "x.jpg", False),
        (text.is_absolute_url, "ftp://a.example/x", False),
        (text.canonical_id, "order_Ab1", "Ab1"),
        (text.canonical_id, "order_Ab-1", None),
        (text.bearer, " BEARER  tok ", "tok"),
        (text.bearer, "Basic tok", None),
        (text.format_minor, "89905", "₹899.05"),
        (text.valid_feed_id, "feed_1", True),
        (text.valid_feed_id, "../x", False),
        (text.valid_job_id, "job_0123456789abcdef", True),
        (text.classify_failure, "quota and schema validation", "PROVIDER_RATE_LIMITED"),
        (text.classify_failure, "boom", "PROVIDER_ERROR"),
    ],
)
def test_text(spark, build, source, wanted):
    df = spark.createDataFrame([(source,)], "t string")
    assert df.select(build("t")).first()[0] == wanted


@pytest.mark.parametrize("key", ["k", "x" * 100])
def test_hmac_is_the_standard_one(spark, key):
    df = spark.createDataFrame([("naïve ₹",)], "t string")
    assert df.select(digest.hmac_sha256("t", key)).first()[0] == hmac.new(
        key.encode(), "naïve ₹".encode(), hashlib.sha256
    ).hexdigest()


def test_flag_tiers(spark):
    df = spark.createDataFrame([(["CATEGORY_UNMAPPED"],), (["PRICE_AMBIGUOUS", "CURRENCY_ASSUMED"],), ([],)], "f array<string>")
    got = df.select(flags.is_servable("f"), flags.needs_review("f"), flags.withholding_reason("f")).collect()
    assert [tuple(r) for r in got] == [(True, True, "withheld"), (False, True, "PRICE_AMBIGUOUS"), (True, False, "withheld")]


def test_option_combinations_last_axis_fastest(spark):
    df = spark.createDataFrame([(1, {"Size": "S/M", "Fit": "", "Colour": "Red, Blue, Black"}), (2, {})], "i int, o map<string,string>")
    got = options.explode_options(df, "o", "c", "n").orderBy("i", "n").select("i", "n", F.map_values("c")).collect()
    assert [tuple(r) for r in got] == [
        (1, 0, ["S", "Red"]), (1, 1, ["S", "Blue"]), (1, 2, ["S", "Black"]),
        (1, 3, ["M", "Red"]), (1, 4, ["M", "Blue"]), (1, 5, ["M", "Black"]), (2, 0, []),
    ]
