import hashlib
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from stallbook.operators import catalog, evaluate, feed, grid, jobs, normalize, quality
from stallbook.sources import tables
from stallbook.sources.mandates import decode_mandates, encode_mandates
from stallbook.sources.readings import read_extractions

HEADERS = ["Item", "Price", "MRP", "Stock", "Pack Size"]
READING = (
    "file string, sheet string, source_row int, ord int, title string, title_inferred boolean, category string, "
    "category_confidence double, options map<string,string>, attributes map<string,string>, brand string, "
    "description string, variant_group string, confidence double"
)


def reading(row, title="Shoe", **more):
    base = dict(
        file="f", sheet="s", source_row=row, ord=0, title=title, title_inferred=False, category="footwear", category_confidence=0.9,
        options={}, attributes={}, brand=None, description=None, variant_group=None, confidence=0.9,
    )
    return tuple({**base, **more}.values())


def made(spark, cells, readings, headers=HEADERS):
    rows = spark.createDataFrame(
        [("m", "f", "s", n, headers, c) for n, c in cells.items()],
        "merchant_id string, file string, sheet string, row int, headers array<string>, cells map<string,string>",
    )
    return normalize.variants(grid.with_roles(rows), spark.createDataFrame(readings, READING))


def test_flags_and_values(spark):
    cells = {
        1: {"Item": "Shoe", "Price": "₹ 100/Kg", "Pack Size": "250g", "Stock": "10 pcs"},
        2: {"Item": "சேலை", "Price": "₹ 500 (MRP 700)", "MRP": "₹ 900", "Stock": "ask"},
        3: {"Item": "Tin", "Price": "500-700", "Stock": "no"},
        4: {"Item": "Jar"},
        5: {"Item": "Cup", "Price": "₹ 20", "Stock": "yes"},
    }
    readings = [
        reading(1, options={"Size": "S/M", "Colour": "Red, Blue"}), reading(2, category="gadgets"), reading(3, title_inferred=True),
        reading(4, confidence=0.5), reading(5, "old"), reading(5, "Cup", ord=1, category_confidence=0.69),
        reading(9, "row that is not there"),
    ]
    variants = made(spark, cells, readings)
    got = {(r.row, r.option_ord): r for r in variants.collect()}
    assert len(got) == 8
    assert got[(1, 0)].flags == ["PRICE_AMBIGUOUS", "VARIANTS_SPLIT"] and got[(1, 0)].price_minor == 10000
    assert [got[(1, i)].title for i in range(4)] == ["Shoe - S / Red", "Shoe - S / Blue", "Shoe - M / Red", "Shoe - M / Blue"]
    assert got[(2, 0)].compare_at_minor == 90000 and got[(2, 0)].category_raw == "gadgets"
    assert set(got[(2, 0)].flags) == {"CATEGORY_UNMAPPED", "STOCK_UNKNOWN", "MULTILINGUAL_SOURCE"}
    assert set(got[(3, 0)].flags) == {"PRICE_AMBIGUOUS", "TITLE_INFERRED", "MISSING_REQUIRED_FIELD"} and got[(3, 0)].price_minor == 0
    assert set(got[(4, 0)].flags) == {"MISSING_REQUIRED_FIELD", "STOCK_UNKNOWN"}
    assert got[(5, 0)].title == "Cup" and got[(5, 0)].flags == ["CATEGORY_UNMAPPED"]
    assert quality.check_variants(variants).count() == 0


def test_unread_rows_and_untracked_stock(spark):
    variants = made(spark, {1: {"Item": "Shoe", "Price": "₹ 5"}, 2: {}}, [reading(1)], ["Item", "Price"])
    got = {r.row: r for r in variants.collect()}
    assert got[1].flags == ["STOCK_NOT_TRACKED"] and not got[1].needs_review
    assert (got[2].title, got[2].flags, got[2].product_key) == ("row 2", ["MISSING_REQUIRED_FIELD", "CATEGORY_UNMAPPED"], "__unextracted_2")


def test_identity(spark):
    first = {1: {"Item": "Shoe  White", "Price": "₹ 5"}, 2: {"Item": "Shoe Black", "Price": "₹ 5"}}
    moved = {7: {"Item": "shoe white ", "Price": "₹ 9"}, 8: {"Item": "Shoe Black", "Price": "₹ 5"}}
    a = {r.row: r for r in made(spark, first, [reading(1, variant_group="g"), reading(2, variant_group="g")]).collect()}
    b = {r.row: r for r in made(spark, moved, [reading(7, "Other words"), reading(8)]).collect()}
    assert a[1].variant_id == b[7].variant_id and a[2].variant_id == b[8].variant_id != a[1].variant_id
    assert a[1].product_id == a[2].product_id
    text = "m item=shoe white "
    assert a[1].variant_id == "var_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def test_products_take_the_best_row(spark):
    cells = {n: {"Item": f"i{n}", "Price": "₹ 5", "Stock": "yes"} for n in (1, 2, 3, 4)}
    readings = [
        reading(1, "Guess", title_inferred=True, variant_group="g"), reading(2, "Real", variant_group="g", brand="B"),
        reading(3, "Later", variant_group="g"), reading(4, "Alone", title_inferred=True),
    ]
    variants = made(spark, cells, readings)
    products = normalize.products(variants)
    got = {r.product_key: r for r in products.collect()}
    assert (got["g"].title, got["g"].brand, got["g"].flags, got["g"].n_variants, got["g"].provenance.source_row) == ("Real", "B", [], 3, 1)
    assert got["__row_4"].flags == ["TITLE_INFERRED"]
    held = sorted((r.kind, r.reason) for r in feed.withheld(products, variants).collect())
    assert held == [("product", "TITLE_INFERRED"), ("variant", "TITLE_INFERRED")]
    assert feed.publish_summary(products, variants).first().asDict() == {"merchant_id": "m", "served": 1, "withheld": 2, "stocked": 2}


def published(spark, n=6):
    cells = {i: {"Item": f"i{i}", "Price": f"₹ {i}00", "Stock": ["yes", "no", "ask"][i % 3]} for i in range(1, n + 1)}
    readings = [reading(i, f"T{i}", variant_group="g", attributes={"inner_material": "jute"}, description="d", brand="B") for i in cells]
    variants = made(spark, cells, readings)
    return normalize.products(variants), variants


def test_feed_lines(spark):
    products, variants = published(spark)
    line = json.loads(feed.project_products(products, variants).select(F.to_json("product")).first()[0])
    assert line["description"] == {"plain": "d\nBrand: B"} and [v["price"]["amount"] for v in line["variants"]] == [n * 10000 for n in range(1, 7)]
    assert line["variants"][0]["availability"] == {"available": False, "status": "out_of_stock"}
    assert "availability" not in line["variants"][1] and line["variants"][2]["availability"]["available"] is True
    assert line["variants"][0]["description"] == {"plain": "Inner material: jute"} and "media" not in line


def test_feed_files_replace_one_feed(spark):
    products, variants = published(spark)
    lines = feed.project_products(products, variants)
    other = lines.withColumn("feed_id", F.lit("feed_other"))
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    metadata = feed.feed_metadata(products, "IN", stamp)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    tables.write_feed(lines.unionByName(other), metadata, folder)
    changed = lines.withColumn("product", F.col("product").withField("title", F.lit("new")))
    tables.write_feed(changed, metadata, folder)
    read, stored = tables.read_feed(spark, folder)
    assert {r.feed_id: r.product.title for r in read.collect()} == {"feed_m": "new", "feed_other": "T1"}
    assert stored.first().updated_at == "2024-01-01T00:00:00.000Z"
    assert feed.check_feed(read).count() == 0
    assert read.where("feed_id = 'feed_m'").first().product.variants[1].availability is None
    count, hits = feed.discover(read, "t2", 1)
    assert count.first()[0] == 2 and hits.count() == 1
    tables.write_feed(lines.limit(0), metadata, folder)
    assert [r.feed_id for r in tables.read_feed(spark, folder)[0].collect()] == ["feed_other"]
    spoiled = lines.withColumn("product", F.col("product").withField("id", F.lit(None).cast("string")))
    assert tables.publish(spoiled, metadata, folder).count() > 0 and tables.read_feed(spark, folder, "feed_m")[0].count() == 0
    assert tables.publish(lines, metadata, folder).count() == 0 and tables.read_feed(spark, folder, "feed_m")[0].count() == 1
    assert tables.publish(lines, metadata.withColumn("target_country", F.lit("in")), folder).first().path == "target_country"


def test_catalog(spark):
    products, variants = published(spark, 2)
    sold = catalog.catalog_rows(feed.servable_variants(products, variants), "2024-01-01 00:00:00")
    current = sold.drop("ord").withColumn("title", F.lit("old")).limit(1)
    merged = catalog.upsert_catalog(current, sold)
    assert sorted(r.title for r in merged.collect()) == ["T1", "T2"]
    twice = sold.unionByName(sold.withColumn("title", F.lit("late")).withColumn("ord", F.col("ord").withField("row", F.lit(99))))
    assert {r.title for r in catalog.upsert_catalog(current, twice).collect()} == {"late"}
    changes = merged.where("title = 'T1'").select("merchant_id", "variant_id", F.lit("unknown").alias("availability"), F.lit(2).alias("ord"))
    changes = changes.unionByName(changes.withColumn("availability", F.lit("in_stock")).withColumn("ord", F.lit(1)))
    patched = catalog.patch_catalog(merged, changes, "availability", "2025-01-01 00:00:00").collect()
    assert {r.title: (r.availability, r.updated_at.year) for r in patched} == {"T1": ("unknown", 2025), "T2": ("unknown", 2024)}


def test_digest_levels(spark, monkeypatch):
    monkeypatch.setattr(tables, "DIGEST_LINES", 3)
    lines = [f"line {n}" for n in range(10)]
    df = spark.createDataFrame([("big", n * 5, t) for n, t in enumerate(lines)] + [("small", n, t) for n, t in enumerate(lines[:3])], "feed_id string, ord bigint, line string")
    got = {r.feed_id: r.digest for r in tables.feed_digest(df).collect()}

    def fold(texts):
        h = lambda part: hashlib.sha256("\n".join(part).encode()).hexdigest()
        for _ in range(3):
            texts = [h(texts[i:i + 3]) for i in range(0, len(texts), 3)]
        return texts[0]

    assert got == {"big": fold(lines)[:32], "small": fold(lines[:3])[:32]}


def wire(**more):
    row = dict(
        source_row=1, title="t", title_inferred=False, category="toys", category_confidence=0.5, options=[{"name": "Size", "value": "S"}],
        attributes=[], brand=None, description="d", variant_group=None, confidence=1,
    )
    row.update(more)
    return {k: v for k, v in row.items() if v != "DROP"}


@pytest.mark.parametrize(
    "bad, message",
    [
        ({"category": "gadgets"}, "category"), ({"brand": "DROP"}, "brand"), ({"confidence": 1.01}, "confidence"), ({"confidence": "1"}, "confidence"),
        ({"options": {"Size": "S"}}, "options"), ({"source_row": 1.5}, "source_row"), ({"title": None}, "title"), ({"extra": 1}, "additional"),
        ({"options": [{"name": "a", "value": 1}]}, "options"), ({"title_inferred": 0}, "title_inferred"),
    ],
)
def test_bad_readings_reject_their_batch(spark, bad, message):
    df = spark.createDataFrame([(1, json.dumps({"rows": [wire(), wire(**bad)]})), (2, json.dumps({"rows": [wire()]}))], "b int, payload string")
    valid, rejected = read_extractions(df, ["b"])
    assert [r.b for r in valid.collect()] == [2]
    assert [(r.b, message in r.reason) for r in rejected.collect()] == [(1, True)]


def test_readings_shapes(spark):
    pairs = [{"name": "Size", "value": "S"}, {"name": "", "value": "x"}, {"name": "Size", "value": "M"}, {"name": "Colour", "value": ""}]
    df = spark.createDataFrame(
        [(1, json.dumps({"rows": [wire(options=pairs)]})), (2, "{nope"), (3, "[]"), (4, json.dumps({"rows": []})), (5, json.dumps({"rows": [], "x": 1}))],
        "b int, payload string",
    )
    valid, rejected = read_extractions(df, ["b"])
    assert [(r.b, r.options) for r in valid.collect()] == [(1, {"Size": "M"})]
    reasons = {r.b: r.reason for r in rejected.collect()}
    assert set(reasons) == {2, 3, 5} and reasons[2] == "extraction was not valid JSON"


def test_mandate_headers(spark):
    row = ("m1", "a", "b", 5, "INR", ["home"], None, True, "ünïts?>", "sig")
    schema = "mandate_id string, issued_at string, expires_at string, max_value bigint, max_currency string, categories array<string>, max_items int, single_use boolean, intent_text string, signature string"
    sent = encode_mandates(spark.createDataFrame([row], schema), "h").select("h")
    assert "=" not in sent.first().h
    assert tuple(decode_mandates(sent, "h").drop("h").first()) == row
    bad = spark.createDataFrame([("!!!",), (None,), ("e30",), ("bm9wZQ",)], "h string")
    assert {r.mandate_id for r in decode_mandates(bad, "h").collect()} == {None}


def test_jobs_are_created_once(spark):
    rows = spark.createDataFrame(
        [("m", "f", "s", n, HEADERS, {"Item": f"i{n}", "Price": "5", "Stock": "no", "Pack Size": "1 kg"}) for n in range(2, 9)],
        "merchant_id string, file string, sheet string, row int, headers array<string>, cells map<string,string>",
    )
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    none = spark.createDataFrame([], "job_id string")
    made_jobs, batches, job_rows = jobs.create_jobs(rows, none, now, 3)
    assert [r.batch_index for r in batches.orderBy("batch_index").collect()] == [0, 1, 2]
    assert set(job_rows.first().semantic_cells) == {"Item", "Pack Size"}
    again = jobs.create_jobs(rows, made_jobs, now, 3)
    assert [df.count() for df in again] == [0, 0, 0]


def test_guards_fire(spark):
    labels = spark.createDataFrame(
        [("f", "s", 1, {"a": "b"}, ["x"], [], ["red"], None, False, None, 5), ("f", "s", 2, {"a": "b"}, [], ["toys"], ["red"], ["M"], False, True, None)],
        "file string, sheet string, source_row int, raw map<string,string>, title array<string>, category array<string>, colour array<string>, size array<string>, title_inferred boolean, price_ambiguous boolean, price bigint",
    )
    scores = spark.createDataFrame([("title", True)], "field string, ok boolean")
    provenance = spark.createDataFrame([("origin", "TODO: shop"), ("method", "typed")], "name string, value string")
    got = {(r.guard, r.subject) for r in evaluate.eval_guards(labels, scores, provenance).collect()}
    assert got == {
        ("unscored_field", "category"), ("unscored_field", "colour"), ("unscored_field", "size"), ("unscored_field", "price_parsed"),
        ("unscored_field", "price_ambiguous_flagged"), ("single_valued_field", "category"), ("single_valued_field", "colour"),
        ("single_valued_field", "size"), ("provenance_missing", "origin"),
    }
