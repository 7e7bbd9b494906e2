import random

from pyspark.sql import functions as F

from stallbook.operators import grid
from stallbook.operators.ranking import positions

CELLS = "file string, sheet string, row int, col int, text string, master_row int"


def cells(spark, **sheets):
    rows = []
    for name, lines in sheets.items():
        for r, line in enumerate(lines, 1):
            rows += [("f", name, r, c, v, None) for c, v in enumerate(line, 1) if v is not None]
    return spark.createDataFrame(rows, CELLS)


def structured(spark, merges=None, **sheets):
    headers, rows, skipped = grid.structure_sheets(cells(spark, **sheets), merges)
    return (
        {h.sheet: h for h in headers.collect()},
        sorted(rows.collect(), key=lambda r: (r.sheet, r.row)),
        sorted((s.sheet, s.row, s.reason) for s in skipped.collect()),
    )


def test_preamble_and_junk(spark):
    headers, rows, skipped = structured(
        spark,
        s=[["Shop"], [], ["Rates from today"], [None], ["Item", "Price", " "], ["Shoe", "899", ""], ["Sock", "₹ 20"], [None, ""],
           ["Grand Total", "919"], ["Note: taxes extra"], ["ring 98765 43210"], ["", "*subject to change"]],
    )
    assert headers["s"].header_row == 5 and headers["s"].headers == ["Item", "Price"] and headers["s"].header_score == 1.0
    assert [(r.row, r.cells) for r in rows] == [(6, {"Item": "Shoe", "Price": "899"}), (7, {"Item": "Sock", "Price": "₹ 20"})]
    assert skipped == [("s", 1, "preamble"), ("s", 2, "preamble"), ("s", 3, "preamble"), ("s", 4, "preamble"),
                       ("s", 8, "blank"), ("s", 9, "junk"), ("s", 10, "junk"), ("s", 11, "junk"), ("s", 12, "junk")]


def test_header_variants(spark):
    headers, rows, _ = structured(
        spark,
        two=[["Product Details", "Product Details", "Pricing"], ["Name", "Code", "MRP"], ["Cup", "A1", "20"]],
        none=[["Tin", "10"], ["Jar", "12", "", "x"]],
        tamil=[["பொருள்", "விலை"], ["சேலை", "₹ 57/Pack"]],
        words=[["Item", "Price"], ["Shoe", "ask"]],
        late=[["x"]] * 15 + [["Item", "Price"], ["Shoe", "1"]],
        gap=[["Item", "Price"], [], [], ["Shoe", "1"]],
    )
    assert headers["two"].header_row == 2
    assert headers["none"].header_row is None and headers["none"].headers == ["col_1", "col_2", "col_3", "col_4"]
    assert headers["none"].header_score == 0.0
    assert headers["tamil"].header_row == 1
    assert headers["words"].header_row is None
    assert headers["late"].header_row is None
    assert headers["gap"].header_row == 1
    jar = [r for r in rows if r.sheet == "none" and r.row == 2][0]
    assert jar.cells == {"col_1": "Jar", "col_2": "12", "col_4": "x"} and jar["values"] == ["Jar", "12", "", "x"]


def test_next_row_after_the_searched_ones(spark):
    headers, _, _ = structured(spark, s=[[]] * 14 + [["Item", "Price"], [], ["Shoe", "1"]])
    assert headers["s"].header_row == 15


def test_repeated_header_keeps_last(spark):
    _, rows, _ = structured(spark, s=[["Item", "Price", "Price"], ["a", "1", "2"], ["b", "3", ""]])
    assert [r.cells for r in rows] == [{"Item": "a", "Price": "2"}, {"Item": "b", "Price": "3"}]


def test_merged_category(spark):
    lines = [["Category", "Item", "Price"], ["Footwear", "Shoe", "1"], [None, "Slipper", "2"], [None, "Sandal", "3"], ["Bags", "Bag", "4"]]
    merges = spark.createDataFrame([("f", "s", 2, 1, 4, 1)], "file string, sheet string, r1 int, c1 int, r2 int, c2 int")
    _, rows, _ = structured(spark, merges, s=lines)
    assert [r.cells["Category"] for r in rows] == ["Footwear", "Footwear", "Footwear", "Bags"]
    assert [r.inherited for r in rows] == [{}, {"Category": 2}, {"Category": 2}, {}]


def test_roles_prefer_the_sale_price(spark):
    df = spark.createDataFrame([(["Item", "MRP", "Sale Price", "Rate", "Qty "],), (["Name", "Size"],)], "headers array<string>")
    got = grid.with_roles(df).drop("headers").collect()
    assert got[0].asDict() == {"price_field": "Sale Price", "list_price_field": "MRP", "stock_field": "Qty ", "pack_size_field": None}
    assert set(got[1].asDict().values()) == {None}


def test_duplicates(spark):
    rows = spark.createDataFrame(
        [("f", "a", 1, {"Item": "Canvas Shoe", "Price": "1"}), ("f", "b", 2, {"Item": " canvas  SHOE ", "Price": "1", "Size": "9"}),
         ("f", "a", 3, {"Item": "Chappal", "Price": "5"}), ("f", "b", 4, {"Item": "Chappal", "Price": "6"}), ("f", "a", 5, {"Price": "9"})],
        "file string, sheet string, row int, cells map<string,string>",
    )
    groups, members = grid.find_duplicates(rows, "Item", ["file"])
    assert sorted((g.key, g.n_rows, g.conflicting) for g in groups.collect()) == [("canvas shoe", 2, []), ("chappal", 2, ["Price"])]
    assert sorted(m.row for m in members.collect()) == [1, 2, 3, 4]


def test_positions_are_a_prefix_sum_over_partitions(spark):
    random.seed(3)
    orders = random.sample(range(-500, 10**15), 4000)  # sparse: no two values lie near each other
    rows = [(None if n % 7 == 3 else 0 if n % 7 else n % 3, n) for n in orders]
    df = spark.createDataFrame(rows, "g int, o bigint").repartition(7)
    got = {(r.g, r.o): r.p for r in positions(df, ["g"], ["o"], "p").collect()}
    for g in {g for g, _ in rows}:
        expected = sorted(n for own, n in rows if own == g)
        assert [got[(g, n)] for n in expected] == list(range(1, len(expected) + 1))
    assert positions(df.where("false"), ["g"], ["o"], "p").collect() == []


def test_positions_of_ties_nulls_and_one_group_of_all_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 5), (1, 4)], "g int, o int")
    got = sorted((r.p, r.o) for r in positions(df, ["g"], ["o"], "p").collect())
    assert got == [(1, None), (2, 4), (3, 5), (4, 5)]
    many = spark.range(20_000).select(F.lit("one").alias("g"), (F.col("id") * 10**9).alias("o")).repartition(5)
    placed = positions(many, ["g"], [F.desc("o")], "p")
    assert placed.where("o <> (20000 - p) * 1000000000").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 20_000  # no task numbers the whole group


def test_chunk_sizes(spark):
    df = spark.range(23).select(F.lit("j").alias("j"), (F.col("id") * 7).alias("o"))
    got = [r.batch_index for r in grid.chunk(df, ["j"], "o", 10).orderBy("o").collect()]
    assert got == [0] * 10 + [1] * 10 + [2] * 3
