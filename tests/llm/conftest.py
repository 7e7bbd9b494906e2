import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["item_id", "n", "key", "hash", "id", "spans", "start", "group", "fingerprint", "_key", "_doc_id", "part", "shard"]


@pytest.fixture(scope="session")
def docs(spark):
    """Plain, near and exact copies, empty and null texts, a null id, a repeated row, and columns with clashing names."""
    plain = " ".join(f"word{i % 37} thing{i % 41} of the{i % 5}" for i in range(120))
    shared = "this passage stands in several documents and goes on for long enough to count as one that repeats, " * 3
    rows = [
        (1, plain, "en", "a", 1), (2, plain, "en", "a", 1), (3, plain + " end", "en", "b", 1), (4, "", "en", "a", 0), (5, None, None, None, None),
        (None, "a text without an id " * 20, "en", "a", 1), (7, "Ein ganz anderer Text über Züge und Bücher 🙂\n" * 12, "de", "a", 1),
        (7, "Ein ganz anderer Text über Züge und Bücher 🙂\n" * 12, "de", "a", 1), (8, shared + "x y z", "en", "c", 1), (9, "q r s " + shared, "en", "c", 1),
        (10, "a" * 1500, "en", "a", 1), (11, "###", None, "a", 1), (12, "Mail ann@example.com, call +1 (988) 555-2485, card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32 host 10.0.0.1.", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({n: F.lit("x") for n in NAMES})
