import pytest

SF_DIR = "/root/testdata/sf0.001"

LONG_LINE = "This line is long enough for the edit join and stands in many documents."


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and names that operators use themselves."""
    text = "One two three four five six seven, mail bob@acme.test or +49 (30) 1234-5678.\n" + LONG_LINE
    rows = [
        (1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, None, "en", "a"), (4, "", None, None),
        (5, "x" * 200_000, "de", "b"), (6, "wort " * 30_000, "de", None), (None, text, "en", "a"), (None, None, None, None),
        (7, LONG_LINE.replace("long", "lng") + "\nshort\n\n" + LONG_LINE, "fr", "b"), (8, "1234 éß 5!", "fr", "a"),
        (9, "\n\n \t\r\n", "en", "a"), (10, text.upper(), "en", "c"), (-11, "negative", "en", "c"), (12, "\U0001f600 你好", "zh", "c"),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clashes = ["id", "key", "node", "digest", "size", "shard", "piece", "p", "place", "pii", "contamination", "line", "n", "first",
               "class_id", "dropped_lines", "dropped_key", "language_answer", "kept_text", "group", "url", "payload", "note"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clashes], F.length("text").cast("long").alias("n_chars"))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
