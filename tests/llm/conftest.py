import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, white and long texts, repeated rows, and columns whose names clash."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "Plain words of a text, nothing else here.", "en", "a", 10, "x"),
        (1, "Plain words of a text, nothing else here.", "en", "a", 10, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", None, 0, "x"),
        (4, " \t\n\x0b ", None, "a", 3, None),
        (5, long, "de", "b", len(long), "y"),
        (6, long, "de", "b", len(long), "y"),
        (None, "a text without an id", "en", "a", 5, "z"),
        (7, "äöü \U0001f600 中文 " * 30, "zh", "b", 0, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string")
