import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
LONG = "Long words here. " * 150_000  # 2.5 million characters
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 3), (4, "one", "en", None, 3),
    (5, "one two three four\nsame line\nsame line", "en", "a", 10), (5, "one two three four\nsame line\nsame line", "en", "a", 10),
    (6, "Über Straße größer\nsame line", "de", "a", 1), (7, "Released under the MIT License.\nsame line", "en", "a", 1),
    (8, "#$%& 123 ... !!", "en", "b", 1), (9, LONG, "en", "b", 1), (None, "no id same line", "en", "b", 1), (10, "x" * 1_500_000, None, None, None),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use."""
    rows = spark.createDataFrame(EDGE, DOC_SCHEMA)
    taken = ("_key", "_bucket", "_unit", "size", "shard", "slot", "id", "key", "a", "b", "component", "host", "length", "_host", "_lines", "lang_pred", "score", "y", "n_shingles")
    return rows.withColumns({c: F.lit("taken") for c in taken})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
