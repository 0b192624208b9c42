import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the cat sat on a mat and then it ran off again " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (4, "", "en", "a", 0),
    (None, "Ein Hund und eine Katze sind im Haus und der Garten ist schön", "de", None, 3),
    (5, LONG, "en", "a", None),
    (6, "été français où ça va très bien  \n\n\t fin ", "fr", "c", 9),
    (7, " \t\n ", None, "c", 1),
    (8, "12345 !!! ???", "en", "b", 1),
    (9, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
    (10, "日本語のテキスト 🙂 \x1c x", None, "d", 2),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and a column whose names clash with outputs'."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("shard", "size", "taken", "lang_pred", "entities", "fp", "id", "row", "h", "rank", "key", "component_id"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
