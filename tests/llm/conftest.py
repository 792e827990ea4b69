import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: make_docs(spark, rows)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names clash with results."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
        + [T.StructField(n, T.StringType()) for n in ("score", "kept", "n_lines", "n_words", "component_id", "piece_ids", "decoded", "anchor", "n", "_key", "_set", "key", "bucket", "__n", "__set", "__component", "_runs", "text_key", "_filled")]
    )
    long = " ".join(f"word{i % 97}" for i in range(30_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words in a row of text"), (None, "a b c d e f g"), (None, None), (2, None), (3, ""), (4, "   \n\t "), (5, "x"), (6, long), (7, long), (8, "\n".join(["same line"] * 12)), (9, "漢字 \U0001f600 \x00 ▁ é")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", *["clash"] * 19) for i, t in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
