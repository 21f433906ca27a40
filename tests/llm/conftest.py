import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, copies, repeated rows, and columns whose names clash."""
    base = "the quick brown fox jumps over the lazy dog and runs away from here " * 3
    rows = [
        (1, base, "en", 1),
        (2, base, "en", 2),
        (2, base, "en", 2),
        (3, None, "en", None),
        (4, "", None, 4),
        (5, "   \n\t ", None, 5),
        (6, "12345 !!!", "en", 6),
        (7, "le chat noir mange la souris grise dans le jardin vert " * 4, "fr", 7),
        (8, "word " * 50_000, "en", 8),
        (9, "x" * 60_000, "en", 9),
        (None, "some text without an id", "en", 10),
        (None, None, None, None),
        (10, "one", "fr", 11),
    ]
    schema = "doc_id long, text string, lang string, score long"
    df = spark.createDataFrame(rows, schema)
    for clash in ("rank", "row", "cid", "length", "start", "kind"):
        df = df.withColumn(clash, df.score)
    return df


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
