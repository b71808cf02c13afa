import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long and repeated texts, and columns whose names clash with new ones."""
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, " \t\n", None, None), (4, passage, "en", "b"), (5, passage, "en", "b"),
        (5, passage, "en", "b"), (6, "X " + passage.upper() + " y", "fr", "b"), (None, passage + " z", "fr", None),
        (None, None, None, None), (7, "one two", "de", "c"), (8, "ONE two", "de", "c"), (9, "one", "de", "c"),
        (10, "long " * 30_000, "es", "d"), (11, passage + " " + passage, "en", "b"),
    ]
    schema = "doc_id bigint, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    extra = ["kept", "n_words", "id", "size", "target", "item", "mark", "class", "word", "key", "n", "gone", "again", "leaked",
             "near_id", "mix_bucket", "_c", "_full", "_s", "_b"]
    for name in extra:
        df = df.selectExpr("*", f"'own' as `{name}`")
    return df


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("1 = 0")
