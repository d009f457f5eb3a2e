import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import CLASHING, DOCS, documents, prose  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    long = prose(5, 60_000) + "\nReleased under the MIT License.\n"
    rows = [
        (1, prose(1, 80), "en", "a", 1), (1, prose(1, 80), "en", "a", 1), (2, prose(1, 80), None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 3),
        (None, prose(1, 80), "en", "a", 1), (None, None, None, None, None), (6, long, "en", "a", 9), (7, "one two", "en", "a", 7), (8, "one two", "en", "a", 7), (9, "İ Σ \x00   é 日本 😀 <|im_end|>", "xx", "b", 2),
        (100, prose(1, 80) + " " + prose(2, 40), "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit(None).cast("string").alias(c) if i % 2 else F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3).cache()


@pytest.fixture
def docs_of(spark):
    return lambda texts: documents(spark, texts)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (6, None, None), (9, 0, 1), (77, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
