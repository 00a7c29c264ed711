import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("binfold-llm-tests")
        .config("spark.sql.shuffle.partitions", "3").config("spark.sql.codegen.wholeStage", "false").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "s1"), (2, "alpha BETA gamma delta epsilon zeta eta theta", "en", "s1"),
        (3, None, "en", "s2"), (4, "", None, None), (5, "short", "fr", "s2"), (6, "short", "fr", "s2"), (6, "short", "fr", "s2"),
        (7, "one two three four five six seven eight nine ten eleven twelve", "de", "s3"), (8, "one two three four five six seven eight nine ten eleven twelve more", "de", None),
        (9, "word " * 5000, "en", "s1"), (10, "   \t\n ", "en", "s1"), (None, "no id here at all my friend", "en", "s1"), (11, "É é 123 !!!", "fr", "s3"),
    ]
    return spark.createDataFrame([(*r, i, i * 2, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, bucket long, kept string")
