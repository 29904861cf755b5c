import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def shared(spark):
    """The folder for tables in between; unset here, so a temporary one."""
    from siftlens.llm.common import shared_dir

    assert shared_dir(spark) == shared_dir(spark)


@pytest.fixture
def rows(spark, shared):
    """A table of (doc_id, text), with columns whose names clash with those that operators make."""

    def make(pairs):
        df = spark.createDataFrame(pairs, "doc_id long, text string")
        clash = ("id", "n", "node", "key", "score", "items", "spans", "row", "label", "length", "salt", "part", "w", "mask", "found", "scan_text", "sketch")
        return df.select("*", *[F.lit(7).alias(c) for c in clash])

    return make


@pytest.fixture(scope="session")
def documents(spark, shared, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())


def lowered(text):
    """Only A-Z."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
