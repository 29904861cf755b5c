"""Registered queries over the driver's tables, each with the SQL that states the same result where SQL can."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlens.plans import composing, dates, files, formats, gathering, linking, outputs, scalars, selecting, sequences, tracking  # noqa: F401  they register their queries
from siftlens.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["head_tags_wide"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
