"""Expectation checks: what must hold before a result may be used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: Sequence[str]) -> None:
    if not repeated(df, key).isEmpty():
        raise ValueError(f"keys repeat: {', '.join(key)}")


def require_empty(df: DataFrame, what: str) -> None:
    """Raise if a check that lists violations lists any."""
    if first := df.take(1):
        raise ValueError(f"{what}: {first[0].asDict()}")


def unresolved(questions: DataFrame, documents: DataFrame, key: str = "clean_path") -> DataFrame:
    """Questions whose document is missing."""
    return questions.join(documents.select(key), key, "left_anti")


def assert_complete(report: DataFrame) -> None:
    """Raise unless each producer of a completeness report has all answers and no errors."""
    require_empty(report.where("good <> expected or errors > 0 or missing > 0"), "incomplete")


def assert_one_judge(scores: DataFrame) -> None:
    """Raise if several judge models have scored."""
    if scores.select("judge_model").distinct().limit(2).count() > 1:
        raise ValueError("scores of several judge models")
