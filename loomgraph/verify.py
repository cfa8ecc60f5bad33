"""Comparison of two results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with ``side``; multiplicity counts."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def same_lines(left: list[str], right: list[str]) -> bool:
    """Whether two texts have equal lines in equal order."""
    return left == right
