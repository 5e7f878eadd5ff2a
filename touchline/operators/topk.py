"""Ranked lists per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """Rows of each group with their place ``pos``, all or the first ``k``; the order must end in a unique key.

    Spark turns ``row_number <= k`` into a group limit before the shuffle, so a hot group
    sends at most k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("pos", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("pos") <= k)
