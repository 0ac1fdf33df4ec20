"""Comparisons of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def side_by_side(df: DataFrame, key: Sequence[str], run: str, runs: Sequence[str], value: Column, fill: float | None = None) -> DataFrame:
    """One column for each run. Runs are named, so no extra pass looks for them."""
    wide = df.groupBy(*key).pivot(run, list(runs)).agg(value)
    return wide if fill is None else wide.fillna(fill, list(runs))


def against_baseline(df: DataFrame, key: Sequence[str], run: str, value: str, baseline: str) -> DataFrame:
    """Each run's value less the baseline's, in percentage points; the baseline is one value for each key."""
    base = F.max(F.when(F.col(run) == baseline, F.col(value))).over(Window.partitionBy(*key))
    return df.select(*key, run, value, F.bround((F.col(value) - base) * 100, 1).alias("delta_pp"))


def top_category(df: DataFrame, group: Sequence[str], category: str) -> DataFrame:
    """The most frequent category of each group; the first by name of equal ones."""
    counts = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), category)
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")
