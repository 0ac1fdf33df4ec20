"""Aggregates over the long table of metric records, and their slices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "__missing__"


def metric_columns(comparable: Column, value: Column) -> list[Column]:
    """Mean of comparable values, counts, and success and failure if all values are 0 or 1."""
    v = F.when(comparable, value)
    binary = F.bool_and(v.isin(0.0, 1.0))
    return [
        F.bround(F.avg(v), 4).alias("mean"),
        F.count(v).alias("comparable_count"),
        F.count_if(v.isNull()).alias("non_comparable_count"),
        F.when(binary, F.count_if(v == 1.0)).alias("success_count"),
        F.when(binary, F.count_if(v == 0.0)).alias("failure_count"),
    ]


def metric_summary(long: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """long: metric, comparable, value. One pass for all metrics."""
    return long.groupBy(*by).agg(*metric_columns(F.col("comparable"), F.col("value")))


def slices(df: DataFrame, fields: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One group-by for each field and one for all, as grouping sets in a single job.

    slice is the field's name (`overall` for all), slice_value its value as
    text, null as `__missing__`. The aggregates may not read the fields.
    """
    keyed = df.select("*", *[F.coalesce(F.col(f).cast("string"), F.lit(MISSING)).alias(f"_s{i}") for i, f in enumerate(fields)])
    keys = [F.col(f"_s{i}") for i in range(len(fields))]
    grouped = keyed.groupingSets([[k] for k in keys] + [[]], *keys).agg(*aggregates, *[F.grouping(f"_s{i}").alias(f"_g{i}") for i in range(len(fields))])
    pick = lambda values, other: reduce(lambda rest, i: F.when(F.col(f"_g{i}") == 0, values[i]).otherwise(rest), reversed(range(len(fields))), F.lit(other))
    return grouped.select(pick([F.lit(f) for f in fields], "overall").alias("slice"), pick(keys, "all").alias("slice_value"), *[c for c in grouped.columns if not c.startswith(("_s", "_g"))])


def histogram(df: DataFrame, column: str, missing: str = "none") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def time_summary(df: DataFrame, seconds: str, by: Sequence[str] = (), places: tuple[int, int] = (4, 4), rounded=F.bround) -> DataFrame:
    """Count, mean, least, most and total; mean and total to so many places."""
    s = F.col(seconds)
    return df.groupBy(*by).agg(F.count(s).alias("n"), rounded(F.avg(s), places[0]).alias("mean_s"), F.min(s).alias("min_s"), F.max(s).alias("max_s"), rounded(F.sum(s), places[1]).alias("total_s"))


def top_examples(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group in order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def loose_mean(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The mean that counts a missing value as 0, to six places."""
    return df.groupBy(*by).agg(F.bround(F.avg(F.coalesce(F.col(value), F.lit(0.0))), 6).alias("mean"))


def judge_summary(judged: DataFrame, scores: Sequence[str], verdict: str, by: Sequence[str] = ()) -> DataFrame:
    """Means over all records, skipped ones as zeros, and over judged ones alone."""
    zero = lambda c: F.when(F.col("skipped"), 0).otherwise(F.col(c))
    means = [F.bround(F.avg(zero(c)), 4).alias(f"mean_{c}") for c in scores] + [F.bround(F.avg(F.when(~F.col("skipped"), F.col(c))), 4).alias(f"judged_{c}") for c in scores]
    return judged.groupBy(*by, verdict).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("skipped")).alias("n_skipped"), *means)
