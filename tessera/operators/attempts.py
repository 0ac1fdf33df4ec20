"""Replays of attempt logs: best attempts, changes, running bests, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_attempt(log: DataFrame, item: str, attempt: str, score: Column) -> DataFrame:
    """The attempt with the highest score of each item; the first of equal ones. One partial aggregate, no sort."""
    return log.groupBy(item).agg(F.max_by(F.col(attempt), F.struct(score.alias("s"), (-F.col(attempt)).alias("a"))).alias("best_attempt"), F.max(score).alias("best_score"), F.count(F.lit(1)).alias("n_attempts"))


def changes(log: DataFrame, item: str, attempt: str, score: Column) -> DataFrame:
    """Each attempt against the one before: better, worse, same, or first."""
    now = log.withColumn("score", score)
    before = F.lag("score").over(Window.partitionBy(item).orderBy(attempt))
    verdict = F.when(before.isNull(), "first").when(F.col("score") > before, "better").when(F.col("score") < before, "worse").otherwise("same")
    return now.withColumn("previous", before).withColumn("change", verdict)


def running_best(log: DataFrame, item: str, attempt: str, score: Column) -> DataFrame:
    order = Window.partitionBy(item).orderBy(attempt).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("best_so_far", F.max(score).over(order))


def window_accuracy(log: DataFrame, group: Sequence[str], position: str, size: int, correct: Column) -> DataFrame:
    """Accuracy of each window of `size` rows, and of all rows up to its end."""
    windows = log.groupBy(*group, F.floor(F.col(position) / size).cast("long").alias("window")).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("n_correct"))
    so_far = Window.partitionBy(*group).orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    return windows.select(*group, "window", "n", "n_correct", F.bround(F.col("n_correct") / F.col("n"), 4).alias("accuracy"), F.bround(F.sum("n_correct").over(so_far) / F.sum("n").over(so_far), 4).alias("cumulative_accuracy"))


def diagnostic_score(parts: Sequence[tuple[Column, int]], always: int = -8) -> Column:
    """An additive score of flags; `always` is what every attempt loses."""
    total = F.lit(always)
    for flag, points in parts:
        total = total + F.when(flag, points).otherwise(0)
    return total


def metric_value(record: Column) -> Column:
    """A metric record's `value`, else its `f1`. record: a struct of both."""
    return F.coalesce(record["value"], record["f1"])


def metric_true(value: Column) -> Column:
    return F.coalesce(value.cast("double") >= 1.0, F.lit(False))


def metric_float(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def supervised_score(exact: Column, executed: Column, answer_f1: Column, reference_f1: Column, extracted: Column) -> Column:
    """A struct that orders attempts by the gold: answers count only where the query ran, references where one was found."""
    ran, found = metric_true(executed), metric_true(extracted)
    return F.struct(metric_true(exact).cast("int").alias("exact"), ran.cast("int").alias("executed"), F.when(ran, metric_float(answer_f1)).otherwise(0.0).alias("answer_f1"), F.when(found, metric_float(reference_f1)).otherwise(0.0).alias("reference_f1"), found.cast("int").alias("extracted"))


def gold_free_score(extracted: Column, extraction: Column, executed: Column, status: Column, error: Column, hallucinated: Column, unmapped: Column, result_type: Column, rows: Column) -> Column:
    """An additive score of what can be known without the gold. Flags are booleans; `unmapped`: is there a record; rows: of the result, null without one."""
    said, status, error = F.lower(F.coalesce(extraction, F.lit(""))), F.lower(F.coalesce(status, F.lit(""))), F.coalesce(error, F.lit(False))
    # The points of each sign.
    signs = [(extracted, 10), (said.contains("ok"), 8), (said.contains("missing") | said.contains("failure"), -6), (executed, 15), (status == "ok", 5), (status.contains("error"), -8), (error, -8), (~error, 2), (hallucinated, -8), (unmapped, -8), ((F.lower(result_type) == "select") & (rows == 0), -2)]
    total = F.lit(0)
    for sign, points in signs:
        total = total + F.when(F.coalesce(sign, F.lit(False)), points).otherwise(0)
    return total


def good_enough(score: Column, gold_free: Column, refinement: Column) -> Column:
    """Refinement wants an exact, executed, extracted query close to the gold's references; repair a high gold-free score."""
    exact = (score["exact"] == 1) & (score["executed"] == 1) & (score["extracted"] == 1) & (score["reference_f1"] >= 0.90)
    return F.when(refinement, exact).otherwise(gold_free >= 30)


def first_accepted(log: DataFrame, item: str, attempt: str, accepted: Column, tokens: str) -> DataFrame:
    """Of each item the first accepted attempt (null if none) and the tokens spent up to it, or on all."""
    log = log.withColumn("_ok", accepted)
    first = log.groupBy(item).agg(F.min(F.when(F.col("_ok"), F.col(attempt))).alias("accepted_attempt"))
    spent = F.sum(F.when(F.col("accepted_attempt").isNull() | (F.col(attempt) <= F.col("accepted_attempt")), F.col(tokens)).otherwise(0)).alias("tokens")
    return log.join(first, item).groupBy(item, "accepted_attempt").agg(spent)


def not_yet_correct(items: DataFrame, correct: Column, position: str, most: int | None = None) -> DataFrame:
    """Items that aren't correct yet, the first `most` of them in order."""
    kept = items.where(~F.coalesce(correct, F.lit(False)))
    return kept if most is None else kept.orderBy(position).limit(most)
