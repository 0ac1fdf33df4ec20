"""As-of joins without a window over everything, and what a replay of training steps makes of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_last(left: DataFrame, right: DataFrame, time: str, keep: Callable[[DataFrame], DataFrame], by: Sequence[str] = (), value: str = "last") -> DataFrame:
    """The left rows with `value`, a struct of the last right row of their key at or before their time; null where there is none.

    Both sides are dealt into ranges of key and time, so a key of any size is
    spread. Within a range a window looks back; what a range begins with comes
    from the ranges before it: of each key that several ranges hold the last
    right row of each, which are two rows a range at most. Of right rows that
    share key and time the largest counts. Rows of a null time have no match.
    """
    mine = left.withColumn("_row", F.struct(*left.columns))
    own = F.struct(*[c for c in right.columns])
    both = mine.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("_t"), F.lit(1).alias("_left"), "_row").unionByName(
        right.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("_t"), F.lit(0).alias("_left"), own.alias("_own")), allowMissingColumns=True
    )
    parts = keep(both.repartitionByRange(*by, "_t").withColumn("_part", F.spark_partition_id()))
    back = Window.partitionBy("_part", *by).orderBy("_t", "_left", "_own").rowsBetween(Window.unboundedPreceding, 0)
    near = parts.withColumn("_near", F.last("_own", ignorenulls=True).over(back)).where("_left = 1")

    ends = parts.groupBy("_part", *by).agg(F.max(F.when(F.col("_left") == 0, F.struct("_t", "_own"))).alias("_end"))
    if by:
        ends = ends.join(ends.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), list(by))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = keep(ends.withColumn("_carried", F.last(F.col("_end")["_own"], ignorenulls=True).over(before)).drop("_end"))
    named = carried.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_carried")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & near[c].eqNullSafe(F.col(f"_by{i}"))
    found = near.join(F.broadcast(named), same, "left").select("_row.*", F.coalesce("_near", "_carried").alias(value))
    return found.unionByName(left.where(F.col(time).isNull()), allowMissingColumns=True)


def snapshot_scores(evaluations: DataFrame, snapshots: DataFrame, step: str, score: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(snapshot, evaluations, mean, best) of each snapshot that was evaluated: an evaluation is of the last snapshot before it. The first of the best means is `best`."""
    placed = asof_last(evaluations, snapshots.select(step), step, keep)
    means = placed.where(F.col("last").isNotNull()).groupBy(F.col(f"last.{step}").alias("snapshot")).agg(F.count(F.lit(1)).alias("evaluations"), F.bround(F.avg(score), 6).alias("mean"))
    best = means.agg(F.max(F.struct("mean", (-F.col("snapshot")).alias("order"))).alias("top")).select((-F.col("top.order")).alias("_best"))  # one row
    return means.crossJoin(F.broadcast(best)).withColumn("best", F.col("snapshot") == F.col("_best")).drop("_best")


def before_and_after(steps: DataFrame, snapshots: DataFrame, by: str, step: str, right: Column) -> DataFrame:
    """(key, pre, post): how often steps are right before the key's first snapshot, and from it on."""
    first = snapshots.groupBy(by).agg(F.min(step).alias("_first"))
    held = steps.join(first, by, "left").withColumn("_pre", F.col("_first").isNull() | (F.col(step) < F.col("_first"))).withColumn("_right", right.cast("int"))
    mean = lambda when: F.bround(F.avg(F.when(when, F.col("_right"))), 6)
    return held.groupBy(by).agg(mean(F.col("_pre")).alias("pre"), mean(~F.col("_pre")).alias("post"))
