"""Replays as streams: windows of items, keyed rule records, event windows.

The batch operators in operators.attempts give the same results; these serve
logs that are still being written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RULE_STATE = "helpful long, harmful long, seen long"


def rule_records(tags: DataFrame) -> DataFrame:
    """(family, rule, helpful, harmful, seen) so far, from a stream of (family, rule, tag).

    State is three counters for each rule; it does not grow with the stream.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        helpful, harmful, seen = state.get if state.exists else (0, 0, 0)
        for batch in batches:
            helpful += int((batch["tag"] == "helpful").sum())
            harmful += int((batch["tag"] == "harmful").sum())
            seen += len(batch)
        state.update((helpful, harmful, seen))
        yield pd.DataFrame([(*key, helpful, harmful, seen)], columns=["family", "rule", "helpful", "harmful", "seen"])

    return tags.groupBy("family", "rule").applyInPandasWithState(update, "family string, rule string, helpful long, harmful long, seen long", RULE_STATE, "update", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, time: str, size: str, slide: str | None, late: str, by: list[Column], aggregates: list[Column]) -> DataFrame:
    """Tumbling or sliding windows over event time; rows later than `late` are dropped, windows close behind the watermark."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(*aggregates)


def sessions(events: DataFrame, time: str, gap: str, late: str, by: list[Column], aggregates: list[Column]) -> DataFrame:
    """Sessions that a gap of silence ends."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggregates)


def window_by_window(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]):
    """Test-then-train: each micro-batch is one window, given to `step` with its number; it restarts after the last one done."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], times: tuple[str, str], within: str, late: str, how: str = "inner") -> DataFrame:
    """Left rows with the right rows of equal keys that follow within an interval, both sides streams.

    Each side has a watermark, so rows that can't be met any longer leave the
    state; rows later than `late` are dropped and counted by the query. An inner
    join meets by stretches of time as well, so that a row is held against the
    rows of its key nearby and not against all that the state has of a hot key:
    each row is there twice, once for its own stretch and once for the next.
    """
    a, b = left.withWatermark(times[0], late), right.withWatermark(times[1], late)
    meet = F.expr(f"b.{times[1]} >= a.{times[0]} and b.{times[1]} <= a.{times[0]} + interval {within}")
    if how == "inner":
        # Twice the interval, as one of days or months is longer at some times than at others.
        stretch = lambda time: F.floor(F.unix_micros(time) / F.expr(f"2 * unix_micros(timestamp_micros(0) + interval {within})")).cast("long")
        twice = lambda df, time, ahead: df.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_stretch", stretch(F.col(time)) + F.col("_turn") * ahead)
        a, b, keys = twice(a, times[0], 1), twice(b, times[1], 0), [*keys, "_turn", "_stretch"]
    for k in keys:
        meet = meet & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = a.alias("a").join(b.alias("b"), meet, how)
    return joined.drop("_turn", "_stretch") if how == "inner" else joined


def dropped_rows(query, times: int = 1) -> int:
    """How many rows came too late in the batches that a query remembers, each of which it counts so many times (an inner interval_join twice)."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"]) // times


class BatchSink:
    """Output of a stream's batches that a replayed batch doesn't write twice.

    A batch's rows go to a folder named by its number, and a row with the
    number to the manifest once they are there. A batch that the manifest has
    is left alone; one that broke off before is written over. Readers see the
    batches of the manifest only.
    """

    def __init__(self, path: str):
        self.rows, self.manifest = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/manifest"

    def _has(self, spark: SparkSession, number: int) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.manifest}/batch={number}/_SUCCESS")
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if self._has(spark, number):
            return
        batch.write.mode("overwrite").parquet(f"{self.rows}/batch={number}")
        written = spark.read.schema(batch.schema).parquet(f"{self.rows}/batch={number}").agg(F.count(F.lit(1)).alias("n"))
        written.write.mode("overwrite").parquet(f"{self.manifest}/batch={number}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of all batches that were written whole, with their number, `batch`."""
        whole = spark.read.parquet(self.manifest).select("batch")
        return spark.read.parquet(self.rows).join(whole, "batch", "left_semi")
