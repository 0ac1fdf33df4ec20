"""As-of joins against a plain search, and a sink whose batches come again."""

import random

from pyspark.sql import functions as F

from tessera.operators import asof
from tessera.plans import streams
from tessera.streaming.replay import BatchSink, interval_join


def test_asof_equals_a_plain_search(spark):
    r = random.Random(6)
    left = [(r.choice([None, 1, 1, 1, 2, 3]), r.choice([None, *range(40)]), i) for i in range(400)]
    right = [(r.choice([None, 1, 1, 2, 9]), r.choice([None, *range(40)]), i) for i in range(120)]
    a = spark.createDataFrame(left, "k int, t int, i int").repartition(5)
    b = spark.createDataFrame(right, "k int, t int, v int").repartition(3)
    for by in ([], ["k"]):
        found = {(x["i"], x["k"], x["t"]): x["last"] and x["last"]["v"] for x in asof.asof_last(a, b, "t", lambda df: df.checkpoint(), by).collect()}
        assert len(found) == 400
        for (i, k, t), v in found.items():
            own = [(x[1], x[0] is not None, x[0] or 0, x[2]) if not by else (x[1], x[2]) for x in right if x[1] is not None and t is not None and x[1] <= t and (not by or x[0] == k)]
            assert v == (max(own)[-1] if own and max(own)[0] is not None else None), (by, i, k, t)


def test_a_batch_that_broke_off_is_written_over_and_a_whole_one_left_alone(spark, tmp_path):
    sink = BatchSink(str(tmp_path / "out"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    sink(rows(1, 2), 0)
    rows(7, 8).write.parquet(f"{sink.rows}/batch=1")  # rows without a manifest: the driver was lost in between
    assert sorted(map(tuple, sink.read(spark).select("batch", "i").collect())) == [(0, 1), (0, 2)]
    sink(rows(3), 1)
    sink(rows(9, 9), 0)
    sink(rows(), 2)
    assert sorted(map(tuple, sink.read(spark).select("batch", "i").collect())) == [(0, 1), (0, 2), (1, 3)]
    assert spark.read.parquet(sink.manifest).where(F.col("n") == 0).count() == 1


def test_a_batch_is_several_files_and_each_trigger_takes_one_batch(spark, tmp_path):
    rows = [(i, f"2024-{m:02d}-{d:02d} 10:00:00", f"2024-{m:02d}-{d:02d} 10:30:00") for i, (m, d) in enumerate([(1, 2), (1, 3), (2, 15), (4, 30), *[(1, 5)] * 40])]
    df = spark.createDataFrame(rows, "i int, ts string, arrived_at string").select("i", F.col("ts").cast("timestamp").alias("ts"), F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    tables = lambda name: df
    tables.spark = spark
    source, sizes = streams.in_batches(tables, "clicks", ["i"]), []
    seen = lambda batch, number: sizes.append((batch.count(), batch.select("f").distinct().count()))
    source().withColumn("f", F.input_file_name()).writeStream.foreachBatch(seen).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [(42, streams.FILES), (1, 1), (1, 1)]


def test_an_interval_join_meets_each_pair_once_and_by_stretches_of_time(spark, tmp_path):
    r = random.Random(4)
    sides = [[(i, 1, 3600 * 5 * 10**6 + r.randrange(0, 3 * 3600, 300)) for i in range(60)] for _ in range(2)]
    streams_ = []
    for n, side in enumerate(sides):
        spark.createDataFrame(side, "i int, k int, s long").select(F.col("i").alias(f"i{n}"), "k", F.timestamp_seconds("s").alias(f"t{n}")).write.parquet(f"{tmp_path}/{n}")
        streams_.append(spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}"))
    joined = interval_join(*streams_, ["k"], ("t0", "t1"), "1 hour", "6 hours").select("i0", "i1")
    sink = BatchSink(f"{tmp_path}/out")
    run = joined.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, sink.read(spark).select("i0", "i1").collect())) == sorted((i, j) for i, _, s in sides[0] for j, _, t in sides[1] if s <= t <= s + 3600)
    assert "_stretch" in joined._jdf.queryExecution().analyzed().toString()
