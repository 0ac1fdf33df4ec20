"""Queries over logs that arrive in batches, and over the steps of a replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import asof
from tessera.plans.registry import query
from tessera.sources import io
from tessera.streaming.replay import BatchSink, dropped_rows, interval_join


def keep(df):
    return io.written(df, "asof")


@query("snapshot_of_step", "with s as (select event_id, user_id from events where event_type = 'signup') select e.event_id, s.event_id as snapshot, s.user_id as by_user from events e asof left join s on e.event_id >= s.event_id")
def snapshot_of_step(tables):
    """Every step with the last snapshot at or before it."""
    e = tables("events")
    found = asof.asof_last(e.select("event_id"), e.where("event_type = 'signup'").select("event_id", "user_id"), "event_id", keep)
    return found.select("event_id", F.col("last.event_id").alias("snapshot"), F.col("last.user_id").alias("by_user"))


@query("client_snapshot_of_click", "with s as (select client_id, valid_at as ts, max(change_id) as change_id from client_changes where valid_at is not null group by 1, 2) select c.click_id, s.change_id from clicks c asof left join s on c.client_id = s.client_id and c.ts >= s.ts")
def client_snapshot_of_click(tables):
    """Every click with its client's last change at or before it; a third of all clicks may be one client's."""
    changes = tables("client_changes").where("client_id is not null").select("client_id", F.col("valid_at").alias("ts"), "change_id")
    found = asof.asof_last(tables("clicks").select("client_id", "ts", "click_id"), changes, "ts", keep, ["client_id"])
    return found.select("click_id", F.col("last.change_id").alias("change_id"))


@query(
    "snapshot_scores",
    """with s as (select event_id from events where event_type = 'signup'), v as (select event_id, value from events where event_type = 'view'),
    p as (select s.event_id as snapshot, count(*) as evaluations, round_even(avg(v.value), 6) as mean from v asof join s on v.event_id >= s.event_id group by 1)
    select *, snapshot = (select snapshot from p order by mean desc, snapshot limit 1) as best from p""",
)
def snapshot_scores(tables):
    e = tables("events")
    return asof.snapshot_scores(e.where("event_type = 'view'").select("event_id", "value"), e.where("event_type = 'signup'"), "event_id", "value", keep)


@query(
    "before_and_after",
    """with f as (select user_id, min(event_id) as first from events where event_type = 'signup' group by 1)
    select user_id, round_even(avg((value > 50)::int) filter (where first is null or event_id < first), 6) as pre, round_even(avg((value > 50)::int) filter (where event_id >= first), 6) as post from events left join f using (user_id) group by 1""",
)
def before_and_after(tables):
    e = tables("events")
    return asof.before_and_after(e, e.where("event_type = 'signup'"), "user_id", "event_id", F.col("value") > 50)


# --- batches ----------------------------------------------------------------

#: The third of a month that a row arrived in; what was an hour late or more is held up by three of them.
ARRIVED = "floor((day(arrived_at) - 1) / 11) + 3 * month(arrived_at) + case when ts + interval 1 hour <= arrived_at then 3 else 0 end"


#: Files of a batch, so that as many tasks write and read it.
FILES = 8


def in_batches(tables, table, columns):
    """A table as a stream of a batch for every third of a month that rows come in, in order.

    A batch is FILES files, each with an empty row, so that there are never
    fewer; a trigger takes as many. The table is read once.
    """
    path, spark = io.scratch(tables.spark), tables.spark
    rows = tables(table).select(*columns, F.expr(ARRIVED).cast("int").alias("_batch")).where("_batch is not null")
    dealt = rows.select("*", F.lit(True).alias("_row"), F.pmod(F.monotonically_increasing_id(), F.lit(FILES)).cast("int").alias("_file"))
    staged = f"{io.scratch(spark)}/staged"
    dealt.write.partitionBy("_batch").parquet(staged)
    dealt, empty = spark.read.schema(dealt.schema).parquet(staged), spark.range(FILES).select(F.col("id").cast("int").alias("_file"))
    for number in sorted(r["_batch"] for r in dealt.select("_batch").distinct().collect()):  # some fifteen thirds of months
        batch = dealt.where(F.col("_batch") == number).drop("_batch").unionByName(empty, allowMissingColumns=True)
        batch.repartitionById(FILES, F.col("_file")).drop("_file").write.mode("append").parquet(path)
    kept = dealt.drop("_batch", "_file").schema
    return lambda: spark.readStream.schema(kept).option("maxFilesPerTrigger", FILES).parquet(path).where("_row").drop("_row")


@query(
    "stream_interval_join",
    f"""with c as (select click_id, ts, client_id, kind, {ARRIVED} as b from clicks where arrived_at is not null and ts is not null and client_id is not null and kind in ('view', 'purchase')),
    d as (select distinct {ARRIVED} as b from clicks where arrived_at is not null),
    w as (select b, least(max(v) over o, max(p) over o) as seen from (select d.b, max(ts) filter (where kind = 'view') as v, max(ts) filter (where kind = 'purchase') as p from d left join c using (b) group by 1) window o as (order by b rows between unbounded preceding and 2 preceding)),
    k as (select c.*, seen is not null and ts <= date_trunc('millisecond', seen) - interval 6 hour as late from c join w using (b)),
    n as (select * from k where not late)
    select v.click_id as view_id, p.click_id as purchase_id, (select count(*) from k where late) as dropped from n v join n p on v.client_id = p.client_id and p.ts >= v.ts and p.ts <= v.ts + interval 1 hour where v.kind = 'view' and p.kind = 'purchase'""",
)
def stream_interval_join(tables):
    """Purchases within an hour of a view by the same client, from clicks in the order of arrival; rows over six hours late are dropped and counted. A batch's rows are held against what was seen up to the last but one."""
    source = in_batches(tables, "clicks", ["click_id", F.col("ts").cast("timestamp").alias("ts"), "client_id", "kind"])
    of = lambda kind, name: source().where(f"kind = '{kind}' and ts is not null and client_id is not null").select("client_id", F.col("click_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_at"))
    joined = interval_join(of("view", "view"), of("purchase", "purchase"), ["client_id"], ("view_at", "purchase_at"), "1 hour", "6 hours").select("view_id", "purchase_id")
    sink = BatchSink(io.scratch(tables.spark))
    run = joined.writeStream.foreachBatch(sink).option("checkpointLocation", io.scratch(tables.spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return sink.read(tables.spark).select("view_id", "purchase_id").withColumn("dropped", F.lit(dropped_rows(run, 2)).cast("long"))


@query("stream_sink_once", f"select click_id, dense_rank() over (order by {ARRIVED}) - 1 as batch from clicks where arrived_at is not null")
def stream_sink_once(tables):
    """Clicks by the batch that they arrived in; every batch comes twice, as after a lost checkpoint, and is written once."""
    source = in_batches(tables, "clicks", ["click_id"])
    sink = BatchSink(io.scratch(tables.spark))
    for _ in range(2):
        source().writeStream.foreachBatch(sink).option("checkpointLocation", io.scratch(tables.spark)).trigger(availableNow=True).start().awaitTermination()
    return sink.read(tables.spark).select("click_id", F.col("batch").cast("long").alias("batch"))
