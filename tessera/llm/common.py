"""What the operators of this subpackage share: tables, folds, the shared folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. Whole texts cross in these batches, so they stay small; the same for all operators.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any store that Spark can read."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers. Every operator sets the same bounds, so it doesn't matter which was built last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    spark.checkpoint.dir names it. Where that is unset a local session gets a
    folder of its own; on a cluster there is no safe default, so it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = getattr(context, "_tessera_shared", None)
    if made is None:
        made = context._tessera_shared = tempfile.mkdtemp(prefix="tessera-")
    return f"file://{made}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage; a lost executor costs a read, not a new run.
    """
    return at_path(df, f"{shared_dir(df.sparkSession)}/tessera/{label}-{uuid.uuid4().hex}")


def at_path(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any longer."""
    path = getattr(df, "_tessera_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def discard_shared(spark: SparkSession) -> None:
    """Remove the folder that shared_dir() made for a local session."""
    made = getattr(spark.sparkContext, "_tessera_shared", None)
    if made:
        shutil.rmtree(made, ignore_errors=True)
        spark.sparkContext._tessera_shared = None


def sampled(df: DataFrame, key: str, group: Column, size: int, seed: int) -> DataFrame:
    """Rows of about `size` distinct keys of each group, one row a key, the same ones each time.

    Distinct keys of a group are estimated first (a partial aggregate), then a
    hash of the key is held against each group's share. So copies count once: a
    group made of one key alone is drawn, and a hot key is no more than a row.
    No group is gathered in one task. Groups must be few, such as classes or
    languages; rows of a null group or a null key go.
    """
    rows = df.withColumn("_group", group).where(F.col("_group").isNotNull() & F.col(key).isNotNull()).withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    counts = {r["_group"]: max(1, r["n"]) for r in rows.groupBy("_group").agg(F.approx_count_distinct("_hash", 0.02).alias("n")).collect()}
    if not counts:
        return rows.where(F.lit(False))
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(scale, -(-scale * size // n)))])
    return rows.where(F.pmod("_hash", F.lit(scale)) < F.element_at(share, F.col("_group"))).dropDuplicates(["_group", "_hash"])


def row_name(df: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """A name for rows whose keys may be null or repeat: the key (nulls last) and a hash of the text, never null."""
    some = F.lit("0").cast(df.schema[key].dataType)
    return F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key), some).alias("id"), F.xxhash64(text).alias("hash"))


def covers(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts of spans in order, and the farthest end of all up to each; for looking up what lies in or over a span."""
    starts, ends, far = [], [], -1
    for low, high in sorted(spans):
        far = max(far, high)
        starts.append(low)
        ends.append(far)
    return starts, ends
