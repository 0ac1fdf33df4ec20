"""Readers and writers of datasets, results, memories, playbooks and query text."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import lists

S, A = T.StringType(), T.ArrayType(T.StringType())
ENTRY = T.StructType(
    [T.StructField(n, S) for n in ("id", "source_dataset", "source_id", "family", "split", "language", "question")]
    + [T.StructField("paraphrased_questions", A), T.StructField("gold_sparql", S), T.StructField("canonical_sparql", S)]
    + [T.StructField("query_type", S), T.StructField("special_types", A), T.StructField("answer_type", S), T.StructField("query_shape", S)]
    + [T.StructField("number_of_patterns", T.LongType()), T.StructField("query_components", A)]
    + [T.StructField(n, S) for n in ("complexity_level", "ambiguity_risk", "lexical_gap_risk", "hallucination_risk", "human_or_generated", "review_status", "gold_status", "notes")]
)
MEMORY = T.StructType([T.StructField(n, S) for n in ("family", "kind", "canonical_uri", "label", "placeholder")] + [T.StructField("aliases", A), T.StructField("placeholder_aliases", A), T.StructField("notes", S)])
TERM = T.StructType([T.StructField(n, S) for n in ("type", "value", "datatype", "lang")])
RESULT = T.StructType([T.StructField("boolean", T.BooleanType()), T.StructField("results", T.StructType([T.StructField("bindings", T.ArrayType(T.MapType(S, TERM)))]))])
#: Names under which a wrapped file keeps its rows, the first one that is there counts.
WRAPPERS = ("entries", "items", "data", "results", "examples", "raw_results")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session without that setting gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return f"{named.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """A table written to a folder of its own below spark.checkpoint.dir and read again, which cuts the lineage."""
    path = f"{scratch(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_wrapped(df: DataFrame, path: str, wrapper: str | None = "entries") -> None:
    """One JSON file with all rows as a list, or in an object that wraps it; for datasets of a size that one file has."""
    rows = F.collect_list(F.struct(*df.columns))
    df.agg(F.to_json(rows if wrapper is None else F.struct(rows.alias(wrapper))).alias("value")).coalesce(1).write.text(path)


def read_wrapped(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """Rows of JSON files that are a list, or an object that wraps one; unknown fields go.

    Each row has the file it came from and its place there (`file`, `pos`).
    """
    lists = T.ArrayType(schema)
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    wrapped = F.from_json("value", T.StructType([T.StructField(w, lists) for w in wrappers]))
    rows = F.when(F.col("value").startswith("["), F.from_json("value", lists)).otherwise(F.coalesce(*[wrapped[w] for w in wrappers]))
    return text.select("file", F.posexplode(rows).alias("pos", "row")).select("row.*", "file", "pos")


def read_long_lists(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """What read_wrapped reads, each file by as many tasks as it has ranges; for lists that one task can't hold."""
    return lists.parsed(lists.list_elements(spark, paths, wrappers, lambda df: written(df, "lists")), schema)


def read_entries(spark: SparkSession, paths: str | Sequence[str], filters: dict[str, str] | None = None) -> DataFrame:
    """Dataset entries; filters are equalities on trimmed text."""
    df = read_wrapped(spark, paths, ENTRY)
    for name, value in (filters or {}).items():
        df = df.where(F.trim(F.col(name).cast("string")) == value)
    return df


def read_memory(spark: SparkSession, folder: str) -> DataFrame:
    """All `*_memory.json` files of a folder; rows without a key field are dropped."""
    rows = read_wrapped(spark, f"{folder.rstrip('/')}/*_memory.json", MEMORY)
    return rows.dropna(subset=["family", "kind", "canonical_uri", "placeholder"])


def read_results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Answer files in the SPARQL results format: one row per file."""
    text = spark.read.text(paths, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", RESULT).alias("r")).select("file", F.col("r.boolean").alias("boolean"), F.col("r.results.bindings").alias("bindings"))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, pos, line) of text files, in order within each; a file is one task's row, as playbooks are small."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def read_texts(spark: SparkSession, folder: str, suffixes: Sequence[str] = ("json", "jsonl", "md", "txt", "ttl", "sparql")) -> DataFrame:
    """(file, text) of all files below a folder with one of the suffixes."""
    ends = F.lower(F.regexp_extract(F.col("file"), r"\.([^./]+)$", 1))
    text = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).where(ends.isin(*suffixes))


def read_schema(spark: SparkSession, path: str) -> dict:
    """A JSON schema: required fields, and the allowed values of enum and array-of-enum fields."""
    spec = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    fields = spec.get("properties", {})
    return {
        "fields": list(fields),
        "required": list(spec.get("required", [])),
        "enums": {k: v["enum"] for k, v in fields.items() if "enum" in v},
        "array_enums": {k: v["items"]["enum"] for k, v in fields.items() if "enum" in v.get("items", {})},
    }


def bindings_to_cells(results: DataFrame, key: str) -> DataFrame:
    """(key, row, variable, type, value, datatype, lang) of answers."""
    rows = results.select(key, F.posexplode("bindings").alias("row", "binding"))
    return rows.select(key, "row", F.explode("binding").alias("variable", "term")).select(key, "row", "variable", "term.*")


def write_once(df: DataFrame, path: str, overwrite: bool = False, by: Sequence[str] = ()) -> None:
    """Parquet; an error if the path is there, unless it may be overwritten."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_document(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON file, for summaries: a few rows by construction."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def concat_renumbered(frames: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """The rows of all frames, `id` numbered anew in order: counted per range, so no task sees all rows."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn("_source", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    parts = out.repartitionByRange("_source", *order).sortWithinPartitions("_source", *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("_start", F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_start", F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_source", *order))
    return parts.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + within).drop("_part", "_start", "_source")
