"""Profiles and validation of dataset entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(column: Column, kind: T.DataType) -> Column:
    """Null, a blank text, or an empty array; never 0 or false."""
    if isinstance(kind, T.StringType):
        return column.isNull() | (F.trim(column) == "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return column.isNull() | (F.size(column) == 0)
    return column.isNull()


def long_form(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value as text, missing) of each field of each row."""
    kinds = {f: df.schema[f].dataType for f in fields}
    text = lambda f: F.to_json(f) if isinstance(kinds[f], (T.ArrayType, T.MapType, T.StructType)) else F.col(f).cast("string")
    each = [F.struct(F.lit(f).alias("field"), text(f).alias("value"), is_missing(F.col(f), kinds[f]).alias("missing")) for f in fields]
    return df.select(F.explode(F.array(*each)).alias("_f")).select("_f.*")


def coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    long = long_form(df, fields).groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("missing")).alias("filled"))
    return long.select("field", "total", "filled", F.bround(F.try_divide(F.col("filled") * 100.0, F.col("total")), 4).alias("percent"))


def presence(rows: DataFrame, keys: Column) -> DataFrame:
    """How many rows have each key; `keys` is an array column. The total is joined as one row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    found = rows.select(F.explode(F.array_distinct(keys)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("present"))
    return found.join(F.broadcast(total)).select("field", "present", F.bround(F.col("present") / F.col("total"), 4).alias("ratio"))


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return long_form(df, fields).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def enum_distribution(df: DataFrame, values: Column, allowed: Sequence[str], base: str = "rows") -> DataFrame:
    """Counts of allowed values, zero ones too, and of unexpected ones; percent of `base`.

    `values` is a text or, with base `items`, an array whose distinct elements
    count once for each row.
    """
    rows = df.select(F.explode(F.array_distinct(values)).alias("value")) if base == "items" else df.select(values.alias("value"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counts = rows.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    known = df.sparkSession.createDataFrame([(v,) for v in allowed], "value string").withColumn("allowed", F.lit(True))
    joined = counts.join(F.broadcast(known), "value", "full")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return joined.join(F.broadcast(total)).select("value", F.coalesce("allowed", F.lit(False)).alias("allowed"), n.alias("n"), F.bround(F.try_divide(n * 100.0, F.col("total")), 4).alias("percent"))


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule is a column that is true where it is broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))
