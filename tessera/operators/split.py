"""Eligibility, quota samples, splits and paraphrase expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single_quota(df: DataFrame, group: str, quotas: Mapping[str, int], order: Sequence[Column]) -> DataFrame:
    """The first rows of each group in order, as many as its quota; other groups give none."""
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(group)), F.lit(0))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    # The literal bound lets the planner keep no more than that of a group before it sorts.
    return ranked.where((F.col("_rank") <= max(quotas.values(), default=0)) & (F.col("_rank") <= quota)).drop("_rank")


def greedy_picks(df: DataFrame, key: str, order: Sequence[str], family: str, family_quota: Mapping[str, int], passes: Sequence[tuple[str, Mapping[str, int]] | None]) -> DataFrame:
    """(key, pass): greedy passes in order, each taking rows while their family's quota lasts and their second value's too.

    A pass names the second column and its quotas; None asks for the family
    alone. Counts go on from pass to pass, of all columns. What a row gives
    depends on all rows before it, so the passes run over the rows that can
    matter: the first of each combination of family and second columns, as many
    as its family may have. Their number is bounded by the quotas and the
    families in them.
    """
    seconds = list(dict.fromkeys(p[0] for p in passes if p is not None))
    bound = max(family_quota.values(), default=0)
    rows = df.where(F.col(family).isin(*family_quota)).select(key, *dict.fromkeys([*order, family, *seconds]))
    for second, quota in (p for p in passes if p is not None):  # values without a quota are alike to every pass
        rows = rows.withColumn(second, F.when(F.col(second).isin(*quota), F.col(second)))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(family, *seconds).orderBy(*order, key))).where(F.col("_r") <= bound).drop("_r")

    def take(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*order, key])
        used: dict[tuple[str, object], int] = {}
        taken: dict = {}
        for number, wanted in enumerate(passes, 1):
            for row in part.to_dict("records"):
                if row[key] in taken or used.get((family, row[family]), 0) >= family_quota[row[family]]:
                    continue
                if wanted is not None and used.get((wanted[0], row[wanted[0]]), 0) >= wanted[1].get(row[wanted[0]], 0):
                    continue
                taken[row[key]] = number
                for column in (family, *seconds):
                    used[column, row[column]] = used.get((column, row[column]), 0) + 1
        return pd.DataFrame({key: list(taken), "pass": list(taken.values())}, columns=[key, "pass"])

    return rows.groupBy().applyInPandas(take, f"`{key}` {df.schema[key].dataType.simpleString()}, pass int")


def seeded_sample(df: DataFrame, key: str, size: int, seed: int, keep: Column | None = None) -> DataFrame:
    """`size` rows of those that `keep` holds for, drawn by a hash of key and seed, in the order of the key again. Filter, draw, then limit."""
    rows = df if keep is None else df.where(keep)
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(size).orderBy(key)


def first_rows(df: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows in order; asking for none is an error."""
    if most <= 0:
        raise ValueError("the limit must be positive")
    return df.orderBy(order).limit(most)


def double_quota(df: DataFrame, key: str, rank: str, first: str, second: str, first_quota: Mapping[str, int], second_quota: Mapping[str, int], size: int) -> DataFrame:
    """(key): a greedy pass in rank order that takes a row while both its quotas last.

    What one row takes depends on all rows before it, so it runs over the few
    rows that can matter at all: of each pair of values the first `size`.
    """
    short = df.withColumn("_r", F.row_number().over(Window.partitionBy(first, second).orderBy(rank, key))).where(F.col("_r") <= size)

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, taken = dict(first_quota), dict(second_quota), []
        for _, row in rows.sort_values([rank, key]).iterrows():
            if len(taken) < size and left.get(row[first], 0) > 0 and right.get(row[second], 0) > 0:
                left[row[first]] -= 1
                right[row[second]] -= 1
                taken.append(row[key])
        return pd.DataFrame({key: taken}, columns=[key])

    return short.select(key, rank, first, second).groupBy().applyInPandas(take, f"`{key}` {df.schema[key].dataType.simpleString()}")


def seeded_order(key: str, seed: int) -> Column:
    """A shuffle that the seed fixes."""
    return F.xxhash64(F.col(key), F.lit(seed))


def assign_split(df: DataFrame, key: str, test: DataFrame, validation: DataFrame) -> DataFrame:
    """Add `split`: test, else validation, else train; each row one."""
    marked = df.join(test.select(key).distinct().withColumn("_t", F.lit(1)), key, "left").join(validation.select(key).distinct().withColumn("_v", F.lit(1)), key, "left")
    return marked.withColumn("split", F.when(F.col("_t") == 1, "test").when(F.col("_v") == 1, "validation").otherwise("train")).drop("_t", "_v")


def expand_paraphrases(df: DataFrame, key: str, question: str, paraphrases: str, most: int | None = None) -> DataFrame:
    """Originals, and a row for each paraphrase that is new: other than the question and those before it, in lower case.

    Ids are `{key}__para_{nn}`, numbered in order.
    """
    low = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    rows = df.select("*", F.posexplode(paraphrases).alias("_at", "_text"))
    rows = rows.withColumn("_low", low(F.col("_text"))).where((F.col("_low") != "") & (F.col("_low") != low(F.col(question))))
    first = Window.partitionBy(key, "_low").orderBy("_at")
    rows = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at")))
    if most is not None:
        rows = rows.where(F.col("_n") <= most)
    new = rows.withColumn(question, F.trim("_text")).withColumn("entry_id", F.concat(F.col(key).cast("string"), F.lit("__para_"), F.lpad(F.col("_n").cast("string"), 2, "0")))
    columns = [c for c in df.columns if c != paraphrases]
    return df.withColumn("entry_id", F.col(key).cast("string")).select("entry_id", *columns).unionByName(new.select("entry_id", *columns))


def sequential_ids(df: DataFrame, prefix: str, order: Sequence[Column], group: Sequence[str]) -> DataFrame:
    """`{prefix}_{nnn}` in order within each group."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("entry_id", F.concat(F.lit(f"{prefix}_"), F.lpad(n.cast("string"), 3, "0")))
