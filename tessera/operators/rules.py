"""Rule playbooks: parsing, scoring, selection, safety, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = r"^\[([^\]]+)\]\s*helpful=(\d+)\s*harmful=(\d+)\s*::\s*(.*)$"


def parse(lines: DataFrame, document: str, position: str, line: str) -> DataFrame:
    """(document, position, section, id, helpful, harmful, content) of the rule lines under their headings."""
    text = F.trim(F.col(line))
    heading = F.when(text.startswith("## "), F.trim(F.regexp_replace(text, r"^##\s+", "")))
    here = Window.partitionBy(document).orderBy(position)
    marked = lines.withColumn("section", F.last(heading, ignorenulls=True).over(here)).where(text.rlike(LINE))
    group = lambda i: F.regexp_extract(text, LINE, i)
    return marked.select(document, position, "section", group(1).alias("id"), group(2).cast("int").alias("helpful"), group(3).cast("int").alias("harmful"), group(4).alias("content"))


def render_line(id_: Column, helpful: Column, harmful: Column, content: Column) -> Column:
    return F.format_string("[%s] helpful=%d harmful=%d :: %s", id_, helpful, harmful, content)


def tokens(text: Column) -> Column:
    """Distinct lower-case words, and their parts of two letters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_:]+"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(words, lambda w: F.split(w, r"[_:]+"))), lambda p: F.length(p) >= 2)
    return F.array_distinct(F.concat(words, parts))


def top_k(scored: DataFrame, item: str, score: str, position: str, k: int) -> DataFrame:
    """The k best rules of each item with a score above 0; equal scores in order of position."""
    order = Window.partitionBy(item).orderBy(F.desc(score), position)
    return scored.where(F.col(score) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stats(rules: DataFrame) -> DataFrame:
    """By section: counts, and three disjoint classes of rules."""
    good, bad = F.col("helpful") > F.col("harmful"), F.col("harmful") > F.col("helpful")
    return rules.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.sum("helpful").alias("helpful"), F.sum("harmful").alias("harmful"), F.count_if(good).alias("n_good"), F.count_if(bad).alias("n_bad"), F.count_if(~good & ~bad).alias("n_even"))


def apply_tags(rules: DataFrame, tags: DataFrame) -> DataFrame:
    """Add one to helpful or harmful by each rule's last tag. tags: id, tag, pos."""
    last = tags.groupBy("id").agg(F.max_by("tag", "pos").alias("tag"))
    joined = rules.join(last, "id", "left")
    more = lambda tag: F.when(F.col("tag") == tag, 1).otherwise(0)
    return joined.withColumn("helpful", F.col("helpful") + more("helpful")).withColumn("harmful", F.col("harmful") + more("harmful")).drop("tag")


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, in order; null if none does."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(checks):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return reason


def renumber(rules: DataFrame, section: str, position: str) -> DataFrame:
    """Fresh ids `{initials}-{nnnnn}` in order within each section."""
    initials = F.array_join(F.transform(F.split(F.lower(F.col(section)), r"[^a-z0-9]+"), lambda w: F.substring(w, 1, 1)), "")
    n = F.row_number().over(Window.partitionBy(section).orderBy(position))
    return rules.withColumn("id", F.concat(initials, F.lit("-"), F.lpad(n.cast("string"), 5, "0")))
