"""Prompts and training examples as columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKED = -100


def said(value: Column, listed: bool = False) -> Column:
    """A field as a prompt has it: trimmed, lists joined by commas, `none` for what is missing or blank."""
    if listed:
        value = F.array_join(F.filter(F.transform(value, lambda x: F.trim(x)), lambda v: v != ""), ", ")
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("none"))


def field_prompt(task: str, fields: Sequence[tuple[str, Column]], end: str) -> Column:
    """One line for the task, one for each field, and the line that is to be answered."""
    return F.concat_ws("\n", F.lit(f"task: {task}"), *[F.concat(F.lit(f"{name}: "), value) for name, value in fields], F.lit(end))


def filled(template: str, fields: dict[str, Column]) -> Column:
    """A template with its `{name}`s replaced; null fields are blank, names that aren't known an error."""
    parts = re.split(r"\{(\w+)\}", template)
    unknown = set(parts[1::2]) - set(fields)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return F.concat(*[F.coalesce(fields[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def first_filled(candidates: Sequence[tuple[str, Column]]) -> Column:
    """A struct of the first value that isn't blank, and its name."""
    value, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, column in reversed(candidates):
        own = F.nullif(F.trim(column), F.lit(""))
        value, source = F.when(own.isNotNull(), own).otherwise(value), F.when(own.isNotNull(), F.lit(name)).otherwise(source)
    return F.struct(value.alias("value"), source.alias("source"))


def cut(text: Column, most: int = 2500, note: str = "\n...[truncated for ACE]...") -> Column:
    """A text of at most `most` characters: of longer ones the beginning, and a note."""
    own = F.trim(text)
    return F.when(F.length(own) <= most, own).otherwise(F.concat(F.rtrim(F.substring(own, 1, most - 32)), F.lit(note)))


def without_blanks(fields: Column) -> Column:
    """A map without its null and empty values."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))


def run_label(model: Column, prompt: Column, file: Column) -> Column:
    return F.concat_ws(" / ", *[F.nullif(F.trim(c), F.lit("")) for c in (model, prompt, file)])


def word_count(text: Column) -> Column:
    """Words between white space; what a token count falls back to."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def training_rows(items: DataFrame, key: str, prompt: Column, target: Column, keep: Column, most: int | None = None) -> DataFrame:
    """(key, prompt, target) of rows that `keep` holds for and that have both; the first `most` by key."""
    rows = items.where(keep).select(key, prompt.alias("prompt"), target.alias("target")).where((F.trim("prompt") != "") & (F.trim("target") != ""))
    return rows if most is None else rows.orderBy(key).limit(most)


def masked_example(prompt: Column, target: Column, end: Column, prompt_most: int, target_most: int) -> Column:
    """Ids and labels of a training example: the tail of the prompt, which is masked, then the target and its end.

    prompt, target: arrays of ids. The target gives way to the end where both don't fit.
    """
    tail = F.slice(prompt, F.greatest(F.size(prompt) - prompt_most + 1, F.lit(1)), F.lit(prompt_most))
    own = F.concat(F.slice(target, 1, target_most - 1), F.array(end)) if target_most > 1 else F.slice(target, 1, target_most)
    return F.struct(F.concat(tail, own).alias("input_ids"), F.concat(F.transform(tail, lambda _: F.lit(MASKED).cast("long")), own.cast("array<long>")).alias("labels"))


def padded(ids: Column, size: int, value: int) -> Column:
    """Ids filled up to a size."""
    return F.concat(ids, F.array_repeat(F.lit(value).cast("long"), F.greatest(F.lit(size) - F.size(ids), F.lit(0))))
