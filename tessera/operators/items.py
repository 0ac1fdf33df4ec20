"""Result items as JSON texts: what their fields hold, by which names they may go, and which items are of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.nested import nested_fields
from tessera.functions.prompts import cut

# Where each getter looks, in order, and what it gives where all are empty.
GETTERS = {
    "family": ((("family",), ("entry_metadata", "family"), ("metadata", "family")), "unknown_family"),
    "prompt_mode": ((("prompt_mode",), ("entry_metadata", "prompt_mode")), "unknown_prompt_mode"),
    "prediction_format": ((("prediction_format",),), "unknown_format"),
    "primary_error": ((("main_issue",), ("validation", "primary_error_category"), ("diagnostic_hint",)), "unknown_issue"),
}
GOLD = ("gold_pgmr_sparql", "gold_target_query", "gold_query", "gold_sparql")
# Texts that stand for a truth value.
TRUE, FALSE = ("true", "1", "yes", "ok", "success"), ("false", "0", "no", "error", "failed")


def _name(path: Sequence[str]) -> str:
    return "/".join(path)


def read_items(text: Column, metrics: Sequence[str] = ()) -> Column:
    """A struct of every field that the functions below look at, read in one pass over the JSON text."""
    paths = [p for found, _ in GETTERS.values() for p in found] + [(g,) for g in GOLD] + [("validation",), ("metrics",)]
    for m in metrics:
        paths += [(m,), ("validation", m), ("validation", m, "value"), ("validation", m, "f1"), ("metrics", m), ("metrics", m, "value")]
    return nested_fields(text, {_name(p): p for p in dict.fromkeys(paths)})


def field(item: Column, *path: str) -> Column:
    return item.getField(_name(path))


def filled(f: Column) -> Column:
    """Whether a field holds anything: no null, no empty text or container, no zero, not false."""
    kind, text = f["kind"], f["text"]
    empty = F.when(kind == "string", text == "").when(kind == "number", text.try_cast("double") == 0).when(kind == "boolean", text == "false").when(kind == "null", True).otherwise(F.regexp_replace(text, r"\s", "").isin("[]", "{}"))
    return kind.isNotNull() & ~empty


def getter(item: Column, name: str) -> Column:
    """The first of a getter's fields that holds anything, or its default."""
    paths, default = GETTERS[name]
    return F.coalesce(*[F.when(filled(field(item, *p)), field(item, *p)["text"]) for p in paths], F.lit(default))


def gold_target(item: Column, most: int = 4000) -> Column:
    """(query, source): the gold query in the space of the prediction, cut; in placeholder space an identifier query stands in where there is no other."""
    first = lambda *names: F.coalesce(*[F.when(filled(field(item, n)), field(item, n)["text"]) for n in names], F.lit(""))
    placed = F.regexp_replace(F.lower(F.trim(getter(item, "prediction_format"))), r"[\s-]+", "_") == "pgmr_lite"
    source = F.when(placed & filled(field(item, "gold_pgmr_sparql")), "gold_pgmr_sparql").when(placed, "gold_pgmr_sparql_or_fallback").otherwise("gold_query")
    query = F.when(placed, first("gold_pgmr_sparql", "gold_target_query", "gold_query")).otherwise(first("gold_query", "gold_sparql", "gold_target_query"))
    return F.struct(cut(query, most).alias("query"), source.alias("source"))


def present(f: Column) -> Column:
    """A field that is there and not null."""
    return F.when(f["kind"] != "null", f)


def metric_value(item: Column, metric: str) -> Column:
    """A metric of `validation`, else of `metrics`, else of the item itself: where the name is there, null or not, that counts; records give their value."""
    out = present(field(item, metric))
    for held in ("metrics", "validation"):
        own = field(item, held, metric)
        there = (field(item, held)["kind"] == "object") & own["kind"].isNotNull()
        out = F.when(there, F.when(own["kind"] == "object", present(field(item, held, metric, "value"))).otherwise(present(own))).otherwise(out)
    return out


def validation_metric(item: Column, metric: str) -> Column:
    """A metric of `validation`, of the item where it is missing or null."""
    return F.coalesce(present(field(item, "validation", metric)), present(field(item, metric)))


def f1(item: Column, metric: str) -> Column:
    own = field(item, "validation", metric)
    return F.when(own["kind"] == "object", present(field(item, "validation", metric, "f1"))).otherwise(present(own))


def as_bool(f: Column) -> Column:
    """True, false, or null where a field says neither."""
    word = F.lower(F.trim(f["text"]))
    said = F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)
    return F.when(f["kind"] == "boolean", f["text"] == "true").when(f["kind"] == "number", f["text"].try_cast("double") != 0).when(f["kind"] == "string", said)


def as_float(f: Column) -> Column:
    return F.when(f["kind"] == "boolean", (f["text"] == "true").cast("int").cast("double")).when(f["kind"].isin("number", "string"), F.trim(f["text"]).try_cast("double"))


def of_interest(item: Column, only_failures: bool, only_executable: bool) -> Column:
    """Whether a judge reads an item: not if it is known not to run; of failures, not if it is known to be right. What isn't known is read."""
    keep = F.lit(True)
    if only_failures:
        exact, score = as_bool(metric_value(item, "answer_exact_match")), as_float(metric_value(item, "answer_f1"))
        keep = F.when(~exact | (score < 1.0), True).when(exact | score.isNotNull(), False).otherwise(True)
    if only_executable:
        keep = keep & F.coalesce(as_bool(metric_value(item, "prediction_execution_success")), F.lit(True))
    return keep


def query_status(query: Column) -> Column:
    """What a restored query looks like: its form, its block, its braces, and the tokens that are left in it."""
    count = lambda c: F.length(query) - F.length(F.replace(query, F.lit(c), F.lit("")))
    tokens = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(p), F.lit(0))))
    return F.struct(
        query.rlike(r"(?i)^\s*(SELECT|ASK|CONSTRUCT|DESCRIBE)\b").alias("starts_with_query_type"),
        query.rlike(r"(?i)\bWHERE\s*\{").alias("has_where_block"),
        (count("{") == count("}")).alias("balanced_braces"),
        tokens(r"\bpgmrc?:[A-Za-z_][A-Za-z0-9_]*").alias("remaining_pgmr_tokens"),
        tokens(r"\borkg[a-z]*:[A-Za-z0-9_]+").alias("orkg_tokens"),
    )
