"""The metric catalogue: each item's records, as one long table.

items: item_id, pred_query, gold_query, pred and gold (struct of status,
result_type, boolean, bindings), evaluated (was there an endpoint), allowed
(array of references, or null), placeholder_mode (boolean), and in that mode
pred_placeholder_query and gold_placeholder_query. Everything that
several metrics need (forms, references, normal texts, answer rows) is a column
of a table that is written and read again, as otherwise each record would bring
its expressions along and the plan grows with their product; so are the overlaps
made from them. What comes from texts alone is made once for every different
set of texts and joined to the items. The records are an array, exploded last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import repair, scores, text
from tessera.operators.placeholders import bounded
from tessera.operators.rules import first_failure

#: Different texts up to which their scores are broadcast, and tasks for each core that score them.
BROADCAST_TEXTS, SPREAD = 20_000, 2

XSD = "http://www.w3.org/2001/XMLSchema#"
# The datatypes whose values are compared as numbers.
NUMERIC = tuple(XSD + n for n in ("byte", "decimal", "double", "float", "int", "integer", "long", "negativeInteger", "nonNegativeInteger", "nonPositiveInteger", "positiveInteger", "short", "unsignedByte", "unsignedInt", "unsignedLong", "unsignedShort"))
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?\s*$"


def strict_term(t: Column) -> list[Column]:
    """Type, value, datatype and language; numeric literals in one spelling, as decimals."""
    kind, value, datatype = (F.coalesce(t[f], F.lit("")) for f in ("type", "value", "datatype"))
    numeric = (kind == "literal") & datatype.isin(*NUMERIC) & value.rlike(NUMBER)
    return [kind, F.when(numeric, scores.let(value, scores.decimal_form)).otherwise(value), F.when(numeric, XSD + "decimal").otherwise(datatype), F.coalesce(t["lang"], F.lit(""))]


def cell_term(t: Column) -> Column:
    """One text for a cell: datatype kept, booleans and numbers spelled alike, case of datatype and language ignored."""
    kind, value, datatype, lang = (F.trim(F.coalesce(t[f], F.lit(""))) for f in ("type", "value", "datatype", "lang"))

    def spelled(c: Column) -> Column:
        truth, number = F.lower(c["value"]), c["name"].isin("integer", "decimal", "double", "float", "int", "long", "short", "byte")
        said = F.when(truth.isin("1", "true"), "true").when(truth.isin("0", "false"), "false").otherwise(truth)
        own = F.when(c["name"] == "boolean", said).when(number, scores.let(c["value"], scores.decimal_form)).otherwise(c["value"])
        quoted = lambda v: F.when(c["type"] == "uri", v).otherwise(F.concat(F.lit('"'), v, F.lit('"'), F.when(c["datatype"] != "", F.concat(F.lit("^^"), c["datatype"])).when(c["lang"] != "", F.concat(F.lit("@"), c["lang"])).otherwise("")))
        return scores.let(own, quoted)

    low = F.lower(datatype)
    return scores.let(F.struct(F.lower(kind).alias("type"), value.alias("value"), low.alias("datatype"), F.lower(lang).alias("lang"), F.regexp_extract(low, r"[#:/]([a-z]+)$", 1).alias("name")), spelled)


def answer_rows(execution: Column, names: bool = True) -> Column:
    """The distinct rows of an answer, each one text, whatever the order of its variables."""
    cell = lambda e: F.concat_ws("\x1f", *([e["key"]] if names else []), *strict_term(e["value"]))
    row = lambda b: F.array_join(F.array_sort(F.transform(F.map_entries(b), cell)), "\x1e")
    return F.array_distinct(F.transform(F.coalesce(execution["bindings"], F.array().cast("array<map<string,struct<type:string,value:string,datatype:string,lang:string>>>")), row))


def answer_cells(execution: Column) -> Column:
    """The distinct cells of an answer; an ASK has one."""
    cells = F.array_distinct(F.flatten(F.transform(F.coalesce(execution["bindings"], F.array().cast("array<map<string,struct<type:string,value:string,datatype:string,lang:string>>>")), lambda b: F.transform(F.map_values(b), cell_term))))
    return F.when(execution["result_type"] == "ask", F.array(execution["boolean"].cast("string"))).otherwise(cells)


def answer_kind(execution: Column) -> Column:
    status = execution["status"]
    return F.when(status.isNull() | (status == "skipped"), "missing").when(status != "ok", "error").when(execution["result_type"].isin("ask", "select"), execution["result_type"]).otherwise("unsupported")


def record(metric: str, family: str, value: Column, reason: Column | None = None, prf: Column | None = None) -> Column:
    """One metric record; a reason makes it non-comparable and empty."""
    why = F.lit(None).cast("string") if reason is None else reason
    number = lambda x: F.when(why.isNull(), scores.r4(x.cast("double")))
    nothing = F.lit(None).cast("double")
    parts = [number(prf[c]).alias(c) if prf is not None else nothing.alias(c) for c in ("precision", "recall", "f1")]
    return F.struct(F.lit(metric).alias("metric"), F.lit(family).alias("type"), (why.isNull() & value.isNotNull()).alias("comparable"), number(value).alias("value"), *parts, why.alias("reason"))


def _scored_texts(texts_of: DataFrame, texts: bool, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the texts of an item give by themselves, once for every different (pq, gq, ppq, gpq), however many items have them."""
    c = F.col
    tasks = SPREAD * texts_of.sparkSession.sparkContext.defaultParallelism
    pairs = texts_of.distinct().repartition(tasks, *texts_of.columns)  # texts are short and dear to score, so their size doesn't tell how many tasks they need
    pairs = pairs.withColumns({"pf": text.query_form(c("pq")), "gf": text.query_form(c("gq")), "pn": text.comparison_form(c("pq")), "gn": text.comparison_form(c("gq")), "pr": text.references(c("pq")), "gr": text.references(c("gq")), "unplaced": F.size(text.placeholders(c("pq")))})
    if texts:
        pairs = pairs.withColumns({"pt": text.tokens(c("pn")), "gt": text.tokens(c("gn")), "pg": text.ngram_tokens(c("pn")), "gg": text.ngram_tokens(c("gn")), "ps": repair.structure(c("pn")), "gs": repair.structure(c("gn"))})
        pairs = pairs.withColumns({f"{s}pg": text.ngram_tokens(text.comparison_form(c(f"{s}pq"))) for s in "pg"})
    pairs = keep(pairs)
    kinds = {"kg": None, "predicate": "p", "class": "c", "resource": "r"}
    ref_sets = {k: (c("pr"), c("gr")) if kind is None else (text.references_of(c("pr"), kind), text.references_of(c("gr"), kind)) for k, kind in kinds.items()}
    made = {f"{k}_refs": scores.set_overlap(p, g) for k, (p, g) in ref_sets.items()}
    made["alike"] = c("pn") == c("gn")
    if texts:
        made |= {"structure": scores.multiset_overlap(c("ps"), c("gs")), "bleu": scores.bleu(c("pt"), c("gt")), "n_tokens": F.size("pt")}
        for name, p, g in (("query", c("pg"), c("gg")), ("pgmr", c("ppg"), c("gpg"))):
            made |= {f"{name}_rouge1": scores.rouge_n(p, g, 1), f"{name}_rouge2": scores.rouge_n(p, g, 2), f"{name}_rougeL": scores.rouge_l(p, g)["f1"]}
    return keep(pairs.withColumns(made).drop("pn", "gn", "gr", "ps", "gs", "pt", "gt", "pg", "gg", "ppg", "gpg"))


def metric_long(items: DataFrame, texts: bool = True, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """(item_id, metric, type, comparable, value, precision, recall, f1, reason), and a label row primary_error_category in `reason`.

    Without `texts` the records of n-grams and of structure are left out, and nothing is computed for them. `keep` writes a table and reads it again.
    """
    pq, gq, c = text.blank_to_null(F.col("pred_query")), text.blank_to_null(F.col("gold_query")), F.col
    placed = {s: text.blank_to_null(F.col(n)) if n in items.columns else F.lit(None).cast("string") for s, n in (("p", "pred_placeholder_query"), ("g", "gold_placeholder_query"))}
    own = ["pq", "gq", "ppq", "gpq"]
    rows = items.select("item_id", "pred", "gold", "evaluated", "allowed", "placeholder_mode", pq.alias("pq"), gq.alias("gq"), *[x.alias(f"{s}pq") for s, x in placed.items()])
    pairs = _scored_texts(rows.select(*own), texts, keep)
    rows = rows.withColumns({"pk": answer_kind(c("pred")), "gk": answer_kind(c("gold"))})
    rows = rows.withColumns({f"{s}{k}": f for s, e in (("p", c("pred")), ("g", c("gold"))) for k, f in (("rows", answer_rows(e)), ("values", answer_rows(e, False)), ("cells", answer_cells(e)))})
    rows = keep(rows.select("*", *[c(f"{s}.{a}").alias(f"{s}_{a}") for s in ("pred", "gold") for a in ("status", "boolean")]).drop("pred", "gold"))

    good = lambda form: F.coalesce(form.isin(*text.EXECUTABLE), F.lit(False))
    lost = first_failure([("prediction_query_missing", c("pq").isNull()), ("gold_query_missing", c("gq").isNull())])
    side = lambda k, name: [(f"{name}_{bad}", k == bad) for bad in ("missing", "error", "unsupported")]
    unanswered = first_failure([*side(c("pk"), "prediction"), *side(c("gk"), "gold")])
    uncelled = first_failure([("prediction_missing", c("pk") == "missing"), ("gold_missing", c("gk") == "missing"), ("prediction_error", c("pk") == "error"), ("gold_error", c("gk") == "error")])
    mixed, ask = c("pk") != c("gk"), c("pk") == "ask"
    equal_ask = F.when(c("pred_boolean") == c("gold_boolean"), 1.0).otherwise(0.0)

    def answer_prf(p: Column, g: Column) -> Column:
        m = scores.set_overlap(p, g)
        return F.struct(*[F.when(mixed, 0.0).when(ask, equal_ask).otherwise(m[k]).alias(k) for k in ("precision", "recall", "f1")])

    exact = lambda p, g: F.when(mixed, 0.0).when(ask, equal_ask).otherwise((F.array_sort(p) == F.array_sort(g)).cast("double"))
    made = {"strict": answer_prf(c("prows"), c("grows")), "plain": answer_prf(c("pvalues"), c("gvalues")), "cells": scores.set_overlap(c("pcells"), c("gcells"))}
    made |= {"same": exact(c("prows"), c("grows")), "same_values": exact(c("pvalues"), c("gvalues"))}
    made["unlisted"] = c("allowed").isNull()
    rows = rows.withColumns(made).drop("prows", "grows", "pvalues", "gvalues", "pcells", "gcells")
    same_texts = reduce(lambda a, b: a & b, [c(n).eqNullSafe(c(f"_{n}")) for n in own])
    rows = rows.join(bounded(pairs.withColumnsRenamed({n: f"_{n}" for n in own}), BROADCAST_TEXTS), same_texts).drop(*[f"_{n}" for n in own])
    rows = rows.withColumn("unknown", F.size(F.array_except(c("pr"), F.coalesce(c("allowed"), F.array().cast("array<string>"))))).drop("pr", "allowed")
    rows = keep(rows.withColumns({"lost": lost, "unanswered": unanswered}))
    lost, unanswered, strict, plain, cells, same = (c(k) for k in ("lost", "unanswered", "strict", "plain", "cells", "same"))

    def refs(name: str, kind: str) -> Column:
        return record(name, "query", c(f"{kind}_refs.f1"), lost, c(f"{kind}_refs"))

    unplaced = first_failure([("not_pgmr_mode", ~c("placeholder_mode")), ("prediction_query_missing", c("pq").isNull())])
    ladder = first_failure([
        ("extraction_failure", c("pq").isNull()), ("unsupported_query_form", ~good(c("pf"))), ("not_evaluated_no_endpoint", ~c("evaluated")), ("gold_query_missing", c("gf").isNull()), ("gold_query_form_unsupported", ~good(c("gf"))),
        ("gold_execution_error", c("gold_status") == "error"), ("prediction_execution_error", c("pred_status") == "error"), ("prediction_not_executed", ~c("pred_status").eqNullSafe("ok")), ("gold_not_executed", ~c("gold_status").eqNullSafe("ok")),
        ("answer_mismatch", unanswered.isNull() & (same == 0.0)),
    ])
    no_endpoint = lambda side_, form: first_failure([("no_endpoint_configured", ~c("evaluated")), (f"unsupported_or_missing_{side_}_query", ~good(form))])
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    of_texts = [
        record("query_bleu", "query", c("bleu"), F.coalesce(lost, first_failure([("too_short", c("n_tokens") < 4)]))),
        *[record(f"query_rouge{k}_f1", "query", c(f"query_rouge{k}"), lost) for k in "12L"],
        *[record(f"pgmr_rouge{k}_f1", "pgmr", c(f"pgmr_rouge{k}"), first_failure([("prediction_query_missing", ~c("placeholder_mode") | c("gpq").isNull() | c("ppq").isNull())])) for k in "12L"],
        record("sparql_structure_match", "query", c("structure.f1"), lost, c("structure")),
    ]
    records = [
        record("query_extracted", "structural", flag(c("pq").isNotNull())),
        record("supported_query_form", "structural", flag(good(c("pf"))), first_failure([("no_extracted_query", c("pq").isNull())])),
        record("query_form_match", "structural", flag(c("pf") == c("gf")), first_failure([("missing_query_form", c("pf").isNull() | c("gf").isNull())])),
        record("prediction_execution_success", "execution", flag(c("pred_status") == "ok"), no_endpoint("prediction", c("pf"))),
        record("gold_execution_success", "execution", flag(c("gold_status") == "ok"), no_endpoint("gold", c("gf"))),
        record("answer_exact_match", "answer", same, unanswered),
        record("answer_precision_recall_f1", "answer", strict["f1"], unanswered, strict),
        record("answer_value_exact_match", "answer", c("same_values"), unanswered),
        record("answer_value_precision_recall_f1", "answer", plain["f1"], unanswered, plain),
        record("answer_cell_value_precision_recall_f1", "answer", cells["f1"], uncelled, cells),
        refs("kg_ref_match", "kg"), refs("predicate_ref_match", "predicate"), refs("class_ref_match", "class"), refs("resource_ref_match", "resource"),
        record("uri_hallucination", "query", flag(c("unknown") > 0), first_failure([("prediction_query_missing", c("pq").isNull()), ("allowed_refs_missing", c("unlisted"))])),
        record("pgmr_unmapped_placeholders", "pgmr", flag(c("unplaced") > 0), unplaced),
        record("query_normalized_exact_match", "query", flag(c("alike")), lost),
        *(of_texts if texts else []),
        F.struct(F.lit("primary_error_category").alias("metric"), F.lit("label").alias("type"), F.lit(False).alias("comparable"), *[F.lit(None).cast("double").alias(k) for k in ("value", "precision", "recall", "f1")], F.coalesce(ladder, F.lit("success")).alias("reason")),
    ]
    return rows.select("item_id", F.inline(F.array(*records)))
