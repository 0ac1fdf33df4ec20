"""Queries over result items that are JSON texts, some of them nested five thousand levels deep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.nested import cut_nested, nested_fields
from tessera.operators import items
from tessera.plans.registry import query

#: How deep a row's text is, as SQL that Spark and DuckDB both read.
DEPTH = "case when event_id % 500 = 0 then 2500 else event_id % 7 end"
INNER = """'{"k": ' || event_id || ', "list": [' || repeat('"x", ', cast(event_id % 40 as int)) || '{"bindings": [1, {"a": 2}], "z": null}], "text": "  é' || repeat('ab ', cast((event_id % 3) * 500 as int)) || chr(92) || '"end' || chr(92) || '" ", "results": {"deep": [[]]}, "props": ' || props || '}'"""
WRAPPED = f"""repeat('{{"a": [', cast({DEPTH} as int)) || {INNER} || repeat(', 0]}}', cast({DEPTH} as int))"""


@query(
    "cut_nested",
    f"""with e as (select event_id, cast({DEPTH} as int) as d, cast(event_id % 40 as int) as n, props from events),
    t as (select *, trim('  é' || repeat('ab ', cast((event_id % 3) * 500 as int)) || '"end" ') as own from e),
    c as (select *, case when length(own) <= 1000 then own else rtrim(substr(own, 1, 968)) || chr(10) || '...[truncated for ACE]...' end as cut from t)
    select event_id, repeat('{{"a":[', d) || '{{"k":' || event_id || ',"list":[' || case when n >= 20 then repeat('"x",', 19) || '"x"' else repeat('"x",', n) || '{{"bindings":"[omitted large endpoint response for ACE]","z":null}}' end
      || '],"text":"' || replace(replace(cut, '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '","results":"[omitted large endpoint response for ACE]","props":' || replace(props, ': ', ':') || '}}' || repeat(',0]}}', d) as text from c""",
)
def cut_nested_texts(tables):
    return tables("events").select("event_id", cut_nested(F.expr(WRAPPED), 1000).alias("text"))


@query(
    "nested_fields",
    f"""select event_id, 'number' as k_kind, event_id::varchar as k, 'object' as a_kind, 'string' as text_kind, 'é' || repeat('ab ', cast((event_id % 3) * 500 as int)) || '"end" ' as text, json_extract_string(props, '$.k') as prop, null::varchar as none,
    '{{"deep": ' || repeat('[', cast({DEPTH} as int)) || '"' || event_type || '"' || repeat(']', cast({DEPTH} as int)) || '}}' as whole from events""",
)
def nested_field_values(tables):
    deep = f"""'{{"deep": ' || repeat('[', cast({DEPTH} as int)) || '"' || event_type || '"' || repeat(']', cast({DEPTH} as int)) || '}}'"""
    text = f"""'{{"whole": ' || {deep} || ', "a": {{"text": 1, "b": ' || {INNER} || '}}, "a": {{"b": ' || {INNER} || '}} }}'"""
    paths = {"k": ("a", "b", "k"), "a": ("a",), "text": ("a", "b", "text"), "old": ("a", "text"), "prop": ("a", "b", "props", "k"), "none": ("a", "list", "x"), "whole": ("whole",)}
    f = F.col("f")
    found = tables("events").select("event_id", nested_fields(F.expr(text), paths).alias("f"))
    return found.select("event_id", f["k"]["kind"].alias("k_kind"), f["k"]["text"].alias("k"), f["a"]["kind"].alias("a_kind"), f["text"]["kind"].alias("text_kind"), F.ltrim(f["text"]["text"]).alias("text"), f["prop"]["text"].alias("prop"), F.coalesce(f["none"]["text"], f["old"]["text"]).alias("none"), f["whole"]["text"].alias("whole"))


#: An item for each event: names that are missing, null, empty or there, at each place where a getter looks.
ITEM = f"""'{{"pad": [' || repeat('[', cast({DEPTH} as int)) || repeat(']', cast({DEPTH} as int)) || ']'
 || case event_id % 4 when 1 then ', "family": ""' when 2 then ', "family": "fam' || user_id % 3 || '"' when 3 then ', "family": null' else '' end
 || case event_id % 3 when 1 then ', "entry_metadata": {{"family": "em", "prompt_mode": "m1"}}' when 2 then ', "entry_metadata": {{"family": 0, "prompt_mode": []}}' else '' end
 || case when event_id % 5 = 0 then ', "metadata": {{"family": "md"}}' else '' end
 || case event_id % 6 when 0 then ', "prediction_format": "PGMR-lite", "gold_pgmr_sparql": "p' || event_id || '"' when 1 then ', "prediction_format": "pgmr_lite", "gold_query": "q"' when 2 then ', "gold_sparql": "' || repeat('s', 4100) || '", "gold_query": ""' else '' end
 || case when event_id % 7 = 0 then ', "main_issue": "bad"' else '' end || case when event_id % 11 = 0 then ', "diagnostic_hint": "hint"' else '' end
 || ', "validation": {{"x": 1' || case when event_id % 2 = 0 then ', "primary_error_category": "' || event_type || '"' else '' end
 || case event_id % 9 when 0 then ', "answer_exact_match": {{"value": true}}' when 1 then ', "answer_exact_match": " No "' when 2 then ', "answer_exact_match": null' when 3 then ', "answer_exact_match": {{"no": 1}}' else '' end || '}}'
 || ', "metrics": {{' || case event_id % 8 when 0 then '"answer_f1": {{"value": 1.0}}' when 1 then '"answer_f1": "0.25"' when 2 then '"answer_f1": {{"value": null}}' when 3 then '"answer_f1": "none"' else '' end || '}}'
 || case event_id % 10 when 0 then ', "prediction_execution_success": 0' when 1 then ', "prediction_execution_success": true' when 2 then ', "prediction_execution_success": {{"value": false}}' else '' end
 || case when event_id % 8 > 5 then ', "answer_f1": 0.5, "answer_exact_match": "maybe"' else '' end || '}}'"""
METRICS = ("answer_exact_match", "answer_f1", "prediction_execution_success")


@query(
    "item_getters",
    """select event_id, case when event_id % 4 = 2 then 'fam' || user_id % 3 when event_id % 3 = 1 then 'em' when event_id % 5 = 0 then 'md' else 'unknown_family' end as family,
    case when event_id % 3 = 1 then 'm1' else 'unknown_prompt_mode' end as prompt_mode, case event_id % 6 when 0 then 'PGMR-lite' when 1 then 'pgmr_lite' else 'unknown_format' end as prediction_format,
    case when event_id % 7 = 0 then 'bad' when event_id % 2 = 0 then event_type when event_id % 11 = 0 then 'hint' else 'unknown_issue' end as primary_error,
    case event_id % 6 when 0 then 'p' || event_id when 1 then 'q' when 2 then repeat('s', 3968) || chr(10) || '...[truncated for ACE]...' else '' end as gold,
    case event_id % 6 when 0 then 'gold_pgmr_sparql' when 1 then 'gold_pgmr_sparql_or_fallback' else 'gold_query' end as source from events""",
)
def item_getters(tables):
    item = F.col("item")
    found = tables("events").select("event_id", items.read_items(F.expr(ITEM)).alias("item"))
    return found.select("event_id", *[items.getter(item, name).alias(name) for name in items.GETTERS], items.gold_target(item).alias("g")).select("*", F.col("g.query").alias("gold"), "g.source").drop("g")


@query(
    "judged_items",
    """with m as (select event_id, case event_id % 9 when 0 then true when 1 then false when 2 then null when 3 then null else null end as exact, case event_id % 8 when 0 then 1.0 when 1 then 0.25 when 6 then 0.5 when 7 then 0.5 end as f1,
      case event_id % 10 when 0 then false when 1 then true end as runs from events)
    select event_id, exact, f1::double as f1, runs, coalesce(runs, true) and case when not exact or f1 < 1 then true when exact or f1 is not null then false else true end as wanted,
      case event_id % 9 when 1 then ' No ' else case when event_id % 8 > 5 and event_id % 9 not in (0, 3) then 'maybe' end end as said from m""",
)
def judged_items(tables):
    """Three-valued filters: failures that aren't known not to run."""
    item = F.col("item")
    found = tables("events").select("event_id", items.read_items(F.expr(ITEM), METRICS).alias("item"))
    exact, score, runs = (items.metric_value(item, m) for m in METRICS)
    said = F.when(items.validation_metric(item, METRICS[0])["kind"] == "string", items.validation_metric(item, METRICS[0])["text"])
    return found.select("event_id", items.as_bool(exact).alias("exact"), items.as_float(score).alias("f1"), items.as_bool(runs).alias("runs"), items.of_interest(item, True, True).alias("wanted"), said.alias("said"))


@query(
    "query_status",
    r"""with q as (select doc_id, case doc_id % 3 when 0 then ' Select ?x where {' when 1 then 'ask {' else '' end || coalesce(text, '') || ' pgmr:t' || doc_id % 5 || ' pgmrc:c pgmr:t' || doc_id % 7 || ' orkgp:P' || doc_id % 4 || case when doc_id % 2 = 0 then ' }' else '' end as q from documents)
    select doc_id, regexp_matches(q, '(?i)\A\s*(SELECT|ASK|CONSTRUCT|DESCRIBE)\b') as starts_with_query_type, regexp_matches(q, '(?i)\bWHERE\s*\{') as has_where_block, length(q) - length(replace(q, '{', '')) = length(q) - length(replace(q, '}', '')) as balanced_braces,
      array_to_string(list_sort(list_distinct(regexp_extract_all(q, '\bpgmrc?:[A-Za-z_][A-Za-z0-9_]*'))), ' ') as remaining_pgmr_tokens, array_to_string(list_sort(list_distinct(regexp_extract_all(q, '\borkg[a-z]*:[A-Za-z0-9_]+'))), ' ') as orkg_tokens from q""",
)
def query_status(tables):
    d = "doc_id"
    text = F.expr(f"case {d} % 3 when 0 then ' Select ?x where {{' when 1 then 'ask {{' else '' end || coalesce(text, '') || ' pgmr:t' || {d} % 5 || ' pgmrc:c pgmr:t' || {d} % 7 || ' orkgp:P' || {d} % 4 || case when {d} % 2 = 0 then ' }}' else '' end")
    found = tables("documents").select(d, items.query_status(text).alias("s")).select(d, "s.*")
    return found.withColumns({c: F.array_join(c, " ") for c in ("remaining_pgmr_tokens", "orkg_tokens")})
