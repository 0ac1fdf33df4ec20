"""Queries over rule playbooks, placeholder memories, prompts and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import prompts
from tessera.operators import curate, memory, rules
from tessera.plans.registry import query

# --- rules -----------------------------------------------------------------

#: Contents of proposed rules by number, and the reason for which each is refused in placeholder form.
PROPOSED = (
    ("use pgmr:known for years", None),
    ("Compare with the GOLD answer first", "mentions_gold_or_reference_target"),
    ("write orkgp:P31 directly", "violates_prediction_format"),
    ("use pgmr:unheard_of instead", "unknown_pgmr_placeholder"),
    ("?contribution pgmr:publication_year is right", "unknown_pgmr_placeholder"),
    ("join contribution -> then pgmr:known, pgmr:publication_year", "unknown_pgmr_placeholder"),
    ("Check the query..", "vague_rule"),
    ("as in Empirical_Research_Practice", "cross_family_leakage"),
    ("  ", "empty_or_unsupported_operation"),
)
_CONTENT = "case conv_id % 9 " + " ".join(f"when {i} then '{c}'" for i, (c, _) in enumerate(PROPOSED)) + " end"
_REASON = "case conv_id % 9 " + " ".join(f"when {i} then {'null' if r is None else repr(r)}" for i, (_, r) in enumerate(PROPOSED)) + " end"


def proposed(tables):
    content = F.element_at(F.array(*[F.lit(c) for c, _ in PROPOSED]), (F.col("conv_id") % 9 + 1).cast("int"))
    return tables("conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "DELETE").otherwise("ADD").alias("type"), content.alias("content"), F.when(F.col("turn") % 2 == 0, "PGMR-Lite").otherwise("sparql").alias("form"))


@query(
    "rule_safety",
    f"""select conv_id, turn, case when turn % 4 = 3 or conv_id % 9 = 8 then 'empty_or_unsupported_operation' when turn % 2 = 0 then {_REASON}
      when conv_id % 9 in (0, 3, 4, 5) then 'violates_prediction_format' when conv_id % 9 = 2 then null else {_REASON} end as reason from conversations""",
)
def rule_safety(tables):
    allowed = F.array(F.lit("pgmr:known"))
    return proposed(tables).select("conv_id", "turn", curate.rejection(F.col("type"), F.col("content"), F.lit("NLP4RE"), F.col("form"), allowed).alias("reason"))


@query("safe_rules", f"select conv_id, turn, {_CONTENT} as content from conversations where conv_id % 9 in (select conv_id % 9 from conversations where turn = 0 and conv_id % 9 = 0)")
def safe_rules(tables):
    """Rules whose content survived the check, wherever they are."""
    rows = proposed(tables)
    safe = rows.where((F.col("turn") == 0) & curate.rejection(F.col("type"), F.col("content"), F.lit("nlp4re"), F.col("form"), F.array(F.lit("pgmr:known"))).isNull())
    return curate.surviving(rows.select("conv_id", "turn", "content"), safe).select("conv_id", "turn", "content")


RULES = "(select n_nationkey as position, 'Region ' || n_regionkey || ' & more' as section, 'nat-' || lpad(n_nationkey::varchar, 5, '0') as id, n_nationkey % 4 as helpful, n_regionkey as harmful, n_name as content from nation)"


def playbook(tables):
    k = F.col("n_nationkey")
    return tables("nation").select(k.alias("position"), F.concat(F.lit("Region "), "n_regionkey", F.lit(" & more")).alias("section"), F.format_string("nat-%05d", k.cast("long")).alias("id"), (k % 4).cast("int").alias("helpful"), F.col("n_regionkey").cast("int").alias("harmful"), F.col("n_name").alias("content"))


@query("next_rule_number", f"select max(cast(id[5:] as bigint)) + 1 as next_number from {RULES}")
def next_rule_number(tables):
    return curate.next_number(playbook(tables))


@query(
    "curator_operations",
    f"""with r as (select * from {RULES}), p as (select s_suppkey as place, case when s_suppkey % 3 = 0 then 'region_' || (s_suppkey % 7) || '_and_more' else 'new' end as wanted from supplier where s_suppkey % 4 <> 1),
    n as (select *, row_number() over (order by place) - 1 as k, case when wanted like 'region%' and (place % 7) < 5 then wanted else 'others' end as section from p)
    select section, (select max(position) from r) + 1 + k as position, case section when 'others' then 'misc' else 'r' || section[8:8] || 'am' end || '-' || lpad(((select max(position) from r) + 1 + k)::varchar, 5, '0') as id, 0 as helpful, 0 as harmful, 'rule ' || place as content, true as added from n
    union all select lower(replace(replace(section, ' ', '_'), '&', 'and')), position, id, helpful, harmful, content, false from r""",
)
def curator_operations(tables):
    k = F.col("s_suppkey")
    wanted = F.when(k % 3 == 0, F.concat(F.lit("Region "), k % 7, F.lit(" & More"))).otherwise("new")
    adds = tables("supplier").select(k.alias("place"), F.when(k % 4 == 1, "UPDATE").otherwise("ADD").alias("type"), wanted.alias("section"), F.concat(F.lit("rule "), k).alias("content"))
    return curate.add_rules(playbook(tables), adds)


@query("chosen_rules", f"select id, '[' || id || '] helpful=' || helpful || ' harmful=' || harmful || ' :: ' || content as line from {RULES} where position % 3 = 0")
def chosen_rules(tables):
    ids = tables("nation").where("n_nationkey % 3 = 0").select(F.format_string("nat-%05d", F.col("n_nationkey").cast("long")).alias("id"))
    return curate.chosen(playbook(tables), ids.unionByName(ids)).select("id", "line")


@query("merged_rules", f"select section, min(position) as position, min_by(id, position) as id, cast(sum(helpful) as bigint) as helpful, cast(sum(harmful) as bigint) as harmful, min_by(content, position) as content, count(*) as n_merged from {RULES} group by 1")
def merged_rules(tables):
    return curate.merged(playbook(tables), "section", "position")


@query("rule_tags", f"select id, helpful + (position % 5 = 1)::int as helpful, harmful + (position % 5 = 2)::int as harmful from {RULES}")
def rule_tags(tables):
    """The last tag of a rule counts."""
    n = F.col("n_nationkey")
    tags = tables("nation").select(F.format_string("nat-%05d", n.cast("long")).alias("id"), F.when(n % 5 == 1, "helpful").when(n % 5 == 2, "harmful").otherwise("neutral").alias("tag"), F.lit(2).alias("pos"))
    return rules.apply_tags(playbook(tables), tags.unionByName(tags.withColumns({"tag": F.lit("helpful"), "pos": F.lit(1)}))).select("id", "helpful", "harmful")


@query(
    "loose_rules",
    """select page_id, case when page_id % 3 = 0 then 'x-' || page_id when page_id % 3 = 1 then 'rule-' || sha256(url)[1:8] end as id, case when page_id % 3 = 0 then 2 when page_id % 3 = 1 then 0 end as helpful, case when page_id % 3 = 0 then 1 when page_id % 3 = 1 then 0 end as harmful, case when page_id % 3 < 2 then url end as content from pages""",
)
def loose_rules(tables):
    n = F.col("page_id")
    line = F.when(n % 3 == 0, F.concat(F.lit("[x-"), n, F.lit("] helpful=2 harmful=1 :: "), "url")).when(n % 3 == 1, F.concat(F.lit("note :: "), "url")).otherwise("## heading")
    return tables("pages").select("page_id", curate.loose_rule(line).alias("r")).select("page_id", "r.*")


@query("playbook_routes", "select c_custkey, lower(c_mktsegment) as family, 'pgmr_' || c_nationkey as form from customer")
def playbook_routes(tables):
    name = F.concat(F.lit("books/"), F.lower("c_mktsegment"), F.lit("__pgmr_"), "c_nationkey", F.lit(".txt"))
    return tables("customer").select("c_custkey", curate.route(name).alias("r")).select("c_custkey", "r.*")


@query(
    "context_in_prompt",
    """select page_id, case page_id % 3 when 0 then 'a question: b ' || 'RULES' || chr(10) || chr(10) || 'question: ' || url when 1 then 'x ' || 'RULES' || chr(10) || chr(10) || '## Input' || url else url || chr(10) || chr(10) || 'RULES' end as prompt from pages""",
)
def context_in_prompt(tables):
    n = F.col("page_id") % 3
    prompt = F.when(n == 0, F.concat(F.lit("a question: b question: "), "url")).when(n == 1, F.concat(F.lit("x ## Input"), "url")).otherwise(F.col("url"))
    return tables("pages").select("page_id", curate.insert_context(prompt, F.lit("RULES")).alias("prompt"))


@query("operation_problems", "select conv_id, turn, case when turn = 0 then 'no_reasoning' when turn = 1 then 'no_operations' when conv_id % 4 = 0 then 'operation_without_type' when conv_id % 4 = 1 then 'add_without_content' when conv_id % 4 = 2 then 'add_without_section' end as problem from conversations")
def operation_problems(tables):
    k, none = F.col("conv_id") % 4, F.lit(None).cast("string")
    one = F.struct(F.when(k != 0, F.lit("ADD")).alias("type"), F.when(k != 2, F.lit("s")).otherwise(none).alias("section"), F.when(k == 1, " ").otherwise("c").alias("content"))
    return tables("conversations").select("conv_id", "turn", curate.operation_problem(F.when(F.col("turn") != 0, F.col("text")), F.when(F.col("turn") != 1, F.array(one))).alias("problem"))


# --- memories ---------------------------------------------------------------

ENTRIES = """(select p_partkey as pos, 'f' || (p_partkey % 3) as family, 'pgmr:Name_' || (p_partkey % 40) as placeholder, 'orkgp:P' || p_partkey as canonical_uri, 'pgmr:alias_' || (p_partkey % 17) as alias from part where p_partkey % 13 <> 0)"""


def memory_rows(tables):
    k = F.col("p_partkey")
    raw = tables("part").select(k.alias("pos"), F.concat(F.lit(" f"), k % 3).alias("family"), F.when(k % 13 != 0, F.concat(F.lit("pgmr:Name_"), k % 40)).alias("placeholder"), F.concat(F.lit("orkgp:P"), k).alias("canonical_uri"), F.array(F.concat(F.lit(" pgmr:alias_"), k % 17), F.lit("words")).alias("aliases"), F.array(F.concat(F.lit("pgmr:alias_"), k % 17), F.lit(None).cast("string")).alias("placeholder_aliases"))
    return memory.entries(raw)


@query("memory_entries", f"select pos, family, placeholder, canonical_uri, alias || ' words' as aliases from {ENTRIES}")
def memory_entries(tables):
    return memory_rows(tables).select("pos", "family", "placeholder", "canonical_uri", F.array_join("aliases", " ").alias("aliases"))


@query("allowed_placeholders", f"with t as (select family, unnest([placeholder, alias]) as token from {ENTRIES}) select family, array_to_string(list_sort(list_distinct(list(token))), ' ') as placeholders from t group by 1")
def allowed_placeholders(tables):
    return memory.allowed(memory_rows(tables)).select("family", F.array_join("placeholders", " ").alias("placeholders"))


@query(
    "placeholder_lookup",
    f"""with e as (select * from {ENTRIES}), q as (select s_suppkey, 'f' || (s_suppkey % 5) as family, 'f2' as fallback, case s_suppkey % 4 when 0 then 'pgmr:Name_' || (s_suppkey % 45) when 1 then 'pgmr:NAME_' || (s_suppkey % 45) when 2 then 'pgmr:Alias_' || (s_suppkey % 20) else 'pgmrc:Name_1' end as token from supplier),
    m as (select s_suppkey, e.*, case when lower(e.placeholder) = lower(q.token) then 1 else 3 end as trust, (e.family <> q.family)::int as fb from q join e on (e.family = q.family or e.family = q.fallback) and (lower(e.placeholder) = lower(q.token) or e.alias = lower(q.token))),
    b as (select *, row_number() over (partition by s_suppkey order by trust, fb desc, pos desc) as r from m)
    select q.s_suppkey, q.token, b.canonical_uri, case trust when 1 then 'exact' when 3 then 'alias' end as decision from q left join b on b.s_suppkey = q.s_suppkey and r = 1""",
)
def placeholder_lookup(tables):
    k = F.col("s_suppkey")
    token = F.when(k % 4 == 0, F.concat(F.lit("pgmr:Name_"), k % 45)).when(k % 4 == 1, F.concat(F.lit("pgmr:NAME_"), k % 45)).when(k % 4 == 2, F.concat(F.lit("pgmr:Alias_"), k % 20)).otherwise("pgmrc:Name_1")
    asked = tables("supplier").select("s_suppkey", F.concat(F.lit("f"), k % 5).alias("family"), F.lit("f2").alias("fallback"), token.alias("token"))
    return memory.resolve_exact(asked, memory_rows(tables)).select("s_suppkey", "token", "canonical_uri", "decision")


@query(
    "memory_topk",
    """with q as (select conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as words from conversations where turn = 0), e as (select n_nationkey as pos, n_name, ['the', 'and', lower(n_name), chr(97 + (n_nationkey % 26)::int), 'of'] as words, n_nationkey % 6 = 0 as core from nation),
    s as (select conv_id, pos, core, case when core then 0 else len(list_intersect(list_distinct(e.words), q.words)) end as score from q, e), k as (select *, row_number() over (partition by conv_id order by core desc, score desc, pos) as place from s where core or score > 0)
    select conv_id, pos, core, score, place from k where place <= 12""",
)
def memory_topk(tables):
    asked = tables("conversations").where("turn = 0").select("conv_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("said"))
    n = F.col("n_nationkey")
    entries = tables("nation").select(n.alias("pos"), "n_name", F.array(F.lit("the"), F.lit("and"), F.lower("n_name"), F.char(97 + n % 26), F.lit("of")).alias("words"))
    scored = memory.held_against(asked, "conv_id", F.col("said"), entries, F.col("words"), F.col("pos") % 6 == 0, "pos")
    return memory.relevant(scored, "conv_id", F.col("n_name"), F.col("core"), F.col("score"), "pos", 12).select("conv_id", "pos", "core", "score", "place")


@query("flat_mapping", "with f as (select 'pgmr:' || p_size as token, 'orkgp:P' || p_partkey as target, p_partkey as pos from part), o as (select 'pgmr:' || s_suppkey as token, 'orkgp:S' || s_suppkey as target from supplier) select token, max_by(target, pos) as target from f group by 1 union all select token, target from o where token not in (select token from f)")
def flat_mapping(tables):
    files = tables("part").select(F.concat(F.lit("pgmr:"), "p_size").alias("token"), F.concat(F.lit("orkgp:P"), "p_partkey").alias("target"), F.col("p_partkey").alias("pos"))
    overrides = tables("supplier").select(F.concat(F.lit("pgmr:"), "s_suppkey").alias("token"), F.concat(F.lit("orkgp:S"), "s_suppkey").alias("target"), F.lit(10**9).cast("long").alias("pos"))
    return memory.flat_mapping(files, overrides)


@query(
    "resolution_events",
    """with r as (select len(regexp_extract_all(url, 'e')) as a, case when page_id % 3 = 0 then len(regexp_extract_all(url, 'th')) else 0 end as b from pages)
    select count_if(a > 0) as alias_item_count, cast(sum(a) as bigint) as alias_placeholder_count, count_if(b > 0) as unmapped_item_count, cast(sum(b) as bigint) as unmapped_placeholder_count from r""",
)
def resolution_events(tables):
    found = lambda p: F.regexp_extract_all(F.col("url"), F.lit(f"({p})"), F.lit(1))
    rows = tables("pages").select(found("e").alias("a"), F.when(F.col("page_id") % 3 == 0, found("th")).alias("b"))
    return memory.resolution_events(rows, {"alias": "a", "unmapped": "b"})


@query(
    "unmapped_summary",
    """with r as (select event_id % 4 <> 0 as c, event_id % 8 = 0 as other, event_id % 5 as n from events)
    select count_if(c) as comparable_count, count_if(not c) as non_comparable_count, count_if(not c and not other) as not_pgmr_mode_count, count_if(c and n > 0) as unmapped_item_count, count_if(c and n = 0) as clean_item_count, cast(sum(case when c then n else 0 end) as bigint) as total_unmapped,
      round_even(avg(case when c then n end), 4) as mean_unmapped, round_even(count_if(c and n > 0) / count_if(c), 4) as unmapped_item_rate from r""",
)
def unmapped_summary(tables):
    e = F.col("event_id")
    rows = tables("events").select(F.when(e % 4 != 0, True).alias("comparable"), F.when(e % 8 == 0, "no_query").otherwise("not_pgmr_mode").alias("reason"), (e % 5 > 0).alias("has_unmapped"), (e % 5).alias("n_unmapped"))
    return memory.unmapped_summary(rows)


# --- prompts ----------------------------------------------------------------


@query(
    "prompt_fields",
    """select doc_id, 'task: label' || chr(10) || 'lang: ' || coalesce(nullif(trim(lang), ''), 'none') || chr(10) || 'types: ' || case when doc_id % 3 = 0 then 'none' else 'a, ' || source end || chr(10) || 'note: none' || chr(10) || 'answer:' as prompt,
      case when lang is null or trim(lang) = '' then coalesce(nullif(trim(source), ''), 'x') else trim(lang) end as best, case when lang is not null and trim(lang) <> '' then 'lang' when source is not null and trim(source) <> '' then 'source' else 'default' end as best_from,
      coalesce(source, '') || '/' || doc_id as filled from documents""",
)
def prompt_fields(tables):
    types = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit(" a "), F.lit(""), F.col("source")))
    best = prompts.first_filled([("lang", F.col("lang")), ("source", F.col("source")), ("default", F.lit("x"))])
    return tables("documents").select("doc_id", prompts.field_prompt("label", [("lang", prompts.said(F.col("lang"))), ("types", prompts.said(types, listed=True)), ("note", prompts.said(F.lit(" ")))], "answer:").alias("prompt"), best["value"].alias("best"), best["source"].alias("best_from"), prompts.filled("{source}/{doc_id}", {"source": F.col("source"), "doc_id": F.col("doc_id")}).alias("filled"))


@query("cut_fields", "select page_id, case when length(trim(html)) <= 300 then trim(html) else rtrim(trim(html)[1:268]) || chr(10) || '...[truncated for ACE]...' end as html, len(list_filter(string_split_regex(html, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) as n_words, 'm / ' || url as label from pages")
def cut_fields(tables):
    return tables("pages").select("page_id", prompts.cut(F.col("html"), 300).alias("html"), prompts.word_count(F.col("html")).cast("long").alias("n_words"), prompts.run_label(F.lit("m"), F.lit(" "), F.col("url")).alias("label"))


@query("kept_fields", "select doc_id, array_to_string(list_sort(list_filter(['lang=' || nullif(lang, ''), 'source=' || nullif(source, '')], lambda x: x is not null)), ' ') as fields from documents")
def kept_fields(tables):
    fields = prompts.without_blanks(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return tables("documents").select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ").alias("fields"))


@query(
    "training_examples",
    """with w as (select conv_id, turn, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w)::bigint) as p, [length(text)::bigint, turn, conv_id] as t from conversations where role = 'user' and trim(text) <> ''),
    c as (select conv_id, turn, p[greatest(len(p) - 8 + 1, 1):] as p, t from w)
    select conv_id, turn, array_to_string(list_concat(p, t, [2]), ' ') as input_ids, array_to_string(list_concat(list_transform(p, lambda x: -100::bigint), t, [2], list_transform(range(12 - len(p) - 4), lambda x: -100::bigint)), ' ') as labels from c""",
)
def training_examples(tables):
    """Prompts keep their tail and are masked; targets are short and end in 2."""
    rows = tables("conversations").where((F.col("role") == "user") & (F.trim("text") != ""))
    ids = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.length(w).cast("long"))
    one = prompts.masked_example(ids, F.array(F.length("text").cast("long"), "turn", "conv_id"), F.lit(2).cast("long"), 8, 6)
    return rows.select("conv_id", "turn", one.alias("x")).select("conv_id", "turn", F.array_join(F.col("x.input_ids").cast("array<string>"), " ").alias("input_ids"), F.array_join(prompts.padded(F.col("x.labels"), 12, prompts.MASKED).cast("array<string>"), " ").alias("labels"))


@query("training_rows", "select doc_id, lang as prompt, source as target from documents where n_chars > 500 and trim(lang) <> '' and trim(source) <> '' order by doc_id limit 20")
def training_rows(tables):
    """The limit is the feature: so many examples of a split."""
    return prompts.training_rows(tables("documents"), "doc_id", F.col("lang"), F.col("source"), F.col("n_chars") > 500, 20)
