"""Queries over what a question's context names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import context
from tessera.plans.registry import query

KEYWORDS = "select lower(string_split(text, ' ')[3]) as keyword, left(lower(string_split(text, ' ')[4]), 2) as token from benchmark where len(string_split(text, ' ')) >= 5"


@query(
    "relevant_placeholders",
    f"""with k as ({KEYWORDS}), q as (select doc_id, lang, lower(text) as t from documents),
    n as (select lang, 'pgmr:' || string_split(text, ' ')[5] as placeholder, min(item_id) as pos, max((item_id % 9 = 0)::int) as core from benchmark, (select distinct lang from documents) where len(string_split(text, ' ')) >= 5 group by all),
    w as (select distinct doc_id, lang, token from q join k on contains(t, keyword)),
    c as (select doc_id, placeholder, pos, core from w join n on n.lang = w.lang and contains(lower(placeholder), token) union select doc_id, placeholder, pos, core from q join n using (lang) where core = 1),
    r as (select *, row_number() over (partition by doc_id order by core desc, pos, placeholder) as place from c)
    select doc_id, place, placeholder from r where place <= 35""",
)
def relevant_placeholders(tables):
    """The documents as questions; keywords, their tokens and the placeholders are words of the benchmark."""
    word = F.split(F.col("text"), " ")
    b = tables("benchmark").where(F.size(word) >= 5)
    keywords = b.select(F.lower(word[2]).alias("keyword"), F.left(F.lower(word[3]), F.lit(2)).alias("token"))
    names = b.select(F.concat(F.lit("pgmr:"), word[4]).alias("placeholder"), F.col("item_id").alias("pos"), (F.col("item_id") % 9 == 0).alias("core"))
    placeholders = names.join(F.broadcast(tables("documents").select("lang").distinct()))  # a handful of languages
    return context.relevant_placeholders(tables("documents"), "doc_id", "lang", "text", placeholders, keywords)


@query(
    "allowed_in_prompt",
    """select doc_id, case when doc_id % 3 = 0 then 'pgmr:a' || doc_id || ' pgmrc:b' when doc_id % 3 = 1 then 'pgmr:c pgmr:d' else '' end as allowed from documents""",
)
def allowed_in_prompt(tables):
    """Prompts round every document, with a block that a question ends, that the text's end ends, or without one."""
    text, k = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)\bpgmrc?:", ""), F.col("doc_id").cast("string")
    ended = F.concat(text, F.lit("\npgmr:before\n  Allowed core PGMR-lite placeholders of all:\r\n pgmr:a"), k, F.lit("\nno line\npgmrc:b  \nquestion: x\npgmr:after\n"), text)
    open_ = F.concat(text, F.lit("\nallowed core pgmr-lite placeholders\npgmr:c\n\n pgmr:d"))
    prompt = F.when(F.col("doc_id") % 3 == 0, ended).when(F.col("doc_id") % 3 == 1, open_).otherwise(F.concat(F.lit("pgmr:no\n"), text))
    return tables("documents").select("doc_id", F.array_join(context.allowed_in_prompt(prompt), " ").alias("allowed"))
