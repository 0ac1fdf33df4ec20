"""Edits of rule playbooks: safety of proposed rules, insertion, merging, and routing by file name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.review import lookup
from tessera.operators.rules import first_failure, render_line

# What a rule must not say, alike in any case.
REFERENCE_TERMS = ("gold query", "gold answer", "reference query", "reference answer", "expected query", "hidden label", "hidden reference")
IDENTIFIER_TERMS = ("orkgp:", "orkgc:", "orkgr:", "orkg uri", "orkg id", "orkg identifier", "orkg predicate", "orkg class", "orkg resource")
PLACEHOLDER_TERMS = ("pgmr:", "pgmrc:", "pgmr placeholder", "pgmr-lite placeholder")
VAGUE = ("check the query", "verify the query", "ensure correctness", "use the correct predicates", "use correct predicates", "avoid mistakes", "be accurate")
TOKEN = r"\b(?:pgmr|pgmrc):[A-Za-z0-9_]+\b"
# Structures that are known to be wrong.
BAD_STRUCTURES = (r"(?i)pgmr:has_contribution\s+\?year\b", r"(?i)\?contribution\s+pgmr:publication_year\b", r"(?i)contribution\s*(?:->|→).*pgmr:publication_year", r"(?i)pgmr:has_contribution\s*(?:->|→).*pgmr:publication_year")
FAMILIES = ("nlp4re", "empirical_research_practice")
# What ids of a section begin with.
SLUGS = {"financial_strategies_and_insights": "fin", "formulas_and_calculations": "calc", "code_snippets_and_templates": "code", "common_mistakes_to_avoid": "err", "problem_solving_heuristics": "prob", "context_clues_and_indicators": "ctx", "others": "misc", "meta_strategies": "meta"}


def scope(value: Column) -> Column:
    """Families and formats in one spelling; null is blank."""
    return F.replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit("-"), F.lit("_"))


def section_name(title: Column) -> Column:
    return F.replace(F.replace(F.lower(title), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))


def section_slug(section: Column) -> Column:
    """The fixed slug, else the first four letters of one word, else the initials of five."""
    name = section_name(F.trim(section))
    words = F.split(name, "_")
    initials = F.array_join(F.transform(F.slice(words, 1, 5), lambda w: F.substring(w, 1, 1)), "")
    return F.coalesce(lookup(SLUGS, name), F.when(F.size(words) == 1, F.substring(name, 1, 4)).otherwise(initials))


def _any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def rejection(kind: Column, content: Column, family: Column, form: Column, allowed: Column) -> Column:
    """Why a proposed rule is refused, the first reason that holds; null if none does.

    allowed: the family's placeholders; null or empty where they aren't known,
    and then none is unknown.
    """
    text = F.trim(F.coalesce(content, F.lit("")))
    low, form, family = F.lower(text), scope(form), scope(family)
    placeholders = form == "pgmr_lite"
    said = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)))
    unknown = F.coalesce(F.size(allowed) > 0, F.lit(False)) & (F.size(F.array_except(said, allowed)) > 0)
    structure = F.lit(False)
    for pattern in BAD_STRUCTURES:
        structure = structure | text.rlike(pattern)
    leak = ((family == FAMILIES[0]) & low.contains(FAMILIES[1])) | ((family == FAMILIES[1]) & low.contains(FAMILIES[0]))
    return first_failure([
        ("empty_or_unsupported_operation", ~kind.eqNullSafe("ADD") | (text == "")),
        ("mentions_gold_or_reference_target", _any(low, REFERENCE_TERMS)),
        ("violates_prediction_format", (placeholders & _any(low, IDENTIFIER_TERMS)) | (form.isin("sparql", "direct_sparql") & _any(low, PLACEHOLDER_TERMS))),
        ("unknown_pgmr_placeholder", placeholders & unknown),
        ("known_bad_pgmr_structure", placeholders & structure),
        ("vague_rule", F.regexp_replace(low, r"\.+$", "").isin(*VAGUE)),
        ("cross_family_leakage", leak),
    ])


def surviving(rules: DataFrame, safe: DataFrame, content: str = "content") -> DataFrame:
    """Rules whose content is among the safe ones; equal contents share a fate."""
    return rules.join(safe.select(content).distinct(), content, "left_semi")


def operation_problem(reasoning: Column, operations: Column) -> Column:
    """What is wrong with a curator's answer. operations: an array of structs of type, section and content."""
    bad_add = F.exists(operations, lambda o: (o["type"] == "ADD") & (F.coalesce(F.trim(o["content"]), F.lit("")) == F.lit("")))
    return first_failure([("no_reasoning", reasoning.isNull()), ("no_operations", operations.isNull()), ("operation_without_type", F.exists(operations, lambda o: o["type"].isNull())), ("add_without_content", bad_add), ("add_without_section", F.exists(operations, lambda o: (o["type"] == "ADD") & o["section"].isNull()))])


def next_number(rules: DataFrame, id_: str = "id") -> DataFrame:
    """(next_number): one more than the largest number that an id ends in; 1 without any. One row."""
    return rules.agg((F.coalesce(F.max(F.regexp_extract(id_, r"-(\d+)$", 1).try_cast("long")), F.lit(0)) + 1).alias("next_number"))


def add_rules(rules: DataFrame, proposed: DataFrame) -> DataFrame:
    """The rules with proposals of type ADD after those of their section: (section, position, id, helpful, harmful, content, added).

    rules: section, position, id, helpful, harmful, content; proposed: place,
    type, section, content. Sections are matched by name in one spelling; a
    section that isn't there is `others`. New ids go on from the largest
    number, in order of place. Proposals are few; sections are counted by a
    join, not on the driver.
    """
    known = rules.select(section_name(F.col("section")).alias("_section")).distinct().withColumn("_known", F.lit(True))
    number = F.row_number().over(Window.orderBy("place")) - 1
    adds = proposed.where(F.col("type") == "ADD").withColumn("_section", section_name(F.coalesce("section", F.lit("general")))).join(known, "_section", "left")
    section = F.when(F.col("_known") | (F.col("_section") == "general"), F.col("_section")).otherwise(F.lit("others"))
    adds = adds.withColumn("section", section).withColumn("_n", number).crossJoin(F.broadcast(next_number(rules)))  # one row
    last = rules.agg(F.coalesce(F.max("position"), F.lit(0)).alias("_last"))  # one row
    adds = adds.crossJoin(F.broadcast(last))
    new = adds.select("section", (F.col("_last") + 1 + F.col("_n")).alias("position"), F.format_string("%s-%05d", section_slug(F.col("section")), F.col("next_number") + F.col("_n")).alias("id"), F.lit(0).alias("helpful"), F.lit(0).alias("harmful"), F.coalesce("content", F.lit("")).alias("content"), F.lit(True).alias("added"))
    old = rules.select(section_name(F.col("section")).alias("section"), "position", "id", "helpful", "harmful", "content", F.lit(False).alias("added"))
    return old.unionByName(new)


def chosen(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines of the rules whose ids are listed."""
    return rules.join(ids.select("id").distinct(), "id", "left_semi").withColumn("line", render_line(F.col("id"), F.col("helpful"), F.col("harmful"), F.col("content")))


def merged(rules: DataFrame, group: str, position: str, add_up: bool = True) -> DataFrame:
    """One rule of each group: the first by position, with the counts of all or its own."""
    first = lambda c: F.min_by(c, position).alias(c)
    count = lambda c: (F.sum(c) if add_up else F.min_by(c, position)).alias(c)
    return rules.groupBy(group).agg(F.min(position).alias(position), first("id"), count("helpful"), count("harmful"), first("content"), F.count(F.lit(1)).alias("n_merged"))


def loose_rule(line: Column) -> Column:
    """A struct of id, helpful, harmful and content, also of lines that only have a `::`; their id is a hash of the content."""
    strict = r"^\[([^\]]+)\]\s*helpful=(\d+)\s*harmful=(\d+)\s*::\s*(.*)$"
    text = F.trim(line)
    full, part = text.rlike(strict), text.contains("::")
    content = F.when(full, F.regexp_extract(text, strict, 4)).when(part, F.trim(F.regexp_extract(text, r"^.*?::(.*)$", 1)))
    return F.struct(F.when(full, F.regexp_extract(text, strict, 1)).when(part, F.concat(F.lit("rule-"), F.substring(F.sha2(content, 256), 1, 8))).alias("id"), *[F.when(full, F.regexp_extract(text, strict, i).cast("int")).when(part, 0).alias(n) for i, n in ((2, "helpful"), (3, "harmful"))], content.alias("content"))


def route(name: Column) -> Column:
    """Family and format of a playbook's file name `{family}__{format}.txt`."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    return F.struct(F.regexp_extract(stem, r"^(.*?)__", 1).alias("family"), F.regexp_extract(stem, r"^.*?__(.*)$", 1).alias("form"))


def insert_context(prompt: Column, context: Column, markers: Sequence[str] = ("question:", "## Input")) -> Column:
    """The prompt with the context before the last marker that it has, once; after it where it has none."""
    out = F.concat_ws("\n\n", prompt, context)
    for mark in reversed(markers):
        after = F.substring_index(prompt, mark, -1)
        before = F.substring(prompt, F.lit(1), F.length(prompt) - F.length(after) - len(mark))
        out = F.when(prompt.contains(mark), F.concat(before, context, F.lit(f"\n\n{mark}"), after)).otherwise(out)
    return F.when(F.coalesce(context, F.lit("")) == "", prompt).otherwise(out)
