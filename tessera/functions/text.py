"""Query text as columns: extraction, normalisation, references, placeholders.

All of it is built-in functions, so it stays in generated code. Patterns are
Java's; `(?U)` makes classes Unicode where that matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the data model, and the namespaces that they stand for.
PREFIXES = {
    "orkgr": "http://orkg.org/orkg/resource/",
    "orkgc": "http://orkg.org/orkg/class/",
    "orkgp": "http://orkg.org/orkg/predicate/",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
}
# Forms that a query can have, and those that can be executed.
FORMS = ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
EXECUTABLE = ("select", "ask")


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_fences(text: Column) -> Column:
    opened = F.regexp_replace(F.trim(text), r"(?i)^\s*```(?:sparql|sql|ttl|turtle)?\s*", "")
    return F.trim(F.regexp_replace(opened, r"\s*```\s*$", ""))


def drop_comment_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^[ \t]*#.*(?:\n|$)", "")


def drop_prefix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?im)^[ \t]*PREFIX\s.*(?:\n|$)", "")


def extract_query(raw: Column) -> Column:
    """The query in a model's output: from its first form word on; null if there is none."""
    body = drop_prefix_lines(drop_comment_lines(strip_fences(raw)))
    return blank_to_null(F.regexp_extract(body, rf"(?is)\b(?:{'|'.join(FORMS)})\b.*", 0))


def query_form(query: Column) -> Column:
    """select, ask, construct, describe, or unknown; null for a blank query."""
    head = F.upper(F.ltrim(drop_prefix_lines(query)))
    form = F.lit("unknown")
    for name in FORMS:
        form = F.when(head.startswith(name), name.lower()).otherwise(form)
    return F.when(F.trim(query) != "", form)


def with_prefixes(query: Column) -> Column:
    block = "\n".join(f"PREFIX {k}: <{v}>" for k, v in PREFIXES.items()) + "\n\n"
    return F.when(F.upper(F.ltrim(query)).startswith("PREFIX "), query).otherwise(F.concat(F.lit(block), F.ltrim(query)))


def storage_form(query: Column) -> Column:
    """Without leading comments and PREFIX declarations; no trailing space; at most one blank line in a row."""
    bare = F.regexp_replace(query, r"(?i)^(?:\s*#[^\n]*(?:\n|$)|\s*PREFIX\s+[A-Za-z_][\w-]*:\s*<[^>]*>)*\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def mask_literals_and_comments(query: Column) -> Column:
    """String literals and everything after the first # of a line become spaces."""
    quoted = F.regexp_replace(query, r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'", " ")
    return F.regexp_replace(quoted, r"(?m)#.*$", " ")


def comparison_form(query: Column) -> Column:
    """One spelling for queries that differ in fences, comments, spacing or prefix order."""
    text = strip_fences(query)
    # Literals and IRIs are consumed first, so that a # inside them is no comment; possessively, as a long literal would exhaust the stack.
    text = F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|' + r"'[^'\\]*+(?:\\.[^'\\]*+)*+'|<[^>\s]*>)|#[^\n]*", "$1")
    declared = r"(?i)\b(?:BASE\s+<[^>]*>|PREFIX\s+[A-Za-z_][\w-]*:\s*<[^>]*>)"
    heads = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(declared), F.lit(0)), squeeze)))
    body = F.regexp_replace(text, declared, " ")
    return squeeze(F.regexp_replace(F.concat_ws(" ", F.array_join(heads, " "), body), r"([{}();,])", " $1 "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda t: t != "")


# Fixed value: what counts as a token when n-grams of queries are compared.
NGRAM_TOKEN = r"<[^>\s]+>|\?[A-Za-z_]\w*|[A-Za-z_][\w-]*:[A-Za-z_][\w-]*|\"(?:[^\"\\]|\\.)*\"|\d+(?:\.\d+)?|[A-Za-z_]\w*|[^\s\w]"


def ngram_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NGRAM_TOKEN), F.lit(0)), F.lower)


# How references are written, in any case of prefix and path.
SHORT_REFERENCE = r"(?i)(?<![\w-])orkg[pcr]:[A-Za-z_][A-Za-z0-9_-]*"
FULL_REFERENCE = r"(?i)https?://(?:www\.)?orkg\.org/orkg/(?:predicate|class|resource)/[A-Za-z_][A-Za-z0-9_-]*"


def references_in_text(text: Column) -> Column:
    """Distinct sorted references `prefix:id` of any text, prefixed or as full IRIs, literals included."""
    short = F.transform(F.regexp_extract_all(text, F.lit(f"({SHORT_REFERENCE})"), F.lit(1)), lambda r: F.concat(F.lower(F.substring_index(r, ":", 1)), F.lit(":"), F.substring_index(r, ":", -1)))
    full = F.transform(F.regexp_extract_all(text, F.lit(f"({FULL_REFERENCE})"), F.lit(1)), lambda r: F.concat(F.lit("orkg"), F.lower(F.substring(F.element_at(F.split(r, "/"), -2), 1, 1)), F.lit(":"), F.element_at(F.split(r, "/"), -1)))
    return F.array_sort(F.array_union(short, full))


def references(query: Column) -> Column:
    """Distinct sorted references of a query, outside literals and comments."""
    return references_in_text(mask_literals_and_comments(query))


def references_of(refs: Column, kind: str) -> Column:
    return F.filter(refs, lambda r: r.startswith(f"orkg{kind}:"))


# The spellings that an unresolved placeholder can have.
PLACEHOLDERS = (r"\bpgmrc?:[A-Za-z_][A-Za-z0-9_]*", r"<(?:pgmrc?):[^>\s]+>", r"\{\{[^{}]+\}\}", r"\[\[[^\[\]]+\]\]")


def placeholders(text: Column) -> Column:
    """Distinct sorted placeholders that are still in a text."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PLACEHOLDERS]
    out = found[0]
    for more in found[1:]:
        out = F.array_union(out, more)
    return F.array_sort(F.array_distinct(out))


def question_key(text: Column) -> Column:
    """For duplicates: lower case, one space, no quotes nor closing punctuation."""
    return F.trim(F.translate(F.lower(squeeze(text)), "\"'?.!,;:", ""))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{Alnum}._-]", "_")


# Words and signs by which components of a query are recognised.
COMPONENTS = ("SELECT", "ASK", "CONSTRUCT", "DISTINCT", "FILTER", "OPTIONAL", "UNION", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "COUNT", "SUM", "AVG", "MIN", "MAX", "NOT EXISTS", "REGEX")


def components_of(query: Column) -> Column:
    upper = F.upper(query)
    return F.array_compact(F.array(*[F.when(upper.contains(c), F.lit(c)) for c in COMPONENTS]))


def triple_patterns(query: Column) -> Column:
    """How many ` .` a query has; how many `.` if none."""
    count = lambda sign: ((F.length(query) - F.length(F.replace(query, F.lit(sign)))) / len(sign)).cast("long")
    return F.when(count(" .") > 0, count(" .")).otherwise(count("."))


def complexity(components: Column, patterns: Column) -> Column:
    score = F.size(components) + patterns
    return F.when(score <= 7, "low").when(score <= 13, "medium").otherwise("high")
