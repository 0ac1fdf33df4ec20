"""What models write back: JSON in prose, judgements, final answers, bullet ids."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The five scores of a judgement, each 0 to 2, and its verdicts.
SCORES = ("intent", "schema", "projection", "constraint", "aggregation")
VERDICTS = ("correct", "partially_correct", "incorrect")


def first_json(text: str | None) -> str | None:
    """The first balanced JSON object in a text; one that is cut off is closed where it ends."""
    if not text:
        return None
    start = text.find("{")
    while start >= 0:
        closers, quoted, escaped = [], False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted = escaped or c != '"'
                escaped = not escaped and c == "\\"
            elif c == '"':
                quoted = True
            elif c in "{[":
                closers.append("}" if c == "{" else "]")
            elif c in "}]":
                if not closers or closers.pop() != c:
                    break
                if not closers:
                    found = text[start : i + 1]
                    return found if _valid(found) else first_json(text[start + 1 :])
        else:
            body = text[start:] + ('"' if quoted else "")
            closed = body.rstrip().rstrip(",") + "".join(reversed(closers))
            return closed if _valid(closed) else None
        start = text.find("{", start + 1)
    return None


def _valid(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


@F.arrow_udf(T.StringType())
def _first_json(texts: pa.Array) -> pa.Array:
    return pa.array([first_json(t) for t in texts.to_pylist()], pa.string())


def json_in(text: Column) -> Column:
    return _first_json(text)


def verdict(text: Column) -> Column:
    """One of the verdicts, by lower case and `_`; null for others."""
    spelled = F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")
    spelled = F.when(spelled.isin("partial", "partly_correct", "partially"), "partially_correct").otherwise(spelled)
    return F.when(spelled.isin(*VERDICTS), spelled)


def judgement(raw: Column) -> Column:
    """Struct of the scores, their sum, verdict, main_issue and why it is not valid (null if it is)."""
    fields = T.StructType([T.StructField(f"{s}_score", T.IntegerType()) for s in SCORES] + [T.StructField(n, T.StringType()) for n in ("verdict", "main_issue")])
    parsed = F.from_json(json_in(raw), fields)
    values = [parsed[f"{s}_score"] for s in SCORES]
    reason = F.when(parsed.isNull(), "no_json")
    for s, v in zip(SCORES, values, strict=True):
        reason = reason.when(v.isNull() | ~v.between(0, 2), f"bad_{s}_score")
    reason = reason.when(verdict(parsed["verdict"]).isNull(), "bad_verdict")
    total = values[0]
    for v in values[1:]:
        total = total + v
    return F.struct(*[v.alias(f"{s}_score") for s, v in zip(SCORES, values, strict=True)], total.alias("overall_score"), verdict(parsed["verdict"]).alias("verdict"), parsed["main_issue"].alias("main_issue"), reason.alias("reason"))


def final_answer(text: Column) -> Column:
    """An answer from JSON, a box, or the words before it; else the last line that is not blank."""
    blank = lambda x: F.when(F.trim(x) != "", F.trim(x))
    tries = [F.get_json_object(json_in(text), "$.final_answer"), F.get_json_object(json_in(text), "$.answer"), F.regexp_extract(text, r"\\boxed\{([^{}]*)\}", 1), F.regexp_extract(text, r"(?i)(?:final answer|answer)\s*(?:is\s*:?|:)\s*([^\n]+)", 1)]
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(*map(blank, tries), F.trim(F.try_element_at(lines, F.lit(-1))))


def bullet_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([a-z]{2,}-\d{5})\]"), F.lit(1)))


def truncated(text: Column, most: int = 2500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def looks_truncated(query: Column) -> Column:
    """Unbalanced braces or parentheses, or an end in the middle of a pattern."""
    count = lambda c: F.length(query) - F.length(F.replace(query, F.lit(c)))
    return (count("{") != count("}")) | (count("(") != count(")")) | F.rtrim(query).rlike(r"(?:[;,(]|\b(?:WHERE|FILTER|OPTIONAL|SELECT|BY))$")


def http_status(error: Column) -> Column:
    return F.regexp_extract(error, r"\b([45]\d\d)\b", 1).try_cast("int")


def error_signature(error: Column) -> Column:
    """White space as one, numbers as #, 200 characters."""
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(error, r"\s+", " ")), r"\d+", "#"), 1, 200)
