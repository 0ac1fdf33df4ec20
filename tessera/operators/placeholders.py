"""Queries between identifiers and placeholders, and the ranking of near misses."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a dictionary is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table that is proven small, leave a larger one to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rewrite(queries: DataFrame, key: str, text: str, pattern: str, mapping: DataFrame, scope: str | None = None) -> DataFrame:
    """(key, rewritten, n_tokens, n_mapped, missing): each match of the pattern replaced by its mapped token.

    mapping: token, target and, with a scope, that column too. Where a token
    has several targets the one with the highest `pos` counts. The text is cut
    at the matches, the pieces are joined with the mapping, and put together
    again, so a token is replaced whole and once.
    """
    scopes = [scope] if scope else []
    last = mapping.groupBy(*scopes, "token").agg(F.max_by("target", "pos").alias("target"))
    found = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(F.col(text), pattern, -1)
    pieces = queries.select(F.col(key), *scopes, F.posexplode(F.arrays_zip(gaps.alias("gap"), found.alias("token"))).alias("at", "piece")).select(key, *scopes, "at", "piece.gap", "piece.token")
    joined = pieces.join(bounded(last), [*scopes, "token"], "left")
    put = F.concat(F.coalesce("gap", F.lit("")), F.coalesce("target", "token", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("at", put.alias("text"))))
    missing = F.array_sort(F.collect_set(F.when(F.col("target").isNull(), F.col("token"))))
    return joined.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("rewritten"),
        F.count("token").alias("n_tokens"),
        F.count(F.when(F.col("token").isNotNull(), F.col("target"))).alias("n_mapped"),
        missing.alias("missing"),
    )


def rewrite_status(n_tokens: Column, n_mapped: Column, known_scope: Column) -> Column:
    return F.when(~known_scope, "unknown_family").when(n_tokens == n_mapped, "ok").when(n_mapped > 0, "partially_mapped").otherwise("unmapped_uri")


def words_of(token: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The words of a placeholder: camel case, `_` and `-` are cut, plurals and repeats go, synonyms are made one."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"^[a-z]+:", ""), r"([a-z0-9])([A-Z])", "$1_$2"), r"[-_\s]+", " ")
    words = F.filter(F.split(F.lower(F.trim(cut)), " "), lambda w: w != "")
    single = lambda w: F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    words = F.transform(words, single)
    if synonyms:
        table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_distinct(words)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


@F.arrow_udf(T.DoubleType())
def _ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([difflib.SequenceMatcher(None, a.as_py() or "", b.as_py() or "").ratio() for a, b in zip(left, right, strict=True)], pa.float64())


def similarity(a: Column, b: Column, words_a: Column, words_b: Column) -> Column:
    """Words and characters together, a little more for one inside the other or equal; 1 at most."""
    inside = F.when((a.contains(b) | b.contains(a)) & (F.length(a) > 0) & (F.length(b) > 0), 0.03).otherwise(0.0)
    same = F.when(F.array_sort(words_a) == F.array_sort(words_b), 0.07).otherwise(0.0)
    return F.bround(F.least(0.55 * jaccard(words_a, words_b) + 0.45 * _ratio(a, b) + inside + same, F.lit(1.0)), 4)


def resolve(missing: DataFrame, candidates: DataFrame, score, accept: float = 0.90, likely: float = 0.75, margin: float = 0.08) -> DataFrame:
    """The best candidate of each missing token, and whether it is accepted.

    missing: scope, token; candidates: scope, candidate, pos. score(token,
    candidate) is a column. Accepted at `accept`, or at `likely` when the
    second best is `margin` behind. Equal scores go to the earlier candidate.
    """
    scored = missing.join(bounded(candidates), "scope").withColumn("score", score(F.col("token"), F.col("candidate")))
    order = Window.partitionBy("scope", "token").orderBy(F.desc("score"), "pos")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    best = ranked.where(F.col("rank") == 1)
    sure = (F.col("score") >= accept) | ((F.col("score") >= likely) & (F.col("score") - F.col("second") >= margin))
    return best.select("scope", "token", "candidate", "score", "second", sure.alias("accepted"))
