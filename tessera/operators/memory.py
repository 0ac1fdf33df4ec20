"""Memories of placeholders: entries, lookup in order of trust, ranking for a question, and counts of how tokens were resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.placeholders import bounded

# Entries that every question gets.
CORE_PLACEHOLDERS = ("pgmr:has_contribution", "pgmr:publication_year", "pgmrc:empirical_research_practice_contribution", "pgmrc:nlp4re_contribution")
CORE_IDENTIFIERS = ("orkgp:P31", "orkgp:P29", "orkgc:C27001", "orkgc:C121001")
TOKEN = r"^pgmrc?:[A-Za-z_][A-Za-z0-9_]*$"


def canonical(token: Column) -> Column:
    """Relations in lower case; all else as it is."""
    return F.when(token.startswith("pgmr:"), F.lower(token)).otherwise(token)


def entries(raw: DataFrame) -> DataFrame:
    """(family, placeholder, canonical_uri, aliases, pos) of rows that have all three; both alias lists are one, in order, each once.

    raw: family, placeholder, canonical_uri, aliases, placeholder_aliases, pos.
    """
    trimmed = raw.withColumns({c: F.trim(c) for c in ("family", "placeholder", "canonical_uri")})
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "placeholder_aliases")]
    aliases = F.array_distinct(F.filter(F.transform(F.concat(*lists), lambda x: F.trim(x)), lambda a: a.isNotNull() & (a != "")))
    return trimmed.where((F.col("family") != "") & (F.col("placeholder") != "") & (F.col("canonical_uri") != "")).select("family", "placeholder", "canonical_uri", aliases.alias("aliases"), "pos")


def names(memory: DataFrame) -> DataFrame:
    """(family, token, trust, placeholder, canonical_uri): what each token may stand for, 1 most trusted.

    1 the placeholder, 2 its canonical spelling, 3 an alias, 4 its canonical
    spelling. Where entries share a token the last by pos counts, as it does
    for exact tokens of both spellings together.
    """
    alias = F.filter("aliases", lambda a: a.rlike(TOKEN))
    both = lambda token, trust: F.array(F.struct(token.alias("token"), F.lit(trust).alias("trust")), F.struct(canonical(token).alias("token"), F.lit(trust).alias("trust")))
    listed = F.concat(both(F.col("placeholder"), 1), F.flatten(F.transform(alias, lambda a: both(a, 3))))
    rows = memory.select("family", "placeholder", "canonical_uri", "pos", F.inline(listed))
    return rows.groupBy("family", "token", "trust").agg(F.max_by(F.struct("placeholder", "canonical_uri"), "pos").alias("_e")).select("family", "token", "trust", "_e.placeholder", "_e.canonical_uri")


def resolve_exact(tokens: DataFrame, memory: DataFrame) -> DataFrame:
    """tokens: family, fallback, token. Adds placeholder, canonical_uri and decision: exact, alias or null.

    Tokens are looked up in their family and the fallback family, as they are
    and in canonical spelling, each an equi-join; the most trusted answer
    counts, the fallback's where both answer alike in trust.
    """
    known = bounded(names(memory))
    tries = F.array(*[F.struct(f.alias("_family"), t.alias("_token"), F.lit(n).alias("_spelled"), F.lit(b).alias("_fallback")) for f, b in ((F.col("family"), 0), (F.col("fallback"), 1)) for n, t in ((0, F.col("token")), (1, canonical(F.col("token"))))])
    asked = tokens.select("family", "fallback", "token").distinct()
    met = asked.select("*", F.inline(tries)).join(known.select(F.col("family").alias("_family"), F.col("token").alias("_token"), "trust", "placeholder", "canonical_uri"), ["_family", "_token"])
    order = F.struct("trust", "_spelled", (-F.col("_fallback")).alias("_f"))
    best = met.groupBy("family", "fallback", "token").agg(F.min_by(F.struct("trust", "placeholder", "canonical_uri"), order).alias("_e"))
    out = tokens.join(best, (tokens["family"].eqNullSafe(best["family"])) & (tokens["fallback"].eqNullSafe(best["fallback"])) & (tokens["token"] == best["token"]), "left").select(tokens["*"], "_e")
    return out.select(*tokens.columns, "_e.placeholder", "_e.canonical_uri", F.when(F.col("_e.trust") == 1, "exact").when(F.col("_e.trust") == 3, "alias").alias("decision"))


def is_core(placeholder: Column, identifier: Column) -> Column:
    return F.coalesce(placeholder.isin(*CORE_PLACEHOLDERS), F.lit(False)) | F.coalesce(identifier.isin(*CORE_IDENTIFIERS), F.lit(False))


def overlap(words: Column, question: Column) -> Column:
    """How many distinct words an entry and a question share."""
    return F.size(F.array_intersect(words, question))


def held_against(questions: DataFrame, question: str, said: Column, memory: DataFrame, words: Column, core: Column, pos: str) -> DataFrame:
    """questions x the entries of a memory that share a word with them, with `score`, and its core entries, with `core`.

    An equi-join by word, counted before anything is sorted; core entries, a
    fixed few, travel as one row.
    """
    asked = questions.select(question, F.explode(F.array_distinct(said)).alias("_word"))
    known = memory.withColumn("core", core)
    met = known.where(~F.col("core")).select(pos, F.explode(F.array_distinct(words)).alias("_word")).join(asked, "_word").groupBy(question, pos).agg(F.count(F.lit(1)).alias("score"))
    scored = met.join(bounded(known.where(~F.col("core"))), pos).select(question, *known.columns, "score")
    few = known.where(F.col("core")).agg(F.collect_list(F.struct(*known.columns)).alias("_few"))  # as many as there are core entries
    always = questions.select(question).distinct().crossJoin(F.broadcast(few)).select(question, F.inline("_few")).withColumn("score", F.lit(0).cast("long"))
    return scored.unionByName(always)


def relevant(scored: DataFrame, question: str, key: Column, core: Column, score: Column, pos: str, most: int = 30) -> DataFrame:
    """Of each question the core entries, then the others with a score, best first and in order; one of each key, `most` in all.

    Entries that can't be chosen go before any sort.
    """
    rows = scored.withColumns({"_key": key, "_core": core, "_score": F.when(core, F.lit(0)).otherwise(score)}).where((F.col("_core") | (F.col("_score") > 0)) & F.col("_key").isNotNull() & (F.col("_key") != ""))
    order = [F.desc("_core"), F.desc("_score"), F.col(pos)]
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(question, "_key").orderBy(*order))).where(F.col("_n") == 1)
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy(question).orderBy(*order))).where(F.col("place") <= most)
    return ranked.drop("score", "core", "_n", "_key").withColumnRenamed("_score", "score").withColumnRenamed("_core", "core")


def allowed(memory: DataFrame) -> DataFrame:
    """(family, placeholders): what rules of a family may name, aliases that are tokens included."""
    tokens = F.explode(F.concat(F.array("placeholder"), F.filter("aliases", lambda a: a.rlike(TOKEN)))).alias("token")
    return memory.select("family", tokens).groupBy("family").agg(F.array_sort(F.collect_set("token")).alias("placeholders"))


def flat_mapping(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """(token, target) over all files; overrides lose to files, of several the last by pos counts. Both: token, target, pos."""
    rows = files.withColumn("_from", F.lit(1)).unionByName(overrides.withColumn("_from", F.lit(0)))
    return rows.groupBy("token").agg(F.max_by("target", F.struct("_from", "pos")).alias("target"))


def resolution_events(results: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Per kind, items with events and the events in all. kinds: name of the count to an array column; null is empty."""
    sizes = {n: F.greatest(F.size(c), F.lit(0)) for n, c in kinds.items()}
    return results.agg(*[f for n, size in sizes.items() for f in (F.count_if(size > 0).alias(f"{n}_item_count"), F.coalesce(F.sum(size), F.lit(0)).alias(f"{n}_placeholder_count"))])


def unmapped_summary(records: DataFrame) -> DataFrame:
    """records: comparable, reason, has_unmapped, n_unmapped. Counts, totals and rates of unresolved placeholders."""
    c = F.coalesce("comparable", F.lit(False))
    n = F.when(c, F.col("n_unmapped"))
    return records.agg(
        F.count_if(c).alias("comparable_count"), F.count_if(~c).alias("non_comparable_count"), F.count_if(~c & (F.col("reason") == "not_pgmr_mode")).alias("not_pgmr_mode_count"),
        F.count_if(c & F.col("has_unmapped")).alias("unmapped_item_count"), F.count_if(c & ~F.col("has_unmapped")).alias("clean_item_count"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_unmapped"), F.bround(F.avg(n), 4).alias("mean_unmapped"), F.bround(F.count_if(c & F.col("has_unmapped")) / F.nullif(F.count_if(c), F.lit(0)), 4).alias("unmapped_item_rate"),
    )
