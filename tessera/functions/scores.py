"""Scores as columns: overlap, n-grams, costs, ranks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r4(x: Column) -> Column:
    """Four places, half to even."""
    return F.bround(x, 4)


def precision_recall_f1(both: Column, predicted: Column, gold: Column) -> Column:
    """Struct of precision, recall and f1; both sides empty is 1, one side empty 0."""
    empty, one = (predicted == 0) & (gold == 0), (predicted == 0) | (gold == 0)
    p, r = F.try_divide(both.cast("double"), predicted), F.try_divide(both.cast("double"), gold)
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    pick = lambda x: F.when(empty, 1.0).when(one, 0.0).otherwise(x)
    return F.struct(pick(p).alias("precision"), pick(r).alias("recall"), pick(f).alias("f1"))


def set_overlap(predicted: Column, gold: Column) -> Column:
    """Arrays as sets."""
    both = F.size(F.array_intersect(predicted, gold))
    return precision_recall_f1(both, F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold)))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: a column named in a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a unit separator; empty if there are fewer."""
    count = F.size(words) - (n - 1)
    runs = bound(words, lambda own: F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(own, i, n), "\x1f")))
    return F.when(count > 0, runs).otherwise(F.array().cast("array<string>"))


def repeats(values: Column) -> Column:
    """What is left of an array, in order, when each distinct value goes once."""
    return bound(F.array_sort(values), lambda rows: F.filter(rows, lambda v, i: v == F.get(rows, i - 1)))


def numbered(values: Column) -> Column:
    """Each value of an array in order with the number of its occurrence, so that a multiset becomes a set."""
    return bound(values, lambda rows: F.transform(rows, lambda v, i: F.struct(v.alias("v"), (i - F.array_position(rows, v)).alias("n"))))


def multiset_matches(predicted: Column, gold: Column) -> Column:
    """Size of the multiset intersection of two arrays: that of their sets, and of their repeats, which are few, by number."""
    return F.size(F.array_intersect(predicted, gold)) + F.size(F.array_intersect(numbered(repeats(predicted)), numbered(repeats(gold))))


def multiset_overlap(predicted: Column, gold: Column) -> Column:
    return precision_recall_f1(multiset_matches(predicted, gold), F.size(predicted), F.size(gold))


def bleu(predicted: Column, gold: Column, order: int = 4) -> Column:
    """BLEU with one added to matches and totals of every order, and a brevity penalty.

    Null where the prediction has fewer words than `order`: not comparable.
    """
    logs = F.lit(0.0)
    for n in range(1, order + 1):
        p, g = ngrams(predicted, n), ngrams(gold, n)
        logs = logs + F.log((multiset_matches(p, g) + 1) / (F.size(p) + 1))
    short = F.when(F.size(predicted) > F.size(gold), 1.0).otherwise(F.exp(1 - F.size(gold) / F.size(predicted)))
    return F.when(F.size(predicted) >= order, short * F.exp(logs / order))


def rouge_n(predicted: Column, gold: Column, n: int) -> Column:
    """F1 of n-grams; texts that are too short for any compare whole."""
    p, g = ngrams(predicted, n), ngrams(gold, n)
    whole = F.when(predicted == gold, 1.0).otherwise(0.0)
    return F.when((F.size(p) == 0) & (F.size(g) == 0), whole).otherwise(multiset_overlap(p, g)["f1"])


@F.arrow_udf(T.IntegerType())
def _lcs(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else lcs(a, b) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int32())


def lcs(left: list, right: list) -> int:
    """Longest common subsequence; a row of the table is the bits of one number."""
    places: dict = {}
    for i, w in enumerate(left):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(left)) - 1, (1 << len(left)) - 1
    for w in right:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(left) - row.bit_count()


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two arrays; it has no built-in form that is fast."""
    return _lcs(left, right)


def rouge_l(predicted: Column, gold: Column) -> Column:
    return precision_recall_f1(lcs_length(predicted, gold), F.size(predicted), F.size(gold))


def token_cost(prompt: Column, cached: Column, completion: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """US dollars at prices per million tokens, to eight places."""
    hit = F.least(F.greatest(cached, F.lit(0)), prompt)
    return F.bround(((prompt - hit) * price_in + hit * price_cached + completion * price_out) / 1e6, 8)


def rule_score(question: Column, plan: Column, words: Column, helpful: Column, harmful: Column, concrete: Column) -> Column:
    """Shared words with the question, twice those with the plan, and the rule's record."""
    shared = F.size(F.array_intersect(words, question)) + 2 * F.size(F.array_intersect(words, plan))
    return shared + 0.5 * F.least(helpful, F.lit(5)) - F.least(harmful, F.lit(5)) + F.when(concrete, 1.0).otherwise(0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decimal_form(value: Column) -> Column:
    """A decimal numeral of any length in one spelling, by string surgery; other texts as they are.

    Signs, leading and trailing zeros and exponents go; -0 is 0.
    """
    pattern = r"^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,3}))?$"

    def read(text: Column) -> Column:
        sign, whole, part = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
        exponent = F.coalesce(F.try_to_number(F.regexp_extract(text, pattern, 4), F.lit("S999")), F.lit(0)).cast("int")
        return F.struct(text.alias("text"), sign.alias("sign"), F.concat(whole, part).alias("digits"), (F.length(whole) + exponent).alias("point"))

    def placed(r: Column) -> Column:
        zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
        padded = F.concat(zeros(-r["point"]), r["digits"], zeros(r["point"] - F.length(r["digits"])))
        return F.struct(r["text"].alias("text"), r["sign"].alias("sign"), r["digits"].alias("digits"), padded.alias("padded"), F.greatest(r["point"], F.lit(0)).alias("at"))

    def sides(r: Column) -> Column:
        left = F.regexp_replace(F.substring(r["padded"], F.lit(1), r["at"]), r"^0+", "")
        right = F.regexp_replace(F.substring(r["padded"], r["at"] + 1, F.length(r["padded"])), r"0+$", "")
        body = F.concat(F.when(left == "", "0").otherwise(left), F.when(right == "", "").otherwise(F.concat(F.lit("."), right)))
        return F.struct(r["text"].alias("text"), r["sign"].alias("sign"), r["digits"].alias("digits"), body.alias("body"))

    def spelled(r: Column) -> Column:
        number = F.when((r["sign"] == "-") & (r["body"] != "0"), F.concat(F.lit("-"), r["body"])).otherwise(r["body"])
        return F.when(r["text"].rlike(pattern) & (F.length(r["digits"]) > 0), number)

    return F.coalesce(let(let(let(let(F.trim(value), read), placed), sides), spelled), value)
