"""Operators without SQL against plain loops, and what refuses bad input."""

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import prompts
from tessera.operators import curate, dedupe, memory, placeholders, review, split


def plain_picks(rows, family_quota, passes):
    """rows: (key, rank, family, second columns by name) in any order."""
    used, taken = Counter(), {}
    for number, wanted in enumerate(passes, 1):
        for key, rank, family, more in sorted(rows, key=lambda r: (r[1], r[0])):
            if key in taken or used["family", family] >= family_quota.get(family, 0):
                continue
            if wanted is not None and used[wanted[0], more[wanted[0]]] >= wanted[1].get(more[wanted[0]], 0):
                continue
            taken[key] = number
            used["family", family] += 1
            for name, value in more.items():
                used[name, value] += 1
    return taken


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_picks_by_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.randint(0, 3), r.choice("abcx"), {"kind": r.choice(["s", "t", "u", "v"]), "level": r.choice(["lo", "hi", "no"])}) for i in range(300)]
    quota = {"a": 12, "b": 5, "c": 30}
    df = spark.createDataFrame([(k, n, f, m["kind"], m["level"]) for k, n, f, m in rows], "key long, rank int, family string, kind string, level string")
    for passes in ([("kind", {"s": 4, "t": 9}), ("level", {"lo": 8, "hi": 3}), None], [("level", {"lo": 20}), None], [("kind", {"s": 50, "u": 1})]):
        got = {x["key"]: x["pass"] for x in split.greedy_picks(df, "key", ["rank"], "family", quota, passes).collect()}
        assert got == plain_picks(rows, quota, passes)
    assert split.greedy_picks(df.where("false"), "key", ["rank"], "family", quota, [None]).count() == 0


def test_double_quota_by_a_plain_loop(spark):
    r = random.Random(4)
    rows = [(i, r.randint(0, 20), r.choice("ab"), r.choice("xyz")) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, rank int, one string, two string")
    first, second, size = {"a": 7, "b": 4}, {"x": 3, "y": 6}, 9
    left, right, want = dict(first), dict(second), []
    for k, _, a, b in sorted(rows, key=lambda x: (x[1], x[0])):
        if len(want) < size and left.get(a, 0) > 0 and right.get(b, 0) > 0:
            left[a] -= 1
            right[b] -= 1
            want.append(k)
    assert sorted(x["key"] for x in split.double_quota(df, "key", "rank", "one", "two", first, second, size).collect()) == sorted(want)


def test_resolution_by_plain_scores(spark):
    known = ["pgmr:publication_year", "pgmr:research_methods", "pgmr:has_contribution", "pgmr:year"]
    asked = ["pgmr:publicationYear", "pgmr:research_method", "pgmr:nothing_like_it", "pgmr:years"]
    words = lambda t: frozenset(w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 3 else w for w in "".join(f"_{c}" if c.isupper() else c for c in t[5:]).lower().split("_"))

    def score(a, b):
        x, y = words(a), words(b)
        base = 0.55 * len(x & y) / len(x | y) + 0.45 * difflib.SequenceMatcher(None, a, b).ratio()
        return round(min(1.0, base + (0.03 if a in b or b in a else 0) + (0.07 if x == y else 0)), 4)

    missing = spark.createDataFrame([("f", t) for t in asked], "scope string, token string")
    candidates = spark.createDataFrame([("f", t, i) for i, t in enumerate(known)], "scope string, candidate string, pos int")
    own = lambda t, c: placeholders.similarity(t, c, placeholders.words_of(t), placeholders.words_of(c))
    got = {x["token"]: x for x in placeholders.resolve(missing, candidates, own).collect()}
    for t in asked:
        ranked = sorted(((-score(t, c), i) for i, c in enumerate(known)))
        best, second = -ranked[0][0], -ranked[1][0]
        assert (got[t]["candidate"], got[t]["accepted"]) == (known[ranked[0][1]], best >= 0.9 or best >= 0.75 and best - second >= 0.08)
        assert abs(got[t]["score"] - best) < 2e-4 and abs(got[t]["second"] - second) < 2e-4


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_groups_by_a_plain_loop(spark, seed):
    r = random.Random(seed)
    links = {tuple(sorted(r.sample(range(60), 2))) for _ in range(90)}
    nodes, leader = sorted({x for p in links for x in p}), {}
    for i in nodes:
        if i not in leader:
            leader[i] = i
            for j in nodes:
                if j > i and j not in leader and (i, j) in links:
                    leader[j] = i
    df = spark.createDataFrame([p if r.random() < 0.5 else p[::-1] for p in links], "a long, b long")
    assert {x["node"]: x["leader"] for x in dedupe.greedy_groups(df).collect()} == leader


def test_sequential_dedupe_with_null_keys(spark):
    rows = [(1, None, "a"), (2, None, "a"), (3, "x", None), (4, "x", "b"), (5, None, None), (6, None, None), (7, "y", "b")]
    got = {x["p"]: x["kept"] for x in dedupe.sequential_dedupe(spark.createDataFrame(rows, "p long, q string, s string"), "p", "q", "s").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: True}


def test_cosine_matches_by_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(900, [0.0] * 6), (901, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1e-300
    want = {(a, b) for a, x in rows[:5] for b, y in rows if y is not None and a != b and sum(p * q for p, q in zip(x, y)) / norm(x) / norm(y) >= 0.5}
    got = {(x["query"], x["other"]) for x in dedupe.cosine_matches(df.where("k < 5"), df, "k", "v", 0.5, block=2).collect()}
    assert got == want and want
    assert dedupe.cosine_matches(df.where("false"), df, "k", "v").count() == 0


def test_what_refuses(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    with pytest.raises(ValueError, match="missing: 2"):
        review.strict_join(one, one.where("id = 1"), "id")
    with pytest.raises(ValueError, match="repeated_right: 1"):
        review.strict_join(one.where("id = 1"), one.where("id = 1").unionByName(one.where("id = 1")), "id")
    with pytest.raises(ValueError, match="length"):
        review.paired(one, one.where("id = 1"), "id", ("x", "x"))
    with pytest.raises(ValueError, match="positive"):
        split.first_rows(one, "id", 0)
    with pytest.raises(ValueError, match="unknown fields"):
        prompts.filled("{nobody}", {})
    assert review.strict_join(one, one.withColumnRenamed("x", "y"), "id").count() == 2


def test_bad_structures_are_refused(spark):
    said = ["?contribution pgmr:publication_year ?y", "pgmr:has_contribution ?YEAR", "contribution -> x pgmr:publication_year", "pgmr:has_contribution → pgmr:publication_year", "?paper pgmr:publication_year ?y"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    why = [r[0] for r in df.select(curate.rejection(F.lit("ADD"), F.col("s"), F.lit("nlp4re"), F.lit("pgmr-lite"), F.lit(None).cast("array<string>"))).collect()]
    assert why == ["known_bad_pgmr_structure"] * 4 + [None]


def test_memory_tokens_of_several_entries(spark):
    raw = spark.createDataFrame([("f", "pgmr:A", "u1", ["pgmr:b"], None, 1), ("f", "pgmr:a", "u2", [], None, 2), ("g", "pgmr:A", "u3", None, ["x y"], 3), (" ", "pgmr:q", "u4", None, None, 4)], "family string, placeholder string, canonical_uri string, aliases array<string>, placeholder_aliases array<string>, pos int")
    asked = spark.createDataFrame([("f", "g", "pgmr:A"), ("f", "g", "pgmr:B"), (None, "g", "pgmr:A"), ("f", None, "pgmr:none")], "family string, fallback string, token string")
    got = [tuple(r)[2:] for r in memory.resolve_exact(asked, memory.entries(raw)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("pgmr:A", "pgmr:A", "u3", "exact"), ("pgmr:B", "pgmr:A", "u1", "alias"), ("pgmr:A", "pgmr:A", "u3", "exact"), ("pgmr:none", None, None, None)]))
