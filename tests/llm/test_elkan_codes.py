"""Elkan's rounds against plain Lloyd rounds, and the cases that the docstring defines."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op11_elkan_codes as op11

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds with Python's integers; {(vec_id, code, error, label error)}, codebooks."""
    whole = [(i, [math.floor(4096 * x) for x in np.float32(v).tolist()], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted({(i, tuple(q)) for i, q, _ in whole if i is not None})
    seeds = [q for n, (i, q) in enumerate(seeds) if n == 0 or seeds[n - 1][0] != i][:entries]
    size = len(seeds[0]) // parts
    cut = lambda q: [q[p * size : (p + 1) * size] for p in range(parts)]
    books = [[list(cut(s)[p]) for s in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda q: [min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e)) for p, x in enumerate(cut(q))]
    for _ in range(rounds):
        codes = [nearest(q) for _, q, _ in whole]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(q)[p] for (_, q, _), c in zip(whole, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, errors = [], {}
    for i, q, label in whole:
        code = nearest(q)
        error = sum(far(x, books[p][code[p]]) for p, x in enumerate(cut(q)))
        errors[label] = errors.get(label, 0) + error
        out.append((i, label, tuple(code), error))
    return sorted(((i, c, e, errors[label]) for i, label, c, e in out), key=str), books


def got(spark, rows, **args):
    codes, books = op11.learn_codes(spark.createDataFrame(rows, SCHEMA).repartition(3), **args)
    found = op11.label_errors(codes).collect()
    return sorted(((r["vec_id"], tuple(r["code"]), r["error"], r["label_error"]) for r in found), key=str), books.tolist()


def vectors(seed, n=300, width=16, steps=None):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(20)]
    draw = lambda c: [r.choice(steps) if steps else r.gauss(x, 0.3) for x in c]
    return [(i, draw(r.choice(centres)), r.choice([None, 1, 2, 3])) for i in range(n)]


def test_equals_plain_rounds(spark):
    rows = vectors(1) + [(None, vectors(2, 1)[0][1], 1), (3, vectors(3, 1)[0][1], 2), (7, None, 1), (400, [float("nan")] * 16, 1), (401, [math.inf] * 16, 1), (402, [None] * 16, 1)]
    rows += rows[5:8]
    rows += [(500 + i, rows[0][1], 9) for i in range(200)]
    random.Random(4).shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_ties_and_equal_entries(spark):
    rows = vectors(6, 250, 8, steps=[0.0, 1 / 4096, 2 / 4096, -1 / 4096])
    rows[1] = (1, rows[0][1], 1)  # two entries are equal from the start
    assert got(spark, rows) == plain(rows)


def test_few_vectors_and_other_lengths(spark):
    rows = [(4, [0.5] * 8, 1), (9, [0.25] * 8, None), (5, [1.0] * 16, 1)]
    assert got(spark, rows) == plain(rows[:2])
    codes, books = op11.learn_codes(spark.createDataFrame([], SCHEMA))
    assert codes.count() == 0 and op11.digest(books) == hashlib.sha256(b"").hexdigest()
    assert op11.learn_codes(spark.createDataFrame([(1, None, 1)], SCHEMA))[0].count() == 0
    for bad in ([1.0] * 9, [1e6] * 8):
        with pytest.raises(ValueError):
            op11.learn_codes(spark.createDataFrame([(1, bad, 1)], SCHEMA))


def test_pruning_keeps_bounds_and_leaves_out_most_distances():
    r = np.random.default_rng(8)
    centres = r.integers(-4000, 4000, (16, 8))
    x = centres[r.integers(0, 16, 5000)] + r.integers(-300, 300, (5000, 8))
    book = op11.Codebook(x[:16].copy())
    own, upper, lower = op11.first_assignment(x, book)
    spent = 0
    for _ in range(6):
        entries = np.stack([x[own == e].sum(0) // max(1, (own == e).sum()) if (own == e).any() else book.entries[e] for e in range(16)])
        book = op11.Codebook(entries, book.entries)
        own, upper, lower, n = op11.assign(x, own, upper, lower, book)
        spent += n
        true = ((x[:, None] - entries[None]) ** 2).sum(-1)
        assert np.array_equal(own, true.argmin(1))
        root = np.sqrt(true.astype(np.float64))
        assert (upper >= root[np.arange(len(x)), own]).all() and (lower <= root).all()
    assert spent < 0.3 * 6 * x.shape[0] * 16


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame(vectors(5, 40), SCHEMA)
    for name in ("q", "own", "upper", "lower", "code", "error", "_label", "slot"):
        df = df.withColumn(name, F.lit("x"))
    assert op11.label_errors(op11.learn_codes(df)[0]).count() == 40


def test_query_equals_sql(spark, tmp_path):
    rows = vectors(11, 120) + [(200, None, 1), (201, [math.nan] * 16, 1)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    theirs = sorted(map(tuple, duck.sql(op11.ORACLE).df()[["vec_id", "code", "error", "label_error", "codebooks_sha256"]].values.tolist()))
    ours = sorted(map(tuple, op11.query(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    assert ours == theirs
