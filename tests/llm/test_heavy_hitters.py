"""q-digests and heavy keys against exact counts."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op13_heavy_hitters as op13

COLUMNS = ("stream", "grp", "item", "n_entries", "total", "w", "low", "estimate", "high")


def exact(entries, share=20):
    """{(stream, grp, item): (n, total, w)} of the heavy keys."""
    n, total, w = Counter(), Counter(), Counter()
    for stream, grp, item, weight in entries:
        if grp is not None and item is not None and weight is not None and weight >= 0:
            n[stream, grp] += 1
            total[stream, grp] += weight
            w[stream, grp, item] += weight
    return {k: (n[k[:2]], total[k[:2]], v) for k, v in w.items() if share * v > total[k[:2]]}


def agrees(rows, entries, share=20):
    found = {(r["stream"], r["grp"], r["item"]): (r["n_entries"], r["total"], r["w"]) for r in rows}
    assert len(found) == len(rows) and found == exact(entries, share)
    for r in rows:
        assert r["low"] <= r["w"] <= r["high"] and r["low"] <= r["estimate"] <= r["high"]
        assert share * 10 * (r["high"] - r["low"]) <= r["total"]


@pytest.mark.parametrize("depth", [1, 5, 12])
def test_digests_are_bounded_and_hold_their_counts(depth):
    r, k = np.random.default_rng(depth), 200 * depth
    for weights in (1, 50):
        parts, whole = [], Counter()
        for _ in range(7):
            ids = np.minimum(r.zipf(1.2, 30_000) - 1, (1 << depth) - 1)
            w = r.integers(0, weights + 1, len(ids))
            for i, x in zip(ids.tolist(), w.tolist(), strict=True):
                whole[i] += x
            g, v, c = op13.compress(np.zeros(len(ids), np.int64), ids + (1 << depth), w, np.array([w.sum() // k]), depth)
            assert len(v) <= 3 * k and c.sum() == w.sum()
            parts.append((g, v, c))
        total = sum(whole.values())
        g, v, c = op13.compress(*(np.concatenate(x) for x in zip(*parts, strict=True)), np.array([total // k]), depth)
        assert len(v) <= 3 * k and c.sum() == total
        assert all(x <= total // k for n, x in zip(v.tolist(), c.tolist(), strict=True) if n < 1 << depth)
        held = dict(zip(v.tolist(), c.tolist(), strict=True))
        for i, w in whole.items():
            low = held.get(i + (1 << depth), 0)
            high = low + sum(held.get((i + (1 << depth)) >> s, 0) for s in range(1, depth + 1))
            assert low <= w <= high <= low + total // 200


def test_light_families_move_up_and_heavy_ones_stay():
    g, v, c = op13.compress(np.zeros(4, np.int64), np.array([4, 5, 6, 7]), np.array([1, 2, 9, 1]), np.array([5]), 2)
    assert list(zip(v.tolist(), c.tolist(), strict=True)) == [(1, 3), (6, 9), (7, 1)]
    none = np.empty(0, np.int64)
    assert [len(x) for x in op13.compress(none, none, none, none, 3)] == [0, 0, 0]


def test_groups_side_by_side_equal_groups_alone():
    r, depth = np.random.default_rng(3), 10
    group, ids, w = r.integers(0, 40, 20_000), r.integers(0, 1 << depth, 20_000), r.integers(0, 9, 20_000)
    least = np.bincount(group, w, 40).astype(np.int64) // r.integers(5, 5000, 40)
    g, v, c = op13.compress(group, ids + (1 << depth), w, least, depth)
    for i in range(40):
        own = group == i
        alone = op13.compress(np.zeros(own.sum(), np.int64), ids[own] + (1 << depth), w[own], least[i : i + 1], depth)
        assert np.array_equal(v[g == i], alone[1]) and np.array_equal(c[g == i], alone[2])


def stream(seed, rows=6000):
    r = random.Random(seed)
    out = []
    for _ in range(rows):
        name, grp = r.choice([("a", 1), ("a", 1), ("a", r.randint(2, 400)), ("b", -7), ("b", r.randint(-3, 3))])
        item = f"k{min(int(r.paretovariate(0.8)), 3000)}" if r.random() < 0.8 else r.choice(["", "é", "k1", " k1"])
        out.append((name, grp if r.random() > 0.01 else None, item if r.random() > 0.01 else None, r.choice([None, -3, 0, 1, 1, 2, 50])))
    return out


@pytest.mark.parametrize("share,held,fan", [(20, 1 << 20, 64), (20, 500, 2), (3, 100, 3)])
def test_equals_exact_counts(spark, monkeypatch, share, held, fan):
    monkeypatch.setattr(op13, "HELD", held)
    monkeypatch.setattr(op13, "FAN", fan)
    entries = stream(share + held)
    df = spark.createDataFrame(entries, "stream string, grp long, item string, weight long").repartition(7)
    for name in ("id", "part", "w", "low", "total", "_row"):
        df = df.withColumn(name, F.lit("x"))
    found = op13.heavy_hitters(df, share)
    assert tuple(found.columns) == COLUMNS
    agrees(found.collect(), entries, share)


def test_large_groups_are_compressed(spark):
    r = random.Random(5)
    entries = [("s", 1, f"u{r.randrange(30_000)}" if r.random() < 0.7 else f"h{r.randrange(6)}", 1) for _ in range(60_000)]
    rows = op13.heavy_hitters(spark.createDataFrame(entries, "stream string, grp long, item string, weight long").repartition(6)).collect()
    agrees(rows, entries)
    depth = 15
    coded = spark.createDataFrame([("s", 1, i, 1) for i in range(30_000)] * 2, "stream string, grp long, id long, weight long").repartition(5)
    (digest,) = op13.summaries(coded, depth, 200 * depth).collect()
    assert digest["n"] == digest["total"] == 60_000 and len(digest["nodes"]) <= 3 * 200 * depth and min(digest["nodes"]) < 1 << depth


def test_empty_table_and_groups_of_no_weight(spark):
    schema = "stream string, grp long, item string, weight long"
    assert op13.heavy_hitters(spark.createDataFrame([], schema)).count() == 0
    assert op13.heavy_hitters(spark.createDataFrame([("a", 1, "x", 0), ("a", 2, None, 1)], schema)).count() == 0


def test_properties():
    keys = op13.prop_keys
    assert keys('{"device": {"os": "tv", "ver": "1"}, "tags": ["b", null, "b"], "items": [{"sku": 7, "qty": 1}, {"sku": 7}, {"qty": 2}]}') == ["os=tv", "tag=b", "tag=b", "sku=7", "sku=7"]
    assert keys(' {"tags": [true, 1.50, 12345678901234567890, {"a": 1}, [2]], "items": null, "device": []} ') == ["tag=true", "tag=1.50", "tag=12345678901234567890"]
    for bad in (None, "", "{", '{"device": {"os": "tv"}', '{"device": {"os": "tv"}} x', '{"tags": ["a"], }', "{'tags': ['a']}", '{"tags": ["a", NaN]}', '{"tags": ["a\n"]}', '{"tags": ["\\x"]}', '["a"]', "3"):
        assert keys(bad) == []
    assert keys('{"tags": ["\\ud800", "\\ud83d\\ude00"]}') == ["tag=�", "tag=\U0001f600"]
    deep = "[" * 200_000 + "]" * 200_000
    assert keys('{"x": %s, "tags": ["a"]}' % deep) == ["tag=a"]
    assert keys('{"x": %s], "tags": ["a"]}' % deep) == []


def test_deep_parser_equals_the_json_module():
    r = random.Random(2)

    def value(depth):
        kind = r.randrange(7 if depth else 5)
        if kind < 5:
            return [None, True, "a\"\\\né", -1.5e3, 12][kind]
        return [value(depth - 1) for _ in range(r.randrange(4))] if kind == 5 else {r.choice("abc"): value(depth - 1) for _ in range(r.randrange(4))}

    for _ in range(500):
        text = json.dumps(value(5), indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        if r.random() < 0.6:
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice(['"', "]", "}", ",", ":", "1", " ", ""]) + text[at + r.randrange(2) :]
        read = []
        for parse in (lambda t: json.loads(t, parse_int=str, parse_float=str, parse_constant=op13._refuse), op13.parse_deep):
            try:
                read.append(parse(text))
            except ValueError:
                read.append(ValueError)
        assert read[0] == read[1], text


def test_query_over_the_shop(spark, tmp_path):
    r = random.Random(9)
    start = datetime(1969, 12, 31, 22, 30)
    clicks, lines, entries = [], [], []
    for _ in range(3000):
        ts = None if r.random() < 0.02 else start + timedelta(seconds=r.randrange(20_000), microseconds=r.randrange(1_000_000))
        client = None if r.random() < 0.02 else int(r.paretovariate(0.7)) % 500
        props = r.choice([None, "{", '{"device": {"os": "tv"}}', '{"device": {"os": "web"}, "tags": ["a", "é", null]}', '{"items": [{"sku": %d}, {"sku": 0}]}' % r.randrange(50)])
        clicks.append((ts, client, props))
        hour = None if ts is None else int((ts - datetime(1970, 1, 1)).total_seconds() // 3600)
        entries.append(("user", hour, None if client is None else str(client), 1))
        entries += [("prop", client, k, 1) for k in op13.prop_keys(props)]
        line = (r.choice([None, 1, 1, 2, r.randrange(90)]), r.choice([None, r.randrange(300), 5]), r.choice([None, 0, 1, 50]))
        lines.append(line)
        entries.append(("part", line[0], None if line[1] is None else str(line[1]), line[2]))
    spark.createDataFrame(clicks, "ts timestamp_ntz, client_id long, props string").write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(lines, "vendor_id long, item_id long, quantity int").write.parquet(f"{tmp_path}/sale_lines.parquet")
    agrees(op13.query(spark, str(tmp_path)).collect(), entries)
