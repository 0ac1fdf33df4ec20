"""Nested JSON against the json module, and texts that are too deep for it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import nested
from tessera.operators.reports import token_pairs

DROPPED = frozenset(("results", "bindings"))


def value(r, depth):
    kind = r.randrange(8 if depth else 6)
    if kind < 6:
        return [None, True, ' q"\\\n ', "é" * r.randrange(90), -1.5, "\U0001f600 x"][kind]
    return [value(r, depth - 1) for _ in range(r.randrange(6))] if kind == 6 else {r.choice(["a", "b", "results", "é\n"]): value(r, depth - 1) for _ in range(r.randrange(5))}


def shorter(v):
    if isinstance(v, str):
        v = v.strip()
        return v if len(v) <= 60 else v[:28].rstrip() + nested.NOTE
    if isinstance(v, list):
        return [shorter(x) for x in v[:3]]
    if isinstance(v, dict):
        return {k: json.loads(nested.OMITTED) if k in DROPPED else shorter(x) for k, x in v.items()}
    return v


def at(v, path):
    for name in path:
        if not isinstance(v, dict) or name not in v:
            return "nothing"
        v = v[name]
    return v


def test_equals_the_json_module():
    r = random.Random(7)
    for _ in range(600):
        v = value(r, 5)
        text = json.dumps(v, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5)
        assert json.loads(nested.shortened(text, 60, 3, DROPPED)) == shorter(v)
        paths = [(), ("a",), ("a", "b"), ("b", "a", "results"), ("é\n",)]
        for path, found in zip(paths, nested.fields_of(text, paths), strict=True):
            expected = at(v, path)
            if found is None:
                assert expected == "nothing"
            else:
                assert (found[1] if found[0] == "string" else json.loads(found[1])) == expected


def test_what_is_no_json():
    r = random.Random(8)
    refused = 0
    for _ in range(800):
        text = json.dumps(value(r, 4))
        cut = r.randrange(len(text) + 1)
        text = text[:cut] + r.choice(['"', "]", "}", ",", ":", "1", " ", "\\", "[", ""]) + text[cut + r.randrange(2) :]
        try:
            json.loads(text)
            list(nested.events(text))
        except ValueError:
            refused += 1
            with pytest.raises(ValueError):
                list(nested.events(text))
    assert refused > 300


def test_equal_names_and_depth():
    twice = '{"a": {"b": 1, "c": 2}, "a": {"b": 3}}'
    assert nested.fields_of(twice, [("a", "b"), ("a", "c"), ("a",)]) == [("number", "3"), None, ("object", '{"b": 3}')]
    n = 100_000
    deep = '{"a": [' * n + '"pgmr:x orkgp:P1"' + "]}" * n
    assert nested.shortened(deep, 9, 20, DROPPED).count("[") == n + 1  # one in the note
    assert token_pairs(deep) == [("pgmr:x", "orkgp:P1")] * n
    assert nested.fields_of('{"x": %s, "y": "\\ud800"}' % deep, [("y",)]) == [("string", "�")]


def test_pairs_equal_a_recursive_reading():
    r = random.Random(3)
    words = ["pgmr:a", "pgmr:b", "orkgp:P1", "orkgc:C2", "none"]

    def draw(depth):
        if not depth or r.random() < 0.3:
            return " ".join(r.choice(words) for _ in range(r.randrange(3)))
        return [draw(depth - 1) for _ in range(r.randrange(4))] if r.random() < 0.4 else {str(i): draw(depth - 1) for i in range(r.randrange(4))}

    def tokens(v, out):
        own = set(v.split()) if isinstance(v, str) else set()
        slot = len(out)
        if isinstance(v, dict):
            out.append(None)
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            own |= tokens(x, out)
        if isinstance(v, dict):
            p, i = ([w for w in own if w.startswith(k)] for k in ("pgmr", "orkg"))
            out[slot] = (p[0], i[0]) if len(p) == len(i) == 1 else None
        return own

    for _ in range(300):
        v, out = draw(4), []
        tokens(v, out)
        assert token_pairs(json.dumps(v)) == [x for x in out if x]
    assert token_pairs("{") == token_pairs(None) == []


def test_nulls_and_broken_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (3, ""), (4, '{"a": {"b": null}}')], "i int, t string")
    rows = df.select("i", nested.cut_nested(F.col("t")).alias("c"), nested.nested_fields(F.col("t"), {"b": ("a", "b"), "z": ("z",)}).alias("f")).orderBy("i").collect()
    assert [r["c"] for r in rows] == [None, None, None, '{"a":{"b":null}}']
    assert rows[3]["f"]["b"]["kind"] == "null" and rows[3]["f"]["z"] is None and rows[0]["f"] is None
