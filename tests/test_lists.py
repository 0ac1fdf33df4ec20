"""The splittable list reader against the json module, with ranges of a few bytes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import io, lists


def value(r, depth):
    kind = r.randrange(8 if depth else 6)
    if kind < 6:
        return [None, True, 'q"\\{[,]}\n\\"', "é}{", -1.5, "x" * r.randrange(60)][kind]
    return [value(r, depth - 1) for _ in range(r.randrange(4))] if kind == 6 else {r.choice(["a", "items", "b}"]): value(r, depth - 1) for _ in range(r.randrange(4))}


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "211", "spark.sql.files.openCostInBytes": "0"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def elements(spark, path, wrappers=io.WRAPPERS):
    found = lists.list_elements(spark, path, wrappers, lambda df: df.checkpoint())
    return [json.loads(r["text"]) for r in found.orderBy("file", "pos").collect()]


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 2)])
def test_equals_the_json_module(spark, tmp_path, small_ranges, seed, indent, monkeypatch):
    monkeypatch.setattr(lists, "BLOCK", 31)
    r = random.Random(seed)
    rows = [value(r, 4) for _ in range(90)]
    for name, whole in (
        ("bare", rows),
        ("wrapped", {"meta": {"entries": [1, 2], "x": [{"a": []}]}, "n": 3, "data": [{"no": 1}], "items": rows, "entries": "no list", 'odd "} name': [7]}),
        ("empty", []),
        ("none", {"other": rows[:3]}),
        ("scalar", "[1, 2]"),
    ):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(whole, indent=indent, ensure_ascii=r.random() < 0.5) + " " * 99)
        expected = {"bare": rows, "wrapped": rows}.get(name, [])
        assert elements(spark, str(path)) == expected, name
    if len(json.dumps(rows)) > 2500:
        assert lists.fragments(spark, str(tmp_path / "bare.json")).select("start").distinct().count() > 10


def test_places_are_of_each_file_and_broken_elements_stay(spark, tmp_path, small_ranges):
    for i in range(3):
        (tmp_path / f"f{i}.json").write_text('[{"id": "a%d"},{"id": broken},\n {"id": "c", "question": "%s"} ]\n' % (i, "long " * 50))
    rows = io.read_long_lists(spark, str(tmp_path), io.ENTRY).select("id", "question", "pos").collect()
    assert sorted((str(r["id"]), r["pos"]) for r in rows) == sorted([("a0", 0), ("a1", 0), ("a2", 0), *[("None", 1)] * 3, *[("c", 2)] * 3])


def test_long_reader_equals_the_whole_file_reader(spark, tmp_path, small_ranges):
    df = spark.range(200).select(F.concat(F.lit("k}"), "id").alias("id"), F.concat(F.lit('say "'), "id", F.lit('"\\')).alias("question"))
    io.write_wrapped(df, f"{tmp_path}/one")
    names = ["id", "question", "pos"]
    a, b = (f(spark, f"{tmp_path}/one", io.ENTRY).select(*names) for f in (io.read_long_lists, io.read_wrapped))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 200
    lists.write_lists(df.repartition(3), f"{tmp_path}/many")
    assert sorted(map(tuple, io.read_long_lists(spark, f"{tmp_path}/many", io.ENTRY).select("id", "question").collect())) == sorted(map(tuple, df.collect()))


def test_a_quote_behind_backslashes(spark):
    for text, inside in ((b'"a\\\\"', False), (b'"a\\"', True), (b'\\"', False), (b'""', False), (b'"\\\\\\"', True)):
        assert lists.structure(text, False)[2] is inside, text
