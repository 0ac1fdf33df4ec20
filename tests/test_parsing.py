"""Parsing of what models write."""

import json

import pytest

from tessera.functions import parsing


@pytest.mark.parametrize(
    "text, found",
    [
        ('x {"a": "}{", "b": [1, {"c": 2}]} y {"z": 1}', {"a": "}{", "b": [1, {"c": 2}]}),
        ('{bad} then {"a": 1}', {"a": 1}),
        ('cut {"a": [1, 2, {"b": "te', {"a": [1, 2, {"b": "te"}]}),
        ('{"q": "say \\"}\\""}', {"q": 'say "}"'}),
        ("none", None),
        ("", None),
        (None, None),
    ],
)
def test_first_json(text, found):
    got = parsing.first_json(text)
    assert (json.loads(got) if got else None) == found


def test_columns(spark):
    good = json.dumps({f"{s}_score": 1 for s in parsing.SCORES} | {"verdict": "Partially correct", "main_issue": "x"})
    rows = [(1, f"Sure:\n{good}"), (2, good.replace('"schema_score": 1', '"schema_score": 3')), (3, "no"), (4, good.replace("Partially correct", "odd"))]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = {r["id"]: r["j"] for r in df.withColumn("j", parsing.judgement(df.raw)).collect()}
    assert (got[1]["overall_score"], got[1]["verdict"], got[1]["reason"]) == (5, "partially_correct", None)
    assert [got[i]["reason"] for i in (2, 3, 4)] == ["bad_schema_score", "no_json", "bad_verdict"]
    texts = [(1, '{"final_answer": "a"}'), (2, "so \\boxed{b}"), (3, "The answer is: c\n"), (4, "x\n d \n\n"), (5, "")]
    df = spark.createDataFrame(texts, "id int, t string")
    assert [r["a"] for r in df.orderBy("id").select(parsing.final_answer(df.t).alias("a")).collect()] == ["a", "b", "c", "d", None]
    df = spark.createDataFrame([("SELECT ?x WHERE { ?x a ?y",), ("ASK { }",)], "q string")
    assert [r["t"] for r in df.select(parsing.looks_truncated(df.q).alias("t")).collect()] == [True, False]
    df = spark.createDataFrame([("HTTP Error 503:  at 12 ms",)], "e string")
    assert tuple(df.select(parsing.http_status(df.e), parsing.error_signature(df.e)).first()) == (503, "HTTP Error #: at # ms")
