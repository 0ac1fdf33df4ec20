"""Operators on small tables whose results are known or found by brute force."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import attempts, dedupe, placeholders, rules, split
from tessera.plans import sparql
from tessera.sources import io
from tessera.streaming import replay


def column(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("x")).first()["x"]


def test_precision_recall_f1(spark):
    rows = [(1, ["a", "b", "c"], ["b", "c", "d", "e"]), (2, [], []), (3, [], ["a"]), (4, ["x", "x", "y"], ["x", "y", "y"])]
    df = spark.createDataFrame(rows, "id int, p array<string>, g array<string>")
    got = {r["id"]: tuple(round(v, 4) for v in r["m"]) for r in df.select("id", scores.set_overlap(F.col("p"), F.col("g")).alias("m")).collect()}
    assert got == {1: (0.6667, 0.5, 0.5714), 2: (1, 1, 1), 3: (0, 0, 0), 4: (1, 1, 1)}
    multi = df.where("id = 4").select(scores.multiset_overlap(F.col("p"), F.col("g"))["f1"].alias("f")).first()["f"]
    assert round(multi, 4) == 0.6667


def test_lcs_and_bleu(spark):
    assert scores.lcs(list("abcd"), list("bd")) == 2 and scores.lcs([], ["a"]) == 0
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert scores.lcs(a, b) == table[-1][-1]
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "c"]), (list("abcde"), list("abcde"))], "p array<string>, g array<string>")
    assert [r["b"] for r in df.select(scores.bleu(F.col("p"), F.col("g")).alias("b")).collect()] == [None, 1.0]


@pytest.mark.parametrize("given, spelled", [("1.50", "1.5"), ("-0.0", "0"), ("+007", "7"), ("1e3", "1000"), ("12.5E-2", "0.125"), ("x", "x"), (".5", "0.5"), ("123456789012345678901234567890.10", "123456789012345678901234567890.1")])
def test_decimal_form(spark, given, spelled):
    assert column(spark, scores.decimal_form(F.col("v")), v=given) == spelled


def test_query_text(spark):
    raw = "```sparql\n# c\nPREFIX a: <http://a>\nselect ?x where { ?x orkgp:P1 <http://orkg.org/orkg/class/C2> . FILTER(?y = \"orkgr:R9\") }\n```"
    assert column(spark, text.extract_query(F.col("v")), v=raw).startswith("select ?x")
    assert column(spark, text.references(text.extract_query(F.col("v"))), v=raw) == ["orkgc:C2", "orkgp:P1"]
    assert column(spark, text.query_form(F.col("v")), v=" ask {}") == "ask"
    assert column(spark, text.extract_query(F.col("v")), v="nothing here") is None
    assert column(spark, text.placeholders(F.col("v")), v="pgmr:a {{b}} pgmrc:C [[d]] pgmr:a") == ["[[d]]", "pgmr:a", "pgmrc:C", "{{b}}"]


def test_sequential_dedupe_equals_a_loop(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    r = random.Random(1)
    for size, keys in ((40, 12), (120, 25)):
        rows = [(i, r.randrange(keys), r.randrange(keys)) for i in range(size)]
        q, s, kept = set(), set(), set()
        for i, a, b in rows:
            if a not in q and b not in s:
                q.add(a)
                s.add(b)
                kept.add(i)
        out = dedupe.sequential_dedupe(spark.createDataFrame(rows, "p long, q long, s long"), "p", "q", "s")
        assert {x["p"] for x in out.where("kept").collect()} == kept


def test_near_pairs_equals_all_pairs(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcdef ") for _ in range(n)) for n in (5, 9, 14, 20, 31, 60)]
    rows = []
    for t in base * 4:
        t = list(t)
        for _ in range(r.choice([0, 0, 1, 2])):
            t[r.randrange(len(t))] = r.choice("abcxyz")
        rows.append((len(rows), "".join(t)))
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(i, j) for i, a in rows for j, b in rows if i != j and a != b and ratio(a, b) >= 0.92}
    df = spark.createDataFrame(rows, "id long, t string")
    assert {(x["id"], x["other"]) for x in dedupe.near_pairs(df, df, "id", "t", 0.92).collect()} == want


def test_rules_and_attempts(spark):
    lines = ["# x", "## One", "[a-1] helpful=2 harmful=0 :: keep ?x", "junk", "## Two", "[b-1] helpful=0 harmful=3 :: drop"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, pos int, line string")
    parsed = rules.parse(df, "file", "pos", "line")
    assert [(x["section"], x["id"], x["helpful"]) for x in parsed.orderBy("pos").collect()] == [("One", "a-1", 2), ("Two", "b-1", 0)]
    tagged = rules.apply_tags(parsed, spark.createDataFrame([("a-1", "helpful", 1), ("a-1", "harmful", 2)], "id string, tag string, pos int"))
    assert {(x["id"], x["helpful"], x["harmful"]) for x in tagged.collect()} == {("a-1", 2, 1), ("b-1", 0, 3)}
    log = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 9), (2, 0, 1)], "item int, attempt int, score int")
    best = {x["item"]: x["best_attempt"] for x in attempts.best_attempt(log, "item", "attempt", F.col("score")).collect()}
    assert best == {1: 1, 2: 0}


def test_paraphrases(spark):
    df = spark.createDataFrame([("7", "What?", ["what?", "A b", " a  B ", "C", ""])], "id string, question string, p array<string>")
    got = [(x["entry_id"], x["question"]) for x in split.expand_paraphrases(df, "id", "question", "p").orderBy("entry_id").collect()]
    assert got == [("7", "What?"), ("7__para_01", "A b"), ("7__para_02", "C")]


def test_rewrite_is_whole_and_once(spark):
    q = spark.createDataFrame([(1, "orkgp:P1 orkgp:P12 end"), (2, "nothing"), (3, "")], "id int, t string")
    m = spark.createDataFrame([("orkgp:P1", "pgmr:one", 0), ("orkgp:P1", "pgmr:uno", 1), ("pgmr:uno", "never", 0)], "token string, target string, pos int")
    got = {x["id"]: (x["rewritten"], x["n_tokens"], x["n_mapped"], x["missing"]) for x in placeholders.rewrite(q, "id", "t", r"\b(?:orkgp|pgmr):\w+", m).collect()}
    assert got == {1: ("pgmr:uno orkgp:P12 end", 2, 1, ["orkgp:P12"]), 2: ("nothing", 0, 0, []), 3: ("", 0, 0, [])}


TRIPLES = [("a", "t:knows", "b"), ("b", "t:knows", "c"), ("a", "t:age", "30"), ("b", "t:age", "x"), ("c", "t:age", "5"), ("a", "rdf:type", "t:P"), ("b", "rdf:type", "t:P")]


@pytest.mark.parametrize(
    "query, rows",
    [
        ("SELECT ?x ?y WHERE { ?x t:knows ?y }", {("a", "b"), ("b", "c")}),
        ("SELECT ?x ?z { ?x t:knows ?y . ?y t:knows ?z }", {("a", "c")}),
        ("SELECT ?x { ?x t:age ?a FILTER(?a > 6 && ?a != 7) }", {("a",), ("b",)}),  # a text compares as text
        ("SELECT ?x { ?x t:age ?a FILTER(xsd:integer(?a) > 6) }", {("a",)}),
        ("SELECT ?x ?a { ?x a t:P OPTIONAL { ?x t:age ?a FILTER(?a = 30) } }", {("a", "30"), ("b", None)}),
        ("SELECT ?x { { ?x t:knows ?y } UNION { ?y t:knows ?x } }", {("a",), ("b",), ("c",)}),
        ("SELECT (COUNT(*) AS ?n) (AVG(?a) AS ?m) { ?x t:age ?a }", {(3, 17.5)}),
        ("SELECT ?x { ?x t:age ?a FILTER NOT EXISTS { ?x a t:P } }", {("c",)}),
        ("PREFIX q: <t:> SELECT ?x { VALUES ?x { \"a\" \"zz\" } ?x a t:P . }", {("a",)}),
        ("SELECT ?y { ?x t:knows ?y } ORDER BY DESC(?x) LIMIT 1", {("c",)}),
    ],
)
def test_patterns_over_triples(spark, query, rows):
    triples = spark.createDataFrame(TRIPLES, "s string, p string, o string")
    assert {tuple(x) for x in sparql.run(query, triples).collect()} == rows


def test_patterns_refused(spark):
    triples = spark.createDataFrame(TRIPLES, "s string, p string, o string")
    for bad in ("CONSTRUCT { ?a ?b ?c } WHERE { ?a ?b ?c }", "SELECT * { ?a t:age ?b . ?c t:knows ?d }"):
        with pytest.raises(sparql.Unsupported):
            sparql.run(bad, triples)
    assert sparql.run("ASK { ?x t:age \"5\" }", triples).first()["answer"]


def test_reading_and_writing(spark, tmp_path):
    entries = [{"id": "1", "question": "q", "family": "f"}, {"id": "2", "other": 3}]
    (tmp_path / "list.json").write_text(json.dumps(entries))
    (tmp_path / "wrapped.json").write_text(json.dumps({"meta": 1, "items": entries[:1]}, indent=1))
    assert sorted(r["id"] for r in io.read_entries(spark, str(tmp_path)).collect()) == ["1", "1", "2"]
    assert io.read_entries(spark, str(tmp_path), {"family": "f"}).count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"results": {"bindings": [{"x": {"type": "uri", "value": "u"}}, {}]}}))
    cells = io.bindings_to_cells(io.read_results(spark, str(tmp_path / "r.json")), "file").collect()
    assert [(c["row"], c["variable"], c["value"]) for c in cells] == [(0, "x", "u")]
    out = str(tmp_path / "out")
    io.write_once(spark.range(2), out)
    with pytest.raises(Exception, match="already exists"):
        io.write_once(spark.range(2), out)


def test_rule_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("f", "r1", "helpful"), ("f", "r1", "harmful"), ("f", "r1", "helpful"), ("f", "r2", "")], "family string, rule string, tag string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("family string, rule string, tag string").json(str(tmp_path / "in"))
    done = replay.rule_records(stream).writeStream.outputMode("update").format("memory").queryName("records").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("select * from records").collect()} == {("f", "r1", 2, 1, 3), ("f", "r2", 0, 0, 1)}
