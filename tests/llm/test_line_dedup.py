"""Line deduplication against a plain loop, with the cases that its docstring defines."""

import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import op12_line_dedup as op12

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, least_docs=2, least_chars=10):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    order = lambda d: (d is None, d or 0)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(order(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or min(holders[key(x)]) == order(doc)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(spark, rows, **args):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, op12.dedup_lines(docs, **args).collect()), key=str)


def test_equals_a_plain_loop(spark):
    r = random.Random(12)
    lines = ["", " ", "short", "Exactly10c", "exactly10C\t", "ÀÉÎ long enough", "àéî long enough", "ÀÉÎ LONG enough", "\x0b A line of words \r", "a line of words", "a line of words", " a line of words"]
    lines += [f"line number {i}" for i in range(30)] + ["x" * 9, "é" * 9, "é" * 10, "İstanbul is a city", "i̇stanbul is a city"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (63, "a line of words\n"), (63, "a line of words\n"), (63, "another text, same id\na line of words"), (None, "a line of words\nonly here, twice\nonly here, twice"), (None, "only here, twice")]
    r.shuffle(rows)
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, least_docs=4, least_chars=3) == plain(rows, 4, 3)


def test_hot_lines_long_texts_and_order(spark):
    hot = "everyone has this line"
    long = "\n".join(f"own line {i}" if i % 2 else hot for i in range(20_001))
    rows = [(i, f"{hot}\nbody of document {i}\n{hot}") for i in range(5, 400)] + [(3, long)]
    found = {d: (n, lost, kept) for d, n, lost, kept in got(spark, rows)}
    assert found[3] == (20_001, 0, long)
    assert found[5] == (3, 2, "body of document 5")


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op12.dedup_lines(none).count() == 0
    clash = spark.createDataFrame([(1, "the very same line"), (2, "the very same line")], "doc_id long, text string")
    for name in ("own", "document", "line", "pos", "lost", "kept", "n_lines", "first", "docs"):
        clash = clash.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, op12.dedup_lines(clash).collect())) == [(1, 1, 0, "the very same line"), (2, 1, 1, "")]


def test_query_has_the_digest(spark, tmp_path):
    spark.createDataFrame([(1, "The same long line\nx"), (2, "the same long line\ny")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op12.query(spark, str(tmp_path)).collect()}
    assert rows[2]["kept_sha256"] == hashlib.sha256(b"y").hexdigest() and rows[1]["n_dropped"] == 0


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = op12.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
