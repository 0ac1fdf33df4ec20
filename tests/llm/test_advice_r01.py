"""What the review of round 1 found to be cut short."""

from __future__ import annotations

import itertools
import random
import time

from pyspark.sql import functions as F

from tessera.llm import op4_secret_scan as op4
from tessera.llm import op7_lattice_lm as op7
from tessera.llm import op9_decontamination as op9
from tessera.llm.op6_ngram_jaccard import keep_one


# --- lattice ---------------------------------------------------------------


def test_lattice_default_is_two_rounds(spark):
    rows = [(i, "the cat sat on the mat near another catalogue") for i in range(3)] + [(9, "cats catalogued mats")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda **how: {r["doc_id"]: r["score"] for r in op7.score_documents(docs, F.col("doc_id") == 9, **how).collect()}
    own, two, one = score(), score(rounds=2), score(rounds=1)
    assert all(abs(own[k] - two[k]) < 1e-9 for k in two)
    assert abs(two[9] - one[9]) > 1e-6


# --- decontamination -------------------------------------------------------


def plain_edits(item, region):
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(region):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def copies(r, words, text, kind, rate):
    """A copy with a share `rate` of its words replaced, or of its characters edited."""
    if kind == "word":
        return " ".join(r.choice(words) if r.random() < rate else w for w in text.split())
    if kind == "every second word":
        return " ".join(w[:-1] + "z" if i % 2 else w for i, w in enumerate(text.split()))
    out = list(text)
    fixed = {"substitution": 0.5, "insertion": 0.9, "deletion": 0.1}.get(kind)
    for _ in range(int(rate * len(text))):
        i, what = r.randrange(len(out)), r.random() if fixed is None else fixed
        out[i : i + (what < 0.8)] = [r.choice("bcdfgaeiou")] * (what > 0.2)
    return " ".join("".join(out).split())  # the distance is that of words joined by single spaces


def test_recall_up_to_the_accepted_edits():
    r = random.Random(11)
    words = ["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(2, 8))) for _ in range(600)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(14, 60))) for _ in range(40)]
    bench = op9.Benchmark(list(enumerate(texts)))
    fill = lambda: " ".join(r.choice(words) for _ in range(30))
    kinds = [("every second word", 0), *itertools.product(("word", "character", "substitution", "insertion", "deletion"), (0.05, 0.1, 0.15, 0.2))]
    for kind, rate in kinds:
        held = found = 0
        for k, t in enumerate(texts):
            doc = f"{fill()} {copies(r, words, t, kind, rate)} {fill()}"
            if plain_edits(t, doc) <= 0.2 * len(t):
                held += 1
                found += any(h[0] == k for h in bench.matches(doc))
        assert held and found >= 0.97 * held, (kind, rate, found, held)


def test_query_by_brute_force_both_ways(spark):
    """Every pair that the exact distance accepts is found, and no other."""
    r = random.Random(21)
    words = ["".join(r.choice("bcdfgaeiouéß") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, say(r.randint(8, 24))) for k in range(12)]
    rows = [(100, None), (101, ""), (102, "!?")]
    for n in range(40):
        copy = copies(r, words, r.choice(items)[1], r.choice(("word", "character", "insertion", "deletion")), r.choice((0.0, 0.05, 0.1, 0.3, 0.4)))
        rows.append((n, f"{say(12)} {copy} {say(12)}" if n % 4 else say(40)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in op9.find_items(docs, bench).collect()}
    want = {(d, k): e for d, t in rows if t for k, i in items for e in [plain_edits(i, t)] if e <= 0.2 * len(i)}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 15
    assert all(e == want[k] for k, e in got.items())


def test_spans_are_code_points_of_the_text(spark):
    item = "Größe über alles, sagt der Bär im Wald"
    text = f"🙂🙂 Vorwort. {item.upper().replace('SS', 'ß')} — Ende. " + "wort " * 200_000 + item.replace("Wald", "Walt")
    assert [(k, e, text[s:t]) for k, e, s, t in op9.Benchmark([(5, item)]).matches(text)] == [(5, 1, item.replace("Wald", "Walt"))]


def test_long_texts_are_read_in_stretches(monkeypatch):
    r = random.Random(31)
    words = ["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, say(r.randint(10, 40))) for k in range(30)]
    text = " ".join(say(r.randint(5, 60)) + " " + copies(r, words, t, "character", 0.1) for _ in range(4) for _, t in items)
    whole = op9.Benchmark(items).matches(text)
    assert {k for k, *_ in whole} == set(range(30))
    for size in (1, 1500, 5000):
        monkeypatch.setattr(op9, "STRETCH", size)
        assert [(k, e) for k, e, _, _ in op9.Benchmark(items).matches(text)] == [(k, e) for k, e, _, _ in whole]


def test_least_edits_by_brute_force():
    r = random.Random(12)
    for _ in range(200):
        item, region = (bytes(r.choice(b"ab ") for _ in range(n)) for n in (r.randint(1, 80), r.randint(0, 100)))
        assert op9.least_edits(item, region) == plain_edits(item, region)


def test_items_of_few_words_are_searched():
    chinese, thai = "机器学习模型在训练时不应该看到测试集里的题目。", "แบบจำลองภาษาไม่ควรเห็นข้อสอบก่อน"
    bench = op9.Benchmark([(1, chinese), (2, thai), (3, "Too short"), (4, "题目"), (5, "!?"), (6, "")])
    found = lambda text: [(k, e, text[a:b]) for k, e, a, b in bench.matches(text)]
    assert found(f"前文如下{chinese}后文") == [(1, 0, chinese), (4, 0, "题目")]
    assert found(f"x {thai}ครับ") == [(2, 0, thai)]
    assert [h[0] for h in found("前文" + chinese.replace("测试", "考试").replace("题目", "问题") + "后文")] == [1]
    assert found("it is too  SHORT, yes") == [(3, 0, "too  SHORT")]
    assert found("tattoo shorts !?") == [] and found("机器") == []


# --- secrets ---------------------------------------------------------------


def test_lexer_reads_any_length():
    key = "aB3+/x9Zq7Lm2" * 700
    for text in (f'private_key = "{key}"', f"credentials: '{key}'", f"signing_key = {key}", f"access_key{' ' * 40}={' ' * 40}{key}", f'"connection_string" :\n{" " * 30}"{key}"', f'passphrase = "aB3x9Zq7"{" " * 20}+ "{key}"', f"{'long_' * 40}private_key = {key}"):
        spans = [text[s:e] for s, e, k in op4.scan(text) if k == "literal"]
        assert spans and spans[-1] == key, text[:40]
    assert [n for n, _, _ in op4.assignments("1abc = x; \"q\" : y; \"bad : z; o' = w; a.b-c := v")] == ["abc", "q", "bad", "a.b-c"]
    began = time.monotonic()
    op4.scan('a = "' * 100_000 + " " * 1_000_000 + "\\" * 1_000_001 + "=" * 100_000 + "x" * 1_000_000)
    assert time.monotonic() - began < 20


# --- near duplicates -------------------------------------------------------


def test_keep_one_loses_no_document_without_partner(spark):
    text = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " more"), (None, text("c")), (None, text("d")), (None, text("a")), (None, text("d")), (3, text("e")), (3, text("e")), (4, None), (None, None), (None, ""), (5, " \n")]
    kept = keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (3, text("e")), (4, None), (None, None), (None, ""), (5, " \n")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))
