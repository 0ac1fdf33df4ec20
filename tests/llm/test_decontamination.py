"""Recall of the counted CGK samples alone, and how the walks behave."""

import random

import numpy as np
import pytest

from tessera.llm import op9_decontamination as op9


def corpus(r, n):
    words = ["".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(2, 9))) for _ in range(900)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    return say, [say(r.randint(15, 50)) for _ in range(n)]


def edited(r, text, kind, share):
    out, letters = list(text), "abcdefghijklmnopqrstuvwxyz"
    if kind == "each word":
        at = 0
        for w in text.split(" "):
            i = at + r.randrange(len(w))
            out[i] = r.choice([x for x in letters if x != out[i]])
            at += len(w) + 1
    elif kind == "every sixth":
        out = [r.choice([x for x in letters if x != c]) if i % 6 == 5 else c for i, c in enumerate(out)]
    else:
        for i in sorted(r.sample(range(len(out)), int(share * len(out))), reverse=True):
            if kind == "deletion":
                del out[i]
            else:
                out[i : i + (kind == "substitution")] = [r.choice(letters)]
    return " ".join("".join(out).split())


@pytest.mark.parametrize("kind", ["substitution", "insertion", "deletion", "each word", "every sixth"])
def test_recall_by_kind_of_edit(kind):
    r = random.Random(kind)
    say, texts = corpus(r, 60)
    bench = op9.Benchmark(list(enumerate(texts)))
    for share in (0.05, 0.1, 0.15, 0.2) if kind in ("substitution", "insertion", "deletion") else (0,):
        held = met = found = 0
        for k, t in enumerate(texts):
            copy = edited(r, t, kind, share)
            doc = f"{say(120)} {copy} {say(120)}"
            if op9.least_edits([*map(ord, t)], [*map(ord, doc)]) <= int(0.2 * len(t)):
                held += 1
                met += any(i == k for i, _, _ in bench.candidates(op9.Words(doc).joined))
                found += any(h[0] == k for h in bench.matches(doc))
        assert held > 10 and met >= found >= (0.9 if kind == "every sixth" else 0.95) * held, (share, held, met, found)


def test_other_texts_are_rarely_candidates():
    r = random.Random(4)
    say, texts = corpus(r, 200)
    bench = op9.Benchmark(list(enumerate(texts)))
    docs = [say(1000) for _ in range(40)]
    assert not any(bench.matches(d) for d in docs)
    assert sum(len(bench.candidates(op9.Words(d).joined)) for d in docs) < 10 * len(docs)


def test_walks_by_definition():
    r = random.Random(2)
    text = "".join(r.choice("abcdeé 中") for _ in range(300))
    codes = np.array([*map(ord, text)], np.uint32)
    walks = op9.walked(codes)
    padded = [*(c & 255 for c in codes.tolist()), *[0] * (op9.STEPS + 1)]
    for w in range(op9.REPEATS):
        value, end = op9.sampled(walks, np.arange(300, dtype=np.int32), w)
        seen = {}
        for p in range(300):
            at, out = p, []
            for step in range(op9.STEPS):
                k, j = divmod(step, op9.PERIOD)
                out.append(padded[at] if int(op9.SAMPLES[w][k]) >> 8 * j & 0xFF else None)
                at += int(op9.COINS[j][padded[at]])
            assert at == end[p] + walks[1][end[p]]
            assert seen.setdefault(int(value[p]), tuple(out)) == tuple(out)
        assert len(set(seen.values())) == len(seen) and sum(x is not None for x in next(iter(seen.values()))) in (op9.BITS, op9.BITS + 1)
    assert (op9.COINS.sum(0) == op9.PERIOD // 2).all()


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, edits int, start int, item_id int")
    bench = spark.createDataFrame([(1, "one two three four five six seven", 3)], "item_id long, text string, doc_id int")
    assert op9.find_items(docs, bench).count() == 0
    some = spark.createDataFrame([(4, "say: One two three four five six seven.", 9, 9, 9)], docs.schema)
    assert [tuple(x) for x in op9.find_items(some, bench).collect()] == [(4, 1, 0, 5, 38)]
    assert op9.find_items(some, bench.where("false")).count() == 0
