"""The parity-sketch join against all pairs by brute force."""

import random

import numpy as np
import pytest

from tessera.llm import op6_ngram_jaccard as J
from tessera.llm.components import components


def brute(rows, width=5):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (key, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), key), key)
    return {(key, len(sets[i]), low[root(i)]) for i, (key, _) in enumerate(rows)}


def corpus(seed, groups=25):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(None, 1), ("", 2), (" \t ", 3), ("one", 4), ("ONE", 5), ("a b c d", 6), ("a b c d", 7), ("a b c d e", 8)]
    rows = [(k, t) for t, k in rows]
    boiler = [r.choice(vocabulary) for _ in range(40)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 9, 17, 33, 64, 130, 400]))]
        if r.random() < 0.5:
            base = boiler + base
        for _ in range(r.randint(1, 6)):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(words).replace("w1 ", "W1\n ")))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {tuple(x) for x in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_no_linked_pair_without_a_common_key():
    r, none = np.random.default_rng(5), np.empty(0, np.uint64)
    for trial in range(1500):
        s = int(r.choice([1, 2, 3, 4, 5, 7, 8, 12, 15, 16, 31, 60, 127, 128, 300]))
        a = np.unique(r.integers(0, 1 << 63, s, dtype=np.uint64))
        out = int(r.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate([a[out:], r.integers(0, 1 << 63, int(r.integers(0, len(a) // 4 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            hot = np.sort(a[:: 1 + trial % 3]) if trial % 2 else none
            assert np.intersect1d(J.segment_keys(a, hot), J.segment_keys(b, hot)).size, (s, out)
            apart = sum(bin(int(x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(J.sketch(a), J.sketch(b)))
            assert apart <= len(a) + len(b) - 2 * both


def test_words_and_sets():
    assert len(J.word_hashes(b" a\tb\x0bc  d\r\n")) == 4
    assert J.shingle_set(" x y").size == 1
    long = "x" * 5000 + " " + "x" * 4999 + "y a b c d e"
    assert len(J.shingle_set(long)) == 3
    assert J.signature(J.shingle_set("a b c d e f")) == J.signature(J.shingle_set("A  b\nc D e F"))


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 103), (103, 101), (50, 50)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 103: 100}


def test_empty_table_and_repeated_rows(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (7, "q r s t u v"), (7, "a b c d e f")]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (1, 1), (7, 1), (7, 7)]


def test_null_and_repeated_keys_keep_their_links(spark):
    text = lambda n, *more: " ".join([f"{n}{i}" for i in range(60)] + list(more))
    rows = [(None, text("a")), (None, text("a", "x")), (None, text("b")), (None, text("a", "x")), (7, text("b", "y")), (7, text("c")), (9, text("c", "z")), (3, None), (None, "")]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 56, None), (None, 57, None), (None, 56, 7), (None, 57, None), (7, 57, 7), (7, 56, 7), (9, 57, 7), (3, 0, 3), (None, 0, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
