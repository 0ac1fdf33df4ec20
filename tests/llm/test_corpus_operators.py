"""Operators over whole corpora against brute force, and the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op7_lattice_lm as op7
from tessera.llm import op9_decontamination as op9
from tessera.llm import op10_packing as op10

SF = "/root/testdata/sf0.001"


# --- lattice ---------------------------------------------------------------


def test_lattice_sums_all_cuts():
    pieces = ["▁a", "▁", "a", "b", "ab", "▁ab", "ba", "<0xC3>", "<0xA9>", "</s>"]
    log_p = [math.log(x) for x in (0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.1)]
    model = op7.Lattice(pieces, log_p, "</s>")
    p = dict(zip(pieces, log_p))
    for word in ("a", "ab", "abab", "bba", "aé"):
        s, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(s) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            parts = [s[i:j] for i, j in itertools.pairwise(edges)]
            spelled = [p[x] if x in p else (p["<0xC3>"] + p["<0xA9>"] if x == "é" else -math.inf) for x in parts]
            total += math.exp(sum(spelled))
        assert abs(model.log_probability(word) - math.log(total)) < 1e-9, word
    into = {}
    model.expect("abab", 2.0, into)
    assert abs(sum(len(k) * v for k, v in into.items()) - 2 * 5) < 1e-6  # expected pieces cover the word
    long = "ab" * 20_000
    assert -1e7 < model.log_probability(long) < -1


def test_many_words_are_read_as_one_is():
    r = random.Random(3)
    pieces = ["▁a", "▁", "a", "b", "ab", "▁ab", "ba", "bab", "<0xC3>", "<0xA9>", "</s>"]
    model = op7.Lattice(pieces, [math.log((i + 1) / 66) for i in range(11)], "</s>")
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 60))).encode() for _ in range(300)]
    counts = np.array([r.randint(1, 9) for _ in words], float)
    assert np.allclose(model.log_probabilities(words), [model.log_probability(w.decode()) for w in words], rtol=0, atol=1e-9)
    into = {}
    for w, c in zip(words, counts.tolist()):
        model.expect(w.decode(), c, into)
    assert np.allclose(model.expected(words, counts), [into.get(p, 0.0) for p in pieces], rtol=1e-9)
    assert model.log_probabilities([]).tolist() == [] and model.log_probabilities([b""]).tolist() == [0.0]


def all_cuts(word, pieces):
    """(pieces of the cut) of every cut; letters without a piece are spelled in bytes."""
    s = "▁" + word

    def edges(i, j):
        if s[i:j] in pieces:
            return (s[i:j],)
        return tuple(f"<0x{x:02X}>" for x in s[i].encode()) if j == i + 1 else None

    for cuts in itertools.product((0, 1), repeat=len(s) - 1):
        ends = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
        parts = [edges(i, j) for i, j in itertools.pairwise(ends)]
        if None not in parts:
            yield tuple(x for part in parts for x in part)


def test_score_is_the_sum_over_all_cuts(spark):
    rows = [(1, "The cat sat"), (2, "the Cats at"), (3, "at the é cat"), (4, None), (5, "thé hat"), (6, "")]
    held = {5, 6}
    pieces, scores, end = op7.load_vocabulary(op7.default_vocabulary())
    p = {k: math.exp(v) for k, v in op7.Lattice.from_scores(pieces, scores, end).log_p.items()}
    train = Counter(w.decode() for k, t in rows if k not in held for w in op7.words_of(t))
    cuts = {w: list(all_cuts(w, p)) for w in {w.decode() for _, t in rows for w in op7.words_of(t)}}
    weigh = lambda cut: math.prod(p[x] for x in cut)
    told = dict(p)
    for _ in range(op7.ROUNDS):
        uses = dict.fromkeys(pieces, op7.ADDED)
        uses[end] += len(rows) - len(held)
        for w, c in train.items():
            whole = sum(map(weigh, cuts[w]))
            for cut in cuts[w]:
                for x in cut:
                    uses[x] += c * weigh(cut) / whole
        counted = sum(uses.values())
        uses = {k: u + op7.PRIOR * counted * told[k] for k, u in uses.items()}
        total = sum(uses.values())
        p = {k: u / total for k, u in uses.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in op7.score_documents(docs, F.col("doc_id").isin(*held)).collect()}
    for k, t in rows:
        want = math.log10(p[end]) + sum(math.log10(sum(map(weigh, cuts[w.decode()]))) for w in op7.words_of(t))
        assert abs(got[k] - want) < 1e-9, k


def test_the_scores_of_the_file_keep_their_weight(spark, monkeypatch):
    """With the file's scores dealt out anew, held-out texts score otherwise, however often the training text is repeated."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    mean = lambda df: df.where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    load, again = op7.load_vocabulary, docs.where(~held).crossJoin(spark.range(4)).select("doc_id", "text").unionByName(docs.where(held))
    own = [mean(op7.score_documents(d, held)) for d in (docs, again)]

    def dealt(path):
        pieces, scores, end = load(path)
        return pieces, random.Random(1).sample(scores, len(scores)), end

    monkeypatch.setattr(op7, "load_vocabulary", dealt)
    other = [mean(op7.score_documents(d, held)) for d in (docs, again)]
    assert all(a - b > 0.02 for a, b in zip(own, other, strict=True)), (own, other)


@pytest.mark.parametrize("block_bytes", [op7.BLOCK_BYTES, 2000])
def test_scores_by_brute_force(spark, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    score = lambda df, **how: {r["doc_id"]: r for r in op7.score_documents(df, held, rounds=1, **how).collect()}
    rows, other = score(docs, block_bytes=block_bytes), score(docs.repartition(7))
    texts = {r["doc_id"]: op7.words_of(r["text"]) for r in docs.collect()}
    train = [w for k, w in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    counts = Counter(w for words in train for w in words)
    n, v, ends = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    for k, words in texts.items():
        c = [*[counts[w] for w in words], ends]
        r = rows[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(c), sum(x > 0 for x in c), n, zlib.crc32(str(k).encode()) % 7 == 2)
        assert abs(r["base_score"] - sum(math.log10((x + 1) / (n + v + 1)) for x in c)) < 1e-6 * len(c)
        assert math.isfinite(r["score"]) and r["score"] < 0
        assert abs(r["score"] - other[k]["score"]) < 1e-8 * len(c)  # however the rows are dealt into blocks


def test_score_edge_cases(spark):
    rows = [(1, "The the"), (1, "The the"), (2, None), (3, ""), (None, "x"), (4, "y" * 50_000)]
    got = op7.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 3, rounds=1).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == [(-1, 2), (1, 3), (1, 3), (2, 1), (3, 1), (4, 2)]
    assert op7.score_documents(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).count() == 0
    blank = op7.score_documents(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"), F.lit(True)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in blank] == [(1, 0, 0, 0.0)] * 2


# --- decontamination -------------------------------------------------------


def plain_edit(item, region):
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(region):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def test_best_place_by_brute_force():
    r = random.Random(8)
    for _ in range(150):
        item, region = (np.array([r.choice(b"ab ") for _ in range(n)], np.uint32) for n in (r.randint(1, 12), r.randint(1, 30)))
        edits, a, b = op9.best_place(item, region)
        assert edits == plain_edit(item, region) and 0 <= a <= b <= len(region)
        assert plain_edit(item, region[a:b]) == edits


def items(r, n=40):
    words = ["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(2, 8))) for _ in range(600)]
    return words, [" ".join(r.choice(words) for _ in range(r.randint(14, 60))) for _ in range(n)]


def test_recall_of_edited_copies():
    r = random.Random(9)
    words, texts = items(r)
    bench = op9.Benchmark(list(enumerate(texts)))
    for rate, least in ((0.0, 1.0), (0.05, 0.97), (0.1, 0.9)):
        found = 0
        for k, t in enumerate(texts):
            copy = [r.choice(words) if r.random() < rate else w for w in t.split()]
            doc = " ".join(r.choice(words) for _ in range(80)) + ". " + ", ".join(copy).upper() + " " + " ".join(r.choice(words) for _ in range(80))
            found += any(h[0] == k for h in bench.matches(doc))
        assert found >= least * len(texts), rate
    assert not any(bench.matches(" ".join(r.choice(words) for _ in range(400))) for _ in range(50))


def test_matches_and_edge_cases(spark):
    docs = spark.createDataFrame([(1, "x. Alpha beta, GAMMA delta epsilon zeta! y"), (2, None), (3, ""), (4, "nothing at all"), (1, "é alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta"), (8, "too short"), (9, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in op9.find_items(docs, bench).collect())
    assert got == [(1, 7, 0, 2, 37), (1, 7, 0, 3, 39)]
    assert op9.find_items(docs, bench.where("false")).count() == 0
    kept = op9.Benchmark([(1, "a b c d e f")]).matches("a b c d e f")
    assert kept == [(1, 0, 0, 11)]


def test_contaminated_documents_of_the_tables(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in op9.query(spark, SF).collect()}
    assert {(d, i) for d, t in docs.items() for i, b in bench.items() if b in t} <= found


# --- packing ---------------------------------------------------------------


def test_ids_are_the_tokenizer_librarys(spark):
    from tokenizers import Tokenizer

    path = op10.default_tokenizer()
    with open(path, encoding="utf-8") as f:
        encoder = op10.Encoder(f.read())
    theirs = Tokenizer.from_file(path)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "  ", "a   b  c\n  d \n e", "x  ", "\x1c! !\x1c a", "it's  'tis 's", "a  b 　c", "a \n\n  b   \t c", " lead", "<|endoftext|> x", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a<|endoftext|>  b <|endoftext|", " <|endoftext|>\n", "🙂 é́", "​   q"]
    r = random.Random(1)
    texts += ["".join(r.choice([" ", "  ", "\n", "\t", "a", "B1", "'s", "!", "é", "\x85", "\x1d", "<|endoftext|>", "<|"]) for _ in range(30)) for _ in range(2000)]
    for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == e.ids, repr(t)


def test_bounds_and_best_fit():
    r = np.random.default_rng(4)
    for _ in range(200):
        c = int(r.integers(5, 30))
        lengths = r.integers(1, c + 1, int(r.integers(1, 9)))
        bins, offsets, fill = op10.best_fit(lengths, c)
        for b in range(len(fill)):
            at = np.flatnonzero(bins == b)
            at = at[np.argsort(offsets[at])]
            assert offsets[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist() and lengths[at].sum() == fill[b] <= c
        best = len(lengths)
        for split in itertools.product(range(len(lengths)), repeat=min(len(lengths), 5)) if len(lengths) <= 5 else ():
            loads = np.bincount(split, lengths[: len(split)])
            if (loads <= c).all():
                best = min(best, int((loads > 0).sum()))
        assert op10.lower_bound(lengths, c) <= (best if len(lengths) <= 5 else len(fill)) <= len(fill)


def test_packing_round_trip(spark):
    rows = [(1, "a b c " * 900), (2, None), (2, None), (3, ""), (None, "q"), (5, "word " * 5000), (1, "a b c " * 900)] + [(10 + i, "tok " * (i * 37 % 900)) for i in range(120)]
    pieces = op10.tokenize(spark.createDataFrame(rows, "doc_id long, text string"))
    packed = op10.pack_pieces(pieces, part_rows=40).collect()
    assert len(packed) == pieces.count()
    by = {}
    for p in packed:
        assert 1 <= p["length"] <= 1024 and len(p["ids"]) == 4 * p["length"]
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    whole = {}
    for p in packed:
        whole.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["piece"]))
    assert all(n == 1024 for _, n, i in whole[5] if i > 0) and [s for s, _, _ in sorted(whole[5])] == list(itertools.accumulate([0, *[n for _, n, _ in sorted(whole[5])][:-1]]))
    total = sum(p["length"] for p in packed)
    assert len(by) <= 1.06 * total / 1024 + 1
    assert op10.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("text is not null").first()
    extra = spark.createDataFrame([(900001, None, None, None, None), (900002, "123 456", "en", "s", 7), (900003, first["text"], "en", "s", None)], docs.schema)
    docs = docs.unionByName(extra)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == names
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        sizes.append(len(ids))
        if name == "language_id":
            assert not ids & {900001, 900002} and len(ids) > 0.95 * (len(texts) - 2)
        elif name == "ngram_jaccard":
            assert 900003 not in ids and first["doc_id"] in ids
        elif name == "decontamination":
            assert not any(b in texts[i] for i in ids for b in bench)
        else:
            assert sizes[-1] == sizes[-2]
            assert not any("@mail" in r["text"] for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("doc_id is null").count() == 0
