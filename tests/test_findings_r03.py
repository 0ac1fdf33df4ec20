"""What the third round's findings asked for, on small tables."""

import json
import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import nested
from tessera.plans.catalogue import ORACLE_SQL, QUERIES


def equals_sql(spark, name, folder, tables):
    duck = duckdb.connect()
    for t in tables:
        duck.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    theirs = duck.sql(ORACLE_SQL[name])
    ours = QUERIES[name](spark, str(folder)).select(*theirs.columns)
    return Counter(map(tuple, ours.collect())) == Counter(theirs.fetchall())


def test_f5_numbers_of_more_than_four_digits(spark, tmp_path):
    df = spark.range(9_990, 10_200, 7).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")).unionByName(spark.createDataFrame([(123_456_789, "fr"), (3, None)], "doc_id long, lang string"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert equals_sql(spark, "schema_ids", tmp_path, ["documents"])


def test_f3_the_scanner_reads_like_the_stack():
    r = random.Random(5)
    paths, dropped = [("a",), ("a", "b"), ("é", "a"), ("c\n",), ()], frozenset(["b"])
    short, read = nested.shortener(60, 3, dropped), nested.fields_reader(paths)

    def value(depth):
        kind = r.randrange(8 if depth else 6)
        if kind < 6:
            return [" a b ", "x" * 80, "é\ud800", -1.5, 12345678901234567890, None][kind]
        return [value(depth - 1) for _ in range(r.randrange(6))] if kind == 6 else {r.choice(["a", "b", "é", "c\n"]): value(depth - 1) for _ in range(r.randrange(5))}

    def tried(f, *args):
        try:
            return f(*args)
        except ValueError:
            return "no JSON"

    for _ in range(3000):
        text = json.dumps(value(5), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice(['"', "]", "}", ",", ":", "1", " ", "\\", "[", "", "-0", "1.50", "1E5", '"a":1,', "NaN", "\x01", " "]) + text[at + r.randrange(2) :]
        assert tried(short, text) == tried(nested.shortened, text, 60, 3, dropped)
        assert tried(read, text) == tried(nested.fields_of, text, paths)


def test_f3_what_no_path_leads_to_costs_little():
    text = '{"pad": [%s], "a": {"b": 1}}' % ", ".join('{"x": [1, "y"]}' for _ in range(20_000))

    def least(f, *args):
        times = []
        for _ in range(3):
            begun = time.perf_counter()
            assert f(*args) == [("number", "1")]
            times.append(time.perf_counter() - begun)
        return min(times)

    assert least(nested.fields_reader([("a", "b")]), text) * 4 < least(nested.fields_of, text, [("a", "b")])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_f4_lines_equal_a_plain_walk(spark, seed):
    from tessera.operators import reports

    r = random.Random(seed)
    rows = [(r.randrange(7), i, f"p{i % 11}", r.choice([None, None, None, *range(9)])) for i in range(26)]
    r.shuffle(rows)

    def walk(template, seen):
        for _, order, name, target in sorted((x for x in rows if x[0] == template), key=lambda x: x[1]):
            yield "  " * (len(seen) - 1) + f"- {name}"
            if target is not None and target not in seen:
                yield from walk(target, [*seen, target])

    want = {(t, n, line) for t in {x[0] for x in rows} for n, line in enumerate(walk(t, [t]), 1)}
    df = spark.createDataFrame(rows, "template long, o long, property string, target long")
    got = reports.class_lines(df, "o").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert reports.class_lines(df.where("false"), "o").count() == 0


def test_f2_copies_of_names_are_scored_once(spark, tmp_path):
    import difflib

    r = random.Random(4)
    draw = lambda: " ".join(r.choice(["large", "hot", "blue", "grey", "old"]) for _ in range(2))
    rows = [(i, draw(), f"Brand#{r.randrange(4)}", r.choice(["SMALL", "LARGE"])) for i in range(700)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    names = {i: " ".join(x) for i, *x in rows}
    of = {}
    for i, n in names.items():
        of.setdefault(n, []).append(i)
    want = set()
    for i in range(0, 700, 100):
        for n, ids in of.items():
            ratio = difflib.SequenceMatcher(None, names[i], n).ratio()
            if n != names[i] and ratio >= 0.92:
                want.add((i, ids[0], len(ids), round(ratio, 4)))
    got = QUERIES["near_duplicate_names"](spark, str(tmp_path)).select("id", "other", "n", "ratio").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and len(want) > 20


def test_f1_equal_texts_are_scored_once(spark):
    from tessera.operators.metrics import metric_long

    execution = "struct<status:string,result_type:string,boolean:boolean,bindings:array<map<string,struct<type:string,value:string,datatype:string,lang:string>>>>"
    q = "SELECT ?x WHERE { ?x orkgp:P1 ?y . }"
    rows = [(i, [q, q.replace("P1", "P2"), None][i % 3], q, None, None, True, [["orkgp:P1"], None][i % 2], False) for i in range(60)]
    df = spark.createDataFrame(rows, f"item_id long, pred_query string, gold_query string, pred {execution}, gold {execution}, evaluated boolean, allowed array<string>, placeholder_mode boolean")
    sizes = []

    def keep(kept):
        kept = kept.checkpoint()
        sizes.append(kept.count())
        return kept

    got = {(r["item_id"], r["metric"]): r for r in metric_long(df, keep=keep).collect()}
    assert sizes.count(3) == 2 and len(got) == 60 * 26
    assert [got[i, "uri_hallucination"]["value"] for i in range(6)] == [0.0, None, None, None, 1.0, None]
    assert [got[i, "kg_ref_match"]["value"] for i in range(3)] == [1.0, 0.0, None]


def test_f6_all_urls_are_learned_from(spark):
    from tessera.llm import op5_url_filter as op5

    r = random.Random(6)
    urls = [(f"http://{''.join(r.choice('abcdef') for _ in range(4))}{i}.{r.choice(('com', 'net'))}/{r.choice(('es', 'fr'))}/x", i) for i in range(25_000)]
    by = {"allow": [u for u, _ in urls if ".com/" in u], "block": [u for u, _ in urls if ".net/" in u]}
    rows = [(u, v) for v, own in by.items() for u in [*own, own[0]]]
    want = op5.fit(by["allow"], by["block"])
    got = op5.fit_all(spark.createDataFrame(rows, "_url string, _verdict string").repartition(7))
    assert got.accepted.counts == want.accepted.counts and got.rejected.counts == want.rejected.counts
    assert abs(got.threshold - want.threshold) < 1e-4 and not hasattr(op5, "SAMPLE")


def test_f7_links_of_all_pairs_are_counted_not_written(spark, monkeypatch):
    import numpy as np

    from tessera.operators import vectors

    monkeypatch.setattr(vectors, "LARGE_TILE", 64)
    monkeypatch.setattr(vectors, "LEADERS", 16)
    monkeypatch.setattr(vectors, "similar_nodes", lambda *_: pytest.fail("links were asked for"))
    g = np.random.default_rng(3)
    v = np.repeat(g.normal(size=(20, 8)), 15, 0) + 0.3 * g.normal(size=(300, 8))
    v[200:210] = v[7]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.7 - 1e-12
    leaders, want = [], {}
    for i in range(300):
        own = [j for j in leaders if linked[i, j]]
        if not own:
            leaders.append(i)
        want[i] = (own[0] if own else i, int(linked[i].sum()) - 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(5)
    got = {r["id"]: (r["leader"], r["n_links"]) for r in vectors.similar_groups(df, "id", "v", 0.7, None).collect()}
    assert got == want and len(leaders) > 16


def test_f11_recall_of_bands_equals_what_the_bands_find_and_shuffles_no_vectors(spark):
    from tessera.operators import dedupe, vectors

    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) + 0.6 for _ in range(6)] if i % 11 else None) for i in range(400)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    banded = {(x["a"], x["b"]) for x in vectors.similar_nodes(vectors.distinct_vectors(e, "vec_id", "embedding")[0], 0.4, 0.7, 6).collect()}
    want = {}
    for x in dedupe.cosine_matches(e.where("vec_id % 10 = 0"), e, "vec_id", "embedding", 0.4).collect():
        links, found = want.get(x["query"], (0, 0))
        want[x["query"]] = links + 1, found + ((min(x["query"], x["other"]), max(x["query"], x["other"])) in banded)
    got = vectors.banded_recall(e.where("vec_id % 10 = 0"), e, "vec_id", "embedding", 0.4, 0.7, 6)
    assert {x["query"]: (x["links"], x["found"]) for x in got.collect()} == want
    assert 0 < sum(f for _, f in want.values()) < sum(n for n, _ in want.values())
    again = vectors.banded_recall(e.where("vec_id = 10"), e.where("vec_id = 10").withColumn("vec_id", F.lit(999)), "vec_id", "embedding", 0.4)
    assert list(map(tuple, again.collect())) == [(10, 1, 1)]  # a copy is found


def test_f14_streams_are_drained_to_a_folder_and_not_to_the_driver(spark, tmp_path, monkeypatch):
    from tessera.plans import parsed

    spark.range(50).selectExpr("id as event_id", "id % 7 as user_id", "timestamp_seconds(id * 7200) as ts").write.parquet(f"{tmp_path}/events.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    assert equals_sql(spark, "stream_sessions", tmp_path, ["events"])
    assert {t.name for t in spark.catalog.listTables()} == before  # the memory sink leaves a table on the driver
    empty = spark.range(0).selectExpr("timestamp_seconds(id) as ts", "id as user_id")
    tables = lambda name: empty
    tables.spark = spark
    assert parsed.drained(parsed.streamed(tables, "events", ["user_id"]).groupBy("user_id").count(), "complete", spark).count() == 0


def test_op7_plain_products_equal_sums_of_logs_and_batches_are_put_together(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tessera.llm import op7_lattice_lm as op7

    r = random.Random(12)
    model = op7.Lattice.from_scores(*op7.load_vocabulary(op7.default_vocabulary()))
    words = ["".join(r.choice("abcdéß漢😀") for _ in range(r.randrange(1, 16))).encode() for _ in range(400)] + [b"\xf4\x8f\xbf\xbf" * 12, b"q" * 48, b"z" * 90, b""]
    counts = np.array([r.randrange(1, 90) for _ in words], float)
    scores, uses = model.log_probabilities(words), model.expected(words, counts)
    monkeypatch.setattr(op7, "SMALLEST", 2.0)  # all take the way by logs
    assert np.allclose(scores, model.log_probabilities(words), rtol=1e-12) and np.allclose(uses, model.expected(words, counts), rtol=1e-9)
    batches = [pa.RecordBatch.from_pydict({"word": words[i : i + 7]}) for i in range(0, len(words), 7)]
    monkeypatch.setattr(op7, "GATHERED", 100)
    sizes = [len(x) for x in op7._gathered(iter(batches))]
    assert sum(sizes) == len(words) and len(sizes) == 4


def test_op9_walks_and_look_up_equal_plain_ones_and_convert_no_places():
    import numpy as np

    from tessera.llm import op9_decontamination as op9

    r = random.Random(21)
    codes = np.array([r.randrange(97, 123) for _ in range(300)], np.uint32)
    out, far = op9.walked(codes)
    padded = [*codes.tolist(), *[0] * (op9.STEPS + 1)]
    for i in range(len(codes)):
        at, word = i, 0
        for j in range(op9.PERIOD):
            word |= (padded[at] & 255) << 8 * j
            at += int(op9.COINS[j][padded[at] & 255])
        assert (int(out[i]), int(far[i])) == (word, at - i)
    assert far.dtype == np.intp
    bench = op9.Benchmark([(k, "".join(r.choice("abcdef ") for _ in range(400))) for k in range(30)])
    joined = np.concatenate([bench.items[3][2], codes, bench.items[7][2]])
    walks, places = op9.walked(joined), [np.arange(len(joined)) for _ in range(op9.REPEATS)]
    known = {int(c): i for i, c in enumerate(bench.codes)}
    plain = sorted((int(p), known[int(v)]) for w, start in enumerate(places) for p, v in zip(start, op9.sampled(walks, start, w)[0], strict=True) if int(v) in known)
    assert sorted(zip(*(x.tolist() for x in bench._hits(walks, places)), strict=True)) == plain and plain


def test_f16_a_closure_broadcasts_nothing(spark):
    from tessera.plans import sparql

    compiler = sparql.Compiler(spark.createDataFrame([("a", "p", "b")], "s string, p string, o string"))
    edges = spark.range(1, 40).selectExpr("cast(id as string) s", "cast(id div 3 as string) o").checkpoint()
    plans, checkpoint = [], type(edges).checkpoint

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df, *args)

    try:
        type(edges).checkpoint = noted
        got = compiler._closed(edges, edges)
    finally:
        type(edges).checkpoint = checkpoint
    want = {(str(i), str(i // 3**k)) for i in range(1, 40) for k in range(1, 5) if i // 3 ** (k - 1)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_op9_texts_are_sampled_together_and_each_gives_what_it_gives_alone(monkeypatch):
    from tessera.llm import op9_decontamination as op9

    r = random.Random(33)
    words = ["".join(r.choice("bcdfgaeiouéß") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [*enumerate([say(r.randint(12, 30)) for _ in range(20)]), (20, "机器学习模型在训练时不应该看到测试集里的题目。"), (21, "Too short")]
    bench = op9.Benchmark(items)
    texts = [None, "", "!?", "x", "it is too  SHORT, yes", f"前文{items[20][1]}后文", say(9000) + " " + items[2][1]]
    for k, item in items[:20]:
        copy = "".join(c if r.random() > 0.1 else r.choice("xyz") for c in item)
        texts += [item, copy, f"{say(40)} {copy}! {say(40)}", item[: len(item) // 2], item[len(item) // 2 :], say(30)]
    alone = [bench.matches(t) for t in texts]
    assert {hit[0] for found in alone for hit in found} == {*range(22)}
    # Two halves in neighbouring texts are no copy, nor do the texts around one change what it gives.
    order = r.sample(range(len(texts)), len(texts))
    for size, cells in ((op9.GATHERED, op9.CELLS), (300, op9.CELLS), (op9.GATHERED, 3 * len(items))):
        monkeypatch.setattr(op9, "GATHERED", size)
        monkeypatch.setattr(op9, "CELLS", cells)
        assert bench.all_matches(texts) == alone
        assert bench.all_matches([texts[i] for i in order]) == [alone[i] for i in order]
    calls, walked = [], op9.walked
    monkeypatch.undo()
    monkeypatch.setattr(op9, "walked", lambda codes: calls.append(len(codes)) or walked(codes))
    assert bench.all_matches(texts) == alone and len(calls) <= 2  # one for each text before
