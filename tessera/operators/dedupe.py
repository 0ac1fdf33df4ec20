"""Duplicates: by keys, by sequence, by similarity."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicate_classes(left: DataFrame, right: DataFrame, key: str, columns: tuple[str, str]) -> DataFrame:
    """(key, kind, first, n) of rows of the left that others equal in the first column, the second, or `both`.

    first is the smallest key of the right that does and n how many do, so a
    class of n rows gives n rows, not its pairs. A row that only itself equals
    goes; empty values match nothing. The right is counted before it is joined.
    """
    found = []
    for kind, by in ((columns[0], [columns[0]]), (columns[1], [columns[1]]), ("both", list(columns))):
        filled = lambda df, by=by: df.where(" and ".join(f"`{c}` <> ''" for c in by))
        classes = filled(right).groupBy(*by).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
        found.append(filled(left).select(key, *by).join(classes, by).where((F.col("n") > 1) | (F.col("first") != F.col(key))).select(key, F.lit(kind).alias("kind"), "first", "n"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def sequential_dedupe(df: DataFrame, position: str, question: str, query: str) -> DataFrame:
    """(position, kept): what a pass in order keeps, when only kept rows register their keys; a null key is like no other. Positions are unique.

    A row is decided once it is the first undecided one of both its question
    and its query: it stays, and undecided rows that share either with it go.
    Rounds carry on the undecided rows alone, until none is left; the first of
    each key are partial aggregates, so a hot key costs a row for each task.
    """
    undecided = df.select(F.col(position).alias("p"), F.col(question).alias("q"), F.col(query).alias("s")).checkpoint()
    out = undecided.select("p", F.lit(False).alias("kept")).where(F.lit(False))
    everything = undecided.select("p")
    while not undecided.isEmpty():
        first = lambda c, name: undecided.groupBy(c).agg(F.min("p").alias(name))  # noqa: B023, E731
        is_first = (F.coalesce("fq", "p") == F.col("p")) & (F.coalesce("fs", "p") == F.col("p"))
        stay = undecided.join(first("q", "fq"), "q", "left").join(first("s", "fs"), "s", "left").where(is_first).select("p", "q", "s").checkpoint()
        out = out.unionByName(stay.select("p", F.lit(True).alias("kept")))
        undecided = undecided.join(stay.select("p"), "p", "left_anti").join(stay.select("q"), "q", "left_anti").join(stay.select("s"), "s", "left_anti").checkpoint()
    return everything.join(out, "p", "left").select(F.col("p").alias(position), F.coalesce("kept", F.lit(False)).alias("kept"))


def sequence_ratio(threshold: float):
    """Matching-blocks similarity of two texts, left first (it isn't symmetric); 0 where a cheap upper bound is below the threshold."""

    @F.arrow_udf(T.DoubleType())
    def ratio(left: pa.Array, right: pa.Array) -> pa.Array:
        out, matcher, last = [], difflib.SequenceMatcher(None), None
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            if b != last:  # what a matcher knows of its second text is kept
                matcher.set_seq2(b)
                last = b
            matcher.set_seq1(a)
            out.append(matcher.ratio() if matcher.quick_ratio() >= threshold else 0.0)
        return pa.array(out, pa.float64())

    return ratio


def near_pairs(left: DataFrame, right: DataFrame, key: str, text: str, threshold: float = 0.92) -> DataFrame:
    """(key, other, ratio) of unequal texts at or above the threshold.

    At a ratio of t two texts leave at most (1-t)(la+lb) characters of both
    unmatched, and lb is at most la(2-t)/t. So of one more disjoint pieces of
    the left text than that, one stands unharmed in the right text, moved by
    no more places than that. These pieces are the join key; of the pairs that
    meet those are scored whose edit distance is no more than that either. No
    pair is left out.
    """
    t = threshold
    loose = lambda n: F.floor(F.lit(1 - t + 1e-9) * (n + n * (2 - t) / t)).cast("int")
    a = left.where(F.length(text) > 0).select(F.col(key).alias("a"), F.col(text).alias("t_a"), F.length(text).alias("n_a"))
    a = a.withColumn("d", loose(F.col("n_a"))).withColumn("q", F.floor(F.col("n_a") / (F.col("d") + 1)).cast("int"))
    a = a.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumn("at", F.col("i") * F.col("q") + 1).withColumn("g", F.substring("t_a", F.col("at"), F.col("q")))
    sizes = [r["q"] for r in a.select("q").distinct().collect()]  # a handful: pieces shrink to a fixed length as texts grow
    b = right.where(F.length(text) > 0).select(F.col(key).alias("b"), F.col(text).alias("t_b"), F.length(text).alias("n_b"))
    every = [F.when(F.col("n_b") >= q, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_b") - (q - 1), F.lit(1))), lambda i, q=q: F.struct(i.alias("in"), F.substring(F.col("t_b"), i, F.lit(q)).alias("g")))) for q in sizes if q > 0]
    if not every:
        return left.select(key, F.col(key).alias("other"), F.lit(0.0).alias("ratio")).where(F.lit(False))
    b = b.withColumn("s", F.explode(F.flatten(F.array_compact(F.array(*every))))).select("b", "t_b", "n_b", "s.in", "s.g")
    same = a.join(b, "g").where((F.abs(F.col("at") - F.col("in")) <= F.col("d")) & (F.col("t_a") != F.col("t_b")) & (2 * F.least("n_a", "n_b") >= t * (F.col("n_a") + F.col("n_b"))) & (F.col("a") != F.col("b")))
    most = F.floor(F.lit(1 - t + 1e-9) * (F.col("n_a") + F.col("n_b"))).cast("int")
    same = same.where(F.call_function("levenshtein", "t_a", "t_b", most) >= 0)  # -1 beyond
    pairs = same.select("a", "b", "t_a", "t_b").distinct()
    scored = pairs.withColumn("ratio", sequence_ratio(t)("t_a", "t_b")).where(F.col("ratio") >= t)
    return scored.select(F.col("a").alias(key), F.col("b").alias("other"), F.bround("ratio", 4).alias("ratio"))


def unit(vector):
    """A vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def cosine_matches(queries: DataFrame, df: DataFrame, key: str, vector: str, threshold: float = 0.9, block: int = 20_000) -> DataFrame:
    """(query, other, similarity) of a stated set of queries against all other rows, at or above the threshold.

    Queries go out in blocks of `block`, so what is sent is bounded; each block
    is one pass over the rows, as matrix products over their batches. Vectors
    are of one length; a null one matches nothing.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def scaled(vectors: np.ndarray) -> np.ndarray:
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

    def against(held: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r["k"] for r in held], np.int64), scaled(np.array([r["v"] for r in held], float))))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, left = shared.value
            for batch in batches:
                lists, keys = batch.column(1), batch.column(0).to_numpy()
                if not len(keys):
                    continue
                right = scaled(lists.flatten().to_numpy().reshape(len(keys), -1))
                s = left @ right.T
                x, y = np.nonzero((s >= threshold) & (names[:, None] != keys[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(keys[y]), pa.array(s[x, y])], names=["query", "other", "similarity"])

        return rows.mapInArrow(match, "query long, other long, similarity double")

    held, found = [], None
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block:
            found, held = (against(held) if found is None else found.unionByName(against(held))), []
    if held or found is None:
        found = (against(held) if found is None else found.unionByName(against(held))) if held else spark.createDataFrame([], "query long, other long, similarity double")
    return found


def greedy_groups(links: DataFrame) -> DataFrame:
    """(node, leader) of the nodes of links (a, b): in order, a node that no leader before it is linked to leads those linked to it.

    Rounds settle all nodes whose smaller neighbours are settled; each is two
    aggregates over the links that are still open. At the end a node joins its
    smallest leader. Links are of different nodes, either way round.
    """
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).distinct().checkpoint()
    nodes = pairs.select("node").unionByName(pairs.select(F.col("low").alias("node"))).distinct()
    open_, leaders = nodes.checkpoint(), nodes.where(F.lit(False))
    while not open_.isEmpty():
        held = pairs.join(open_.withColumnRenamed("node", "low"), "low", "left_semi").select("node").distinct()
        leads = open_.join(held, "node", "left_anti").checkpoint()  # no smaller neighbour is open: the settled ones are members
        led = pairs.join(leads.withColumnRenamed("node", "low"), "low", "left_semi").select("node").distinct()
        leaders = leaders.unionByName(leads)
        open_ = open_.join(leads, "node", "left_anti").join(led, "node", "left_anti").checkpoint()
    leaders = leaders.checkpoint()
    members = pairs.join(leaders.withColumnRenamed("node", "low"), "low").groupBy("node").agg(F.min("low").alias("leader"))
    return leaders.select("node", F.col("node").alias("leader")).unionByName(members)
