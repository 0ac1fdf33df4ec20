"""N-gram Jaccard self-join by parity sketches.

A document's set is its distinct shingles. Each shingle flips one bit of a
very wide sketch, which is cut into segments; a segment is kept as the XOR of
its shingles' 64-bit hashes. Two sets that differ in d shingles have sketches
of Hamming distance d at most, so at most d segments differ.

Sets are dealt into size bands (powers of two); a set that can reach partners
in the next band is in both. With threshold p/q a set of s shingles differs
from any partner in at most D = (q-p)(s + sq/p)/(q+p) shingles. By the
pigeonhole principle two partners agree in one of any D+1 non-empty segments,
so each set emits its first D+1 in an order common to all: segments made of
widespread shingles alone come last, then by place. (Widespread shingles are
found on a sample; they steer the order only and can't change a result.) A
set with too few non-empty segments goes on to a finer sketch, where any
partner that it could still miss goes too. No key is left out.

Keys that several different sets share are candidates. The Hamming distance
of a small parity sketch discards pairs whose sets differ too much, the rest
are verified on the shingles. First every set of a key is held against the
key's hub, the set that shares the most keys; then, in keys whose sets are not
yet all in one component, sets of different components are held against each
other. Pairs inside one
component are never needed. Copies of one set are one node, named by a 64-bit
hash of the set, throughout.

Defined results: null and empty texts, and texts without words, have an empty
set and link with nothing; fewer words than `width` are one shingle. Rows are
documents: repeated rows give repeated results, and rows with equal keys but
different texts link only by their texts. A set whose rows all have a null key
links as any other (null counts as the largest key, and as component only where
no other key is reached). Very long texts are read whole; sizes and sketches
that tie are told apart by the sets' names. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, drop, materialize, row_name, table
from tessera.llm.components import components

WIDTH, P, Q = 5, 4, 5
#: One document in so many is sampled for widespread shingles; so many of those make one; so many are kept (8 bytes each).
SAMPLED, WIDESPREAD, KEPT = 16, 3, 300_000
#: Rows up to which a table of ids is broadcast; beyond, it is a shuffled join.
BROADCAST_ROWS = 500_000
#: Rows of sizes and sketches (some 200 bytes each) up to which they are broadcast.
BROADCAST_MEMBERS = 60_000
SKETCH_WORDS = 16
_PARTS = [f"s{i}" for i in range(SKETCH_WORDS)]
_M1, _M2, _G = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_power = np.array([1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased bytes, in order."""
    b = np.frombuffer(data, np.uint8)
    return hashed_runs(b, ~_SPACE[b])[0]


def hashed_runs(b: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each run of bytes that `word` marks."""
    global _power
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    sizes = ends - starts
    longest = int(sizes.max())
    if longest > len(_power):
        steps = np.full(2 * longest, _G, np.uint64)
        steps[0] = 1
        _power = np.multiply.accumulate(steps)
    b = b[word].astype(np.uint64)  # words without the gaps between them
    first = np.cumsum(sizes) - sizes
    value = (b + np.uint64(1)) * _power[np.arange(len(b)) - np.repeat(first, sizes)]
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only
    n = len(words)
    if not n:
        return words
    if n < width:
        value = n
        for w in words.tolist():
            value = (value * _G + w) & 0xFFFFFFFFFFFFFFFF
        return mix(np.array([value], np.uint64))
    h = words[: n - width + 1].copy()
    for j in range(1, width):
        h = h * np.uint64(_G) + words[j : n - width + 1 + j]
    return np.unique(mix(h))


def signature(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    m = mix(grams + np.uint64(_G))
    value = mix(np.array([(int(np.bitwise_xor.reduce(m)) * int(_M1) + int(m.sum()) + len(grams)) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    return int(value.view(np.int64)[0])


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each of 64 * SKETCH_WORDS bits."""
    bits = np.bincount((grams >> np.uint64(8)).astype(np.int64) & (64 * SKETCH_WORDS - 1), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def most_different(s: int, p: int = P, q: int = Q) -> int:
    """The most shingles in which a set of s differs from any partner."""
    return (q - p) * (s + s * q // p) // (q + p)


def segment_keys(grams: np.ndarray, widespread: np.ndarray, p: int = P, q: int = Q) -> np.ndarray:
    """The keys that a set emits."""
    s = len(grams)
    if not s:
        return np.empty(0, np.int64)
    common = np.zeros(s, bool)
    if len(widespread):
        at = np.minimum(np.searchsorted(widespread, grams), len(widespread) - 1)
        common = widespread[at] == grams
    need, own, out = most_different(s, p, q) + 1, s.bit_length() - 1, []
    for band in (own, own + 1) if s * q // p >= 2 << own else (own,):
        top, level = 2 << band, 0
        while True:
            segments = (top if top <= 64 else -(-top // 3)) << level
            if level:
                tokens = mix(grams + np.uint64(level) * np.uint64(_G))
                order = np.argsort(tokens)
                tokens, mark = tokens[order], common[order]
            else:
                tokens, mark = grams, common
            place = ((tokens >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)  # grows with the token, so segments are runs
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            parity = np.bitwise_xor.reduceat(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
            last = np.logical_and.reduceat(mark, first)
            keys = mix(parity + place[first] * np.uint64(_G) + np.uint64((band << 8 | level) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
            out.append(np.concatenate([keys[~last], keys[last]])[:need])
            if len(first) >= need:
                break
            level += 1
    return np.concatenate(out).view(np.int64)


def _prints(docs: DataFrame, width: int, widespread, p: int, q: int) -> DataFrame:
    """(key, hash, n_shingles, node, sketch, keys); each task gives the sketch and keys of a set once."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = widespread.value, set()
        for batch in batches:
            sizes, nodes, keys, sketches, none = [], [], [], [], np.empty(0, np.int64)
            for text in batch.column(1).to_pylist():
                grams = shingle_set(text, width)
                node = signature(grams) if len(grams) else 0
                sizes.append(len(grams))
                nodes.append(node)
                new = len(grams) > 0 and node not in seen
                keys.append(segment_keys(grams, hot, p, q) if new else none)
                sketches.append(sketch(grams) if new else none)
                seen.add(node)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate([none, *x]))) for x in (sketches, keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *lists], names=["_key", "_hash", "n_shingles", "node", "sketch", "keys"])

    return docs.mapInArrow(prints, f"_key {docs.schema['_key'].dataType.simpleString()}, _hash long, n_shingles long, node long, sketch array<long>, keys array<long>")


def widespread_shingles(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of shingles that are widespread on a sample of the documents; KEPT at most."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "n"])

    sample = docs.where(F.pmod(F.xxhash64("_key", F.lit(6)), F.lit(SAMPLED)) == 0).select("_text")
    counted = sample.mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= WIDESPREAD)
    top = counted.orderBy(F.desc("n"), "token").limit(KEPT).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, grams) of wanted (_key, _hash, node), one row each: their texts are read again, by key and text, as keys may be null or repeat."""
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    wanted = wanted.select(F.col("_key").alias("_wanted"), F.col("_hash").alias("_of"), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    rows.append((node, shingle_set(text, width).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "grams"])

    met = docs.join(wanted, docs["_key"].eqNullSafe(F.col("_wanted")) & (F.col("_hash") == F.col("_of")))
    return met.select("node", "_text").mapInArrow(sets, "node long, grams binary").dropDuplicates(["node"])


def _side(members: DataFrame, k: str) -> DataFrame:
    """Sizes and sketches with the suffix of one side of a pair."""
    return members.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", *_PARTS)])


def _possible(p: int, q: int) -> Column:
    """What sizes and the Hamming distance of two sketches leave possible; plain columns, so it runs in generated code."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _PARTS])
    return (q * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b")) & ((q + p) * apart <= (q - p) * (F.col("n_a") + F.col("n_b")))


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            out.append(q * both >= p * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    side = lambda k: sets.select(F.col("node").alias(k), F.col("grams").alias(f"grams_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(linked("grams_a", "grams_b")).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, p: int = P, q: int = Q) -> DataFrame:
    """(key, n_shingles, component_id) of every row; component_id is the smallest key that links reach."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    hot = spark.sparkContext.broadcast(widespread_shingles(rows, width))
    prints = materialize(_prints(rows, width, hot, p, q), "prints")
    classes = materialize(prints.where(F.col("n_shingles") > 0).groupBy("node").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_hash")).alias("first")).select("node", "first._key", "first._hash"), "classes")

    # Keys that more than one set has.
    same = Window.partitionBy("key")
    emitted = prints.select(F.explode("keys").alias("key"), "node")
    shared = emitted.withColumn("low", F.min("node").over(same)).withColumn("high", F.max("node").over(same)).where(F.col("low") < F.col("high"))
    buckets = materialize(shared.select("key", "node").distinct(), "buckets")
    drawn = prints.where(F.size("sketch") > 0).select("node", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node"])
    drawn = drawn.select("node", "n", *[F.element_at("sketch", i + 1).alias(c) for i, c in enumerate(_PARTS)])
    members = materialize(buckets.select("node").distinct().join(classes, "node").join(drawn, "node"), "members")
    few = F.broadcast if members.count() <= BROADCAST_MEMBERS else (lambda df: df)

    # Every set of a key against the key's hub: the set that shares the most keys, the likeliest to be what the others are copies of.
    famous = buckets.join(buckets.groupBy("node").agg(F.count(F.lit(1)).alias("fame")), "node")
    hubs = buckets.join(famous.groupBy("key").agg(F.max(F.struct("fame", "node"))["node"].alias("hub")), "key")
    star = hubs.where(F.col("node") != F.col("hub")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    near = materialize(star.join(few(_side(members, "a")), "a").join(few(_side(members, "b")), "b").where(_possible(p, q)).select("a", "b"), "near")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = materialize(_sets(rows, ends(near).join(members.select("node", "_key", "_hash"), "node"), width), "sets")
    links = materialize(_verified(near, sets, p, q), "links")
    labels = components(links)
    done = [buckets, members, near, sets, links]

    # What one key holds of several components: hold these against each other.
    tags = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels
    named = buckets.join(tags, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high")).select("key")
    open_ = materialize(named.join(several, "key", "left_semi").join(few(members.drop("_key", "_hash")), "node"), "open")
    left = open_.select("key", *[F.col(c).alias(f"{c}_a") for c in ("label", "n", *_PARTS)], F.col("node").alias("a"))
    right = open_.select("key", *[F.col(c).alias(f"{c}_b") for c in ("label", "n", *_PARTS)], F.col("node").alias("b"))
    meet = (left["key"] == right["key"]) & (F.col("label_a") != F.col("label_b")) & (F.col("a") < F.col("b")) & _possible(p, q)
    across = materialize(left.join(right, meet).select("a", "b").distinct().join(near, ["a", "b"], "left_anti"), "across")
    done += [open_, across]
    if not across.isEmpty():
        more = ends(across).join(sets.select("node"), "node", "left_anti").join(members.select("node", "_key", "_hash"), "node")
        new = materialize(_sets(rows, more, width), "sets")
        found = materialize(_verified(across, sets.unionByName(new), p, q), "links")
        done += [new, found]
        if not found.isEmpty():
            drop(labels)
            labels = components(links.unionByName(found))
    for temporary in done:
        drop(temporary)

    tags = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels
    whole = classes.join(tags, "node", "left").select("node", "_key", F.coalesce("label", "node").alias("label"))
    least = whole.groupBy("label").agg(F.min("_key").alias("component_id"))
    named = whole.join(least, "label").select("node", "component_id")
    return prints.select("_key", "n_shingles", "node").join(named, (prints["node"] == named["node"]) & (F.col("n_shingles") > 0), "left").select(F.col("_key").alias(key), "n_shingles", F.coalesce("component_id", "_key").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the set size and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: one row of each component stays, the one with the smallest id.

    Null ids come last, and texts that share an id are apart by their hash.
    Rows equal in id and text are one; rows without a word have no partner, and
    all stay.
    """
    wordless = F.coalesce("text", F.lit("")).rlike(r"\A[ \t-\r]*\z")
    keyed = docs.where(~wordless).withColumn("_own", row_name(docs))
    found = near_duplicates(keyed.select("_own", "text"), "_own").where(F.col("_own") == F.col("component_id")).select("_own").distinct()
    kept = keyed.join(found, "_own", "left_semi").dropDuplicates(["_own"])
    return kept.select(*docs.columns).unionByName(docs.where(wordless))


ORACLE = r"""
with recursive words as (
  select row_number() over () as r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as materialized (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s
  from words),
grams as materialized (select r, unnest(s) as g from sets),
pairs as (select a.r as x, b.r as y, count(*) as n from grams a join grams b on a.g = b.g and a.r < b.r group by all),
links as materialized (
  select x, y from pairs join sets a on a.r = x join sets b on b.r = y
  where 100 * n >= 80 * (len(a.s) + len(b.s) - n)),
both_ways as materialized (select x, y from links union select y, x from links),
reach(x, y) as (select x, y from both_ways union select reach.x, b.y from reach join both_ways b on reach.y = b.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) as component_id
from sets s left join (select reach.x, min(o.doc_id) as low from reach join sets o on o.r = reach.y group by reach.x) m on m.x = s.r
"""
