"""Vector codes from codebooks that Elkan's bounded Lloyd rounds learn.

Vectors become integers, floor(scale * x), and are cut into equal consecutive
parts; each part position has a codebook. A round assigns every part to its
nearest entry, by squared Euclidean distance, ties to the lower index, and then
replaces each entry by the floor of its parts' mean. A table in the shared
folder keeps, from round to round, each vector's integers, the entry of each of
its parts, an upper bound of the distance to it, and a lower bound of the
distance to every entry.

When entries have moved, bounds shift by how far: up for a part's own entry,
down for the others. A part whose upper bound is strictly below half of the
distance from its entry to the nearest other one stays. Another entry is left
out if the upper bound is strictly below its lower bound, or below half of the
distance between both entries. What is left makes the upper bound exact first,
then distances are computed where the bounds still don't decide. All choices
compare integers, so ties go to the lower index; bounds are rounded outward when
they become float32, so pruning never removes an entry that is as near.

Only the sums and counts of entries (one number for each component of a
codebook) come to the driver; codebooks go to the tasks. Both are of a fixed
size. The table of a round is dropped once the next is written.

Defined results: a row drops out whose vector is null, holds a null or
non-finite component, or has another length than the vector of the smallest
kept id. That length must be a multiple of `parts`, else it is a ValueError, as
are components of LARGEST or more after scaling, since sums of squares would
leave 64 bits. Codebooks start from the distinct smallest ids (of rows that
share one, the smallest vector; null ids never); with fewer, they have fewer
entries. Repeated rows give repeated results and weigh again; entries that are
equal go to the lower index, and unused ones stay. Without a kept id no row has
a code. Rows of a null label share a label error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, drop, materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 27
#: Labels up to which their errors are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LABELS = 100_000


def outward(x: np.ndarray, up: bool) -> np.ndarray:
    """As float32, not below (up) or not above x."""
    y = x.astype(np.float32)
    wrong = y < x if up else y > x
    y[wrong] = np.nextafter(y[wrong], np.float32(np.inf if up else -np.inf))
    return y


class Codebook:
    """The entries of one part position, and how far apart they are; movement since the round before."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(-1).astype(np.float64)) / 2
        self.half = outward(np.nextafter(apart, -1), False)  # of the distance between entries, from below
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(1, initial=np.inf)
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(-1).astype(np.float64))
        self.moved = outward(np.nextafter(moved, np.inf) * (moved > 0), True)

    def squared(self, x: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Integer squared distances of some parts to some entries."""
        return ((x[rows] - self.entries[which]) ** 2).sum(1)


def root(squared: np.ndarray, up: bool) -> np.ndarray:
    x = np.sqrt(squared.astype(np.float64))
    return outward(np.where(squared > 0, np.nextafter(x, np.inf if up else 0), x), up)


def first_assignment(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) of parts that have no bounds yet."""
    distance = np.stack([((x - e) ** 2).sum(1) for e in book.entries], 1)
    own = distance.argmin(1)  # the first of equal ones
    return own.astype(np.uint8), root(distance[np.arange(len(x)), own], True), root(distance, False)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved, and how many distances it took."""
    own = own.copy()
    upper = outward(upper.astype(np.float64) + book.moved[own], True)
    lower = np.maximum(outward(lower.astype(np.float64) - book.moved, False), np.float32(0))
    open_ = np.flatnonzero(~(upper < book.nearest[own]))
    left = lambda r: ~(upper[r, None] < lower[r]) & ~(upper[r, None] < book.half[own[r]]) & (np.arange(len(book.entries)) != own[r, None])
    open_ = open_[left(open_).any(1)]
    if not len(open_):
        return own, upper, lower, 0
    # The distance to its own entry, exactly; most others fall to that.
    exact = book.squared(x, open_, own[open_])
    upper[open_], lower[open_, own[open_]] = root(exact, True), root(exact, False)
    row, which = np.nonzero(left(open_))
    squared = book.squared(x, open_[row], which)
    lower[open_[row], which] = root(squared, False)
    all_ = np.full((len(open_), len(book.entries)), np.iinfo(np.int64).max)
    all_[np.arange(len(open_)), own[open_]] = exact
    all_[row, which] = squared
    best = all_.argmin(1)
    changed = best != own[open_]
    own[open_] = best
    upper[open_[changed]] = root(all_[changed, best[changed]], True)
    return own, upper, lower, len(open_) + len(row)


def _ints(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of equally long binary values."""
    data = b"".join(x.as_buffer() for x in column) if len(column) else b""
    return np.frombuffer(data, kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def whole_vectors(df: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """`_q`, the integers of each row whose vector is whole; other rows go."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vector).isNotNull() & finite).withColumn("_q", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def learn_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((key, label, code array<int>, error) of every kept row, codebooks by part, entry, component)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = whole_vectors(vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), F.col(label).alias("_label")), "_vector", scale).select("_key", "_label", "_q")
    smallest = [r["_key"] for r in rows.select("_key").dropna().distinct().orderBy("_key").limit(entries).collect()]
    seeds = rows.where(F.col("_key").isin(smallest)).groupBy("_key").agg(F.min("_q").alias("_q")).orderBy("_key").collect()
    width = len(seeds[0]["_q"]) if seeds else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    size = width // parts
    seeds = [r["_q"] for r in seeds if len(r["_q"]) == width]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, size).transpose(1, 0, 2)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.where((F.size("_q") == width) & F.lit(width > 0))
    large = rows.where(F.exists("_q", lambda q: (q >= LARGEST) | (q < -LARGEST))).limit(1).count()
    if large:
        raise ValueError(f"components of {LARGEST / scale:g} or more can't be summed in 64 bits")

    state = f"_key {kinds['_key']}, _label {kinds['_label']}, q binary, own binary, upper binary, lower binary"
    names = ["_key", "_label", "q", "own", "upper", "lower"]

    def assigned(now: np.ndarray, before: np.ndarray | None):
        """A function of batches: the state after the entries are what they are now."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = [Codebook(e, None if before is None else before[p]) for p, e in enumerate(now)]
            n = now.shape[1]
            for batch in batches:
                if not batch.num_rows:
                    continue
                if before is None:
                    q = batch.column(2).flatten().to_numpy().astype(np.int32).reshape(-1, width)
                    found = [first_assignment(q[:, p * size : (p + 1) * size].astype(np.int64), book[p]) for p in range(parts)]
                else:
                    q, own = _ints(batch.column(2), np.int32, width), _ints(batch.column(3), np.uint8, parts)
                    upper, lower = _ints(batch.column(4), np.float32, parts), _ints(batch.column(5), np.float32, parts * n)
                    found = [assign(q[:, p * size : (p + 1) * size].astype(np.int64), own[:, p], upper[:, p], lower[:, p * n : (p + 1) * n], book[p])[:3] for p in range(parts)]
                own, upper, lower = (np.stack(x, 1) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(q), _binary(own), _binary(upper), _binary(lower.reshape(len(q), -1))], names=names)

        return run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each part, entry and component that a task has met."""
        n = books.shape[1]
        total, count = np.zeros((parts, n, size), np.int64), np.zeros((parts, n), np.int64)
        for batch in batches:
            q, own = _ints(batch.column(0), np.int32, width).astype(np.int64), _ints(batch.column(1), np.uint8, parts)
            for p in range(parts):
                np.add.at(total[p], own[:, p], q[:, p * size : (p + 1) * size])
                count[p] += np.bincount(own[:, p], minlength=n)
        slot = np.flatnonzero(np.repeat(count.reshape(-1) > 0, size))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total.reshape(-1)[slot]), pa.array(np.repeat(count.reshape(-1), size)[slot])], names=["slot", "total", "n"])

    def updated(kept: DataFrame) -> np.ndarray:
        found = kept.select("q", "own").mapInArrow(sums, "slot long, total long, n long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        new = books.copy()
        flat = new.reshape(-1)
        for r in found:
            flat[r["slot"]] = r["total"] // r["n"]
        return flat.reshape(books.shape)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, own = _ints(batch.column(2), np.int32, width).astype(np.int64), _ints(batch.column(3), np.uint8, parts)
            nearest = np.concatenate([books[p][own[:, p]] for p in range(parts)], 1) if len(q) else q
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, parts, dtype=np.int32)), pa.array(own.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(((q - nearest) ** 2).sum(1))], names=["_key", "_label", "code", "error"])

    books = np.ascontiguousarray(books)
    kept = materialize(rows.mapInArrow(assigned(books, None), state), "bounds")
    for _ in range(rounds):
        before, books = books, updated(kept)
        last, kept = kept, materialize(kept.mapInArrow(assigned(books, before), state), "bounds")
        drop(last)
    codes = kept.mapInArrow(final, f"_key {kinds['_key']}, _label {kinds['_label']}, code array<int>, error long")
    return codes.select(F.col("_key").alias(key), F.col("_label").alias(label), "code", "error"), books


def label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """Add `label_error`, the errors of all rows of the same label; null is a label."""
    sums = codes.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = materialize(sums, "labels")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return codes.join(sums, codes[label].eqNullSafe(F.col("_label"))).drop("_label")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the code and errors of every vector, and a digest of the codebooks."""
    codes, books = learn_codes(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return label_errors(codes).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds as one chain of common table expressions."""
    sql = [
        f"kept as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE}.0::double * x) as bigint)) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"long as materialized (select r, (i - 1) // (len(q) // {PARTS}) as p, (i - 1) % (len(q) // {PARTS}) as c, q[i] as x from (select r, q, unnest(range(1, len(q) + 1)) as i from kept))",
        f"seeds as (select r, row_number() over (order by vec_id) - 1 as e from kept qualify row_number() over (order by vec_id) <= {ENTRIES})",
        "b0 as materialized (select p, e, c, x as y from long join seeds using (r))",
    ]
    for i in range(ROUNDS + 1):
        sql += [
            f"d{i} as (select r, p, e, sum((x - y) * (x - y)) as d from long join b{i} using (p, c) group by all)",
            f"a{i} as materialized (select r, p, arg_min(e, (d, e)) as e, min(d) as d from d{i} group by all)",
        ]
        if i < ROUNDS:
            sql += [
                f"m{i} as (select p, e, c, sum(x) as s, count(*) as n from long join a{i} using (r, p) group by all)",
                f"b{i + 1} as materialized (select p, e, c, coalesce(cast((s - ((s % n) + n) % n) // n as bigint), y) as y from b{i} left join m{i} using (p, e, c))",
            ]
    last = ROUNDS
    return (
        "with "
        + ",\n".join(sql)
        + f""",
book as (select sha256(string_agg(cast(y as varchar), ',' order by p, e, c)) as codebooks_sha256 from b{last}),
coded as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{last} group by r),
total as (select label, cast(sum(error) as bigint) as label_error from coded join kept using (r) group by label)
select vec_id, code, error, label_error, codebooks_sha256
from coded join kept using (r) join total on kept.label is not distinct from total.label cross join book"""
    )


ORACLE = _oracle()
