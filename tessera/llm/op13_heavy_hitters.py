"""Guaranteed heavy hitters by mergeable q-digests.

Entries are (stream, grp, item, weight). Items get dense ids from a dictionary:
distinct items are dealt into ranges, numbered within each, and a range starts
where the ones before it end. A q-digest of a group is a set of nodes of the
dyadic tree over the ids, with counts. Compression goes from the leaves up:
where a pair of siblings and their parent together weigh at most floor(T / k),
both move into the parent. So an inner node never weighs more than that, and
with k = 10 * share * depth the ancestors of a leaf together at most T / (10 *
share). There are at most 3k nodes, however many items occur: the depth is the
number of bits of an id, 40 at 10^12 items.

Each task digests the entries that it reads, groups side by side in arrays; it
puts out what it has when it holds more than `HELD` nodes. Digests of equal
tree add up node by node and are compressed again, which keeps both bounds. They
merge in rounds of `FAN` at most, by task number, so a group that a third of all
entries belongs to is not gathered by one task. A leaf's count gives low, its
ancestors' counts added give high; leaves with high above a share of T are
candidates, some 1.12 * share at most for each group, and no other item can be
heavy. Candidates alone are counted again over all entries.

Joins are by shuffle: neither the dictionary nor the candidates are broadcast,
as both grow with the input; adaptive execution splits a hot item's rows.

Defined results: entries with a null group, item or weight drop out, as do
those of a weight below zero, which no q-digest can hold; a weight of zero
counts as an entry. Repeated entries count again. Items are texts of any length,
the empty one included; items that tie are all returned, by name. An empty
table, and groups of total zero, give no rows. Other columns are not read. JSON
is valid if the whole text is: cut texts, trailing text, NaN, and single quotes
give no entry; of names that repeat in an object the last one counts, and
values that are objects or lists are no keys. JSON may be nested to any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, drop, materialize, table

SHARE = 20
#: Entries or nodes that a task holds before it digests or puts them out; digests of a group that are merged at a time.
HELD, FAN = 1 << 20, 64
HOUR = 3_600_000_000
DIGEST = "stream string, grp long, part long, n long, total long, nodes array<long>, counts array<long>"


# --- JSON -----------------------------------------------------------------

_SPACE = re.compile(r"[ \t\n\r]*+")
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null')


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse_deep(text: str):
    """The value of a JSON text that is nested too deep for the json module; a ValueError if it isn't valid."""
    top: list = []
    stack: list[tuple[object, str | None]] = [(top, None)]  # an open list or object and the name that its next value gets
    at, want = _SPACE.match(text).end(), "value"
    while len(stack) > 1 or not top:
        held, name = stack[-1]
        c = text[at : at + 1]
        if want == "value" and c in ("[", "{"):
            new: object = [] if c == "[" else {}
            held.append(new) if name is None else held.__setitem__(name, new)
            stack.append((new, None))
            at, want = at + 1, "first"
        elif want in ("value", "first") and c and isinstance(held, list) and not (want == "first" and c == "]") or want == "value" and isinstance(held, dict):
            if want == "first" and c in ("[", "{"):
                want = "value"
                continue
            m = _SCALAR.match(text, at)
            if m is None:
                raise ValueError(f"no value at {at}")
            value = json.loads(m[0], parse_int=str, parse_float=str)
            held.append(value) if name is None else held.__setitem__(name, value)
            at, want = m.end(), "next"
        elif c == ("]" if isinstance(held, list) else "}") and want in ("first", "next") and len(stack) > 1:
            stack.pop()
            stack[-1] = (stack[-1][0], None)
            at, want = at + 1, "next"
        elif isinstance(held, dict) and (want == "first" and c == '"' or want == "next" and c == ","):
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
            m = _SCALAR.match(text, at)
            if m is None or text[at] != '"':
                raise ValueError(f"no name at {at}")
            at = _SPACE.match(text, m.end()).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            stack[-1] = (held, json.loads(m[0]))
            at, want = at + 1, "value"
        elif isinstance(held, list) and want == "next" and c == "," and len(stack) > 1:
            at, want = at + 1, "value"
        else:
            raise ValueError(f"not JSON at {at}")
        at = _SPACE.match(text, at).end()
    if at != len(text):
        raise ValueError(f"more text at {at}")
    return top[0]


def parse(text: str):
    """The value of a JSON text, numbers as they are written; a ValueError if the whole isn't valid."""
    try:
        return json.loads(text, parse_int=str, parse_float=str, parse_constant=_refuse)
    except RecursionError:
        return parse_deep(text)


def _scalar(value: object) -> str | None:
    """A scalar as text; half of a surrogate pair reads as U+FFFD."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return str(value).lower() if isinstance(value, bool) else None


def prop_keys(text: str | None) -> list[str]:
    """The keys of a click's properties: its device's system, its tags, the items' numbers."""
    if text is None:
        return []
    try:
        props = parse(text)
    except ValueError:
        return []
    if not isinstance(props, dict):
        return []
    device, tags, items = (props.get(name) for name in ("device", "tags", "items"))
    found = [("os", device.get("os") if isinstance(device, dict) else None)]
    found += [("tag", x) for x in tags] if isinstance(tags, list) else []
    found += [("sku", x.get("sku")) for x in items if isinstance(x, dict)] if isinstance(items, list) else []
    return [f"{name}={value}" for name, value in ((n, _scalar(v)) for n, v in found) if value is not None]


# --- entries --------------------------------------------------------------


def hour_of(df: DataFrame, ts: str) -> Column:
    """Hours since 1970, read as UTC; a time without a zone doesn't depend on the session's."""
    if df.schema[ts].dataType.typeName() == "timestamp":
        return F.floor(F.unix_micros(ts) / F.lit(HOUR)).cast("long")
    return F.unix_date(F.col(ts).cast("date")).cast("long") * 24 + F.hour(ts)


def entry(stream: str, grp: Column, item: Column, weight: Column) -> list[Column]:
    return [F.lit(stream).alias("stream"), grp.cast("long").alias("grp"), item.cast("string").alias("item"), weight.cast("long").alias("weight")]


def shop_entries(clicks: DataFrame, lines: DataFrame) -> DataFrame:
    """The entries of the three streams `user`, `part` and `prop`."""

    @F.arrow_udf("array<string>")
    def keys(props: pa.Array) -> pa.Array:
        return pa.array([prop_keys(x.as_py()) for x in props], pa.list_(pa.string()))

    bound_batches(clicks.sparkSession)
    user = clicks.select(*entry("user", hour_of(clicks, "ts"), F.col("client_id"), F.lit(1)))
    part = lines.select(*entry("part", F.col("vendor_id"), F.col("item_id"), F.col("quantity")))
    named = clicks.where(F.col("client_id").isNotNull() & F.col("props").isNotNull()).select("client_id", F.explode(keys("props")).alias("item"))
    return reduce(DataFrame.unionByName, [user, part, named.select(*entry("prop", F.col("client_id"), F.col("item"), F.lit(1)))])


def kept(entries: DataFrame) -> DataFrame:
    return entries.select("stream", "grp", "item", "weight").dropna().where(F.col("weight") >= 0)


def dictionary(entries: DataFrame) -> tuple[DataFrame, int]:
    """(stream, item, id), ids dense from 0, and how many there are.

    Only the sizes of the ranges, one number for each task, are seen on the
    driver and sent back.
    """
    items = entries.select("stream", "item").distinct().repartitionByRange("stream", "item")
    row = F.monotonically_increasing_id()  # the partition, then the row's place in it
    dealt = materialize(items.select("stream", "item", row.alias("_row")), "items")
    sizes = sorted((r["range"], r["n"]) for r in dealt.groupBy(F.shiftright("_row", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [0] * (sizes[-1][0] + 1 if sizes else 1), 0
    for number, n in sizes:
        starts[number], total = total, total + n
    start = F.get(F.array(*map(F.lit, starts)), F.shiftright("_row", 33).cast("int"))
    ids = dealt.select("stream", "item", (start + F.col("_row").bitwiseAND((1 << 33) - 1)).cast("long").alias("id"))
    ids._tessera_path = dealt._tessera_path
    return ids, total


# --- digests --------------------------------------------------------------


def summed(group: np.ndarray, node: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """In order of group and node; equal nodes add up."""
    order = np.lexsort((node, group))
    group, node = group[order], node[order]
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])))[: len(group)]
    return group[first], node[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in counts]


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, least: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(group, node, count) of many groups' compressed nodes, in order.

    group numbers the groups from 0; least has of each group the weight up to
    which siblings and their parent become one. Node 1 is the root, node x has
    the children 2x and 2x + 1. Equal nodes add up.
    """
    group, node, count = summed(group, node, count)
    open_ = least[group] > 0  # the others are too light to be compressed
    done = [(group[~open_], node[~open_], count[~open_])]
    group, node, count = group[open_], node[open_], count[open_]
    for level in range(depth, 0, -1):
        low = node >= 1 << level
        g, v, c = group[low], node[low], count[low]
        if not len(g):
            continue
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (v[1:] >> 1 != v[:-1] >> 1)))
        both, none = np.add.reduceat(c, first), np.zeros(len(first), np.int64)
        # The nodes above, with every family's parent among them, in the order of the families.
        above = summed(np.append(group[~low], g[first]), np.append(node[~low], v[first] >> 1), np.append(count[~low], none), np.append(np.zeros(int((~low).sum()), np.int64), none + 1))
        parent = np.flatnonzero(above[3])
        moves = both + above[2][parent] <= least[g[first]]
        above[2][parent[moves]] += both[moves]
        stay = np.repeat(~moves, np.diff(np.append(first, len(g))))
        done.append((g[stay], v[stay], c[stay]))
        some = above[2] > 0
        group, node, count = (x[some] for x in above[:3])
    done.append((group, node, count))
    return summed(*(np.concatenate(x) for x in zip(*done, strict=True)))


def batches_of(stream: list[str], grp: np.ndarray, part: int | np.ndarray, n: np.ndarray, total: np.ndarray, group: np.ndarray, node: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Digest rows of numbered groups, some at a time so that batches stay small."""
    edges = np.searchsorted(group, np.arange(len(grp) + 1))
    part = np.broadcast_to(np.asarray(part, np.int64), grp.shape)
    low = 0
    while low < len(grp):
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + (1 << 18), "right")) - 1)
        high = min(high, low + 10_000, len(grp))
        a, b = edges[low], edges[high]
        offsets = pa.array((edges[low : high + 1] - a).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[a:b])) for x in (node, count)]
        yield pa.RecordBatch.from_arrays([pa.array(stream[low:high], pa.string()), *[pa.array(x[low:high], pa.int64()) for x in (grp, part, n, total)], *lists], names=["stream", "grp", "part", "n", "total", "nodes", "counts"])
        low = high


class Digests:
    """The digests of the groups that a task has met so far."""

    def __init__(self, depth: int, k: int):
        self.depth, self.k = depth, k
        self.names: list[str] = []
        self.clear()

    def clear(self) -> None:
        self.known: tuple | None = None  # (stream, grp, n, total, group, node, count)
        self.new: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, stream: np.ndarray, grp: np.ndarray, n: np.ndarray, total: np.ndarray, nodes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of (stream's number, grp, n, total), each with so many nodes."""
        self.new.append((stream, grp, n, total, nodes, counts, sizes))
        self.held += len(nodes)

    def settle(self) -> int:
        """Merge what is new; the nodes held after it."""
        if self.new:
            parts = ([self.known] if self.known else []) + self.new
            stream, grp, n, total, nodes, counts, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((grp, stream))
            s, g = stream[order], grp[order]
            first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])))
            of = np.empty(len(order), np.int64)
            of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            n, total = np.add.reduceat(n[order], first), np.add.reduceat(total[order], first)
            group, node, count = compress(np.repeat(of, sizes), nodes, counts, total // self.k, self.depth)
            sizes = np.bincount(group, minlength=len(first)).astype(np.int64)
            self.known, self.new = (s[first], g[first], n, total, node, count, sizes), []
            self.held = len(node)
        return self.held

    def put_out(self, part: int, keep: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
        """All digests, but for the one to keep."""
        self.settle()
        if self.known:
            stream, grp, n, total, node, count, sizes = self.known
            of = np.repeat(np.arange(len(grp)), sizes)
            own = (stream == keep[0]) & (grp == keep[1]) if keep else np.zeros(len(grp), bool)
            self.clear()
            if own.any():
                mine = own[of]
                self.add(stream[own], grp[own], n[own], total[own], node[mine], count[mine], sizes[own])
            out, mine = ~own, ~own[of]
            numbered = np.cumsum(out) - 1
            yield from batches_of([self.names[i] for i in stream[out].tolist()], grp[out], part, n[out], total[out], numbered[of[mine]], node[mine], count[mine])

    def numbers(self, names: pa.Array) -> np.ndarray:
        """The streams' numbers."""
        coded = names.dictionary_encode()
        own = []
        for name in coded.dictionary.to_pylist():
            if name not in self.names:
                self.names.append(name)
            own.append(self.names.index(name))
        return np.array(own, np.int64)[coded.indices.to_numpy()]


def first_digests(coded: DataFrame, depth: int, k: int) -> DataFrame:
    """Digests of (stream, grp, id, weight) by the task that reads them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), Digests(depth, k)
        for batch in batches:
            grp, ids, weight = (batch.column(i).to_numpy() for i in (1, 2, 3))
            one = np.ones(len(grp), np.int64)
            own.add(own.numbers(batch.column(0)), grp, one, weight, ids + (1 << depth), weight, one)
            if own.held > HELD and own.settle() > HELD // 2:
                yield from own.put_out(part)
        yield from own.put_out(part)

    return coded.select("stream", "grp", "id", "weight").mapInArrow(digest, DIGEST)


def merged(digests: DataFrame, depth: int, k: int) -> DataFrame:
    """One round: digests of a group whose part numbers are equal become one; they follow each other in the sorted partitions."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = Digests(depth, k), None
        for batch in batches:
            part = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                rows, number = batch.slice(a, b - a), int(part[a])
                if last is not None and number != last:
                    yield from own.put_out(last)
                last = number
                nodes, counts = rows.column(5), rows.column(6)
                stream, (grp, n, total) = own.numbers(rows.column(0)), (rows.column(i).to_numpy() for i in (1, 3, 4))
                own.add(stream, grp, n, total, nodes.flatten().to_numpy(), counts.flatten().to_numpy(), np.diff(nodes.offsets.to_numpy()).astype(np.int64))
                if own.held > HELD and own.settle() > HELD // 2:  # all groups but the last one are complete
                    yield from own.put_out(last, (int(stream[-1]), int(grp[-1])))
        if last is not None:
            yield from own.put_out(last)

    by = ["stream", "grp", "part"]
    return digests.repartition(*by).sortWithinPartitions("part", "stream", "grp").mapInArrow(merge, DIGEST)


def candidates(digests: DataFrame, depth: int, share: int) -> DataFrame:
    """(stream, grp, id, n, total, low, high) of each group's leaves that may be heavy."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(5).offsets.to_numpy())
            of = np.repeat(np.arange(batch.num_rows), sizes)
            node, count = (batch.column(i).flatten().to_numpy() for i in (5, 6))
            total = batch.column(4).to_numpy()
            leaf = np.flatnonzero(node >= 1 << depth)
            mine, high = of[leaf], count[leaf].copy()
            edges, leaves = np.append(0, np.cumsum(sizes)), np.searchsorted(mine, np.arange(batch.num_rows + 1))
            for i in np.unique(of[node < 1 << depth]).tolist():  # the groups that have inner nodes
                own, counts = (x[edges[i] : edges[i + 1]] for x in (node, count))  # in order
                a, b = leaves[i], leaves[i + 1]
                for step in range(1, depth + 1):
                    above = node[leaf[a:b]] >> step
                    at = np.minimum(np.searchsorted(own, above), len(own) - 1)
                    high[a:b] += np.where(own[at] == above, counts[at], 0)
            heavy = share * high > total[mine]
            row = pa.array(mine[heavy])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(row) for i in (0, 1)], pa.array(node[leaf][heavy] - (1 << depth)), *[batch.column(i).take(row) for i in (3, 4)], pa.array(count[leaf][heavy]), pa.array(high[heavy])],
                names=["stream", "grp", "id", "n", "total", "low", "high"],
            )

    return digests.mapInArrow(find, "stream string, grp long, id long, n long, total long, low long, high long")


def summaries(coded: DataFrame, depth: int, k: int) -> DataFrame:
    """One digest of each group."""
    digests = materialize(first_digests(coded, depth, k), "digests")
    parts = (digests.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        # Part p of this round has the digests of FAN parts of the one before; the last round has one part.
        before, parts = digests, -(-parts // FAN)
        digests = materialize(merged(before.withColumn("part", F.floor(F.col("part") / FAN).cast("long")), depth, k), "digests")
        drop(before)
        if parts == 1:
            return digests


def heavy_hitters(entries: DataFrame, share: int = SHARE) -> DataFrame:
    """(stream, grp, item, n_entries, total, w, low, estimate, high) of the items with share * w > total in their group."""
    bound_batches(entries.sparkSession)
    entries = materialize(kept(entries), "entries")
    ids, known = dictionary(entries)
    depth = max(1, (known - 1).bit_length())
    k = 10 * share * depth
    coded = materialize(entries.join(ids.hint("merge"), ["stream", "item"]).select("stream", "grp", "id", "weight"), "coded")
    drop(entries)
    digests = summaries(coded, depth, k)
    found = materialize(candidates(digests, depth, share), "candidates")
    drop(digests)
    met = coded.join(found.select("stream", "grp", "id").hint("merge"), ["stream", "grp", "id"])
    # Another key than the join's: rows are added up before they are dealt again, and a hot leaf's rows can be split in the join.
    again = met.groupBy(F.struct("stream", "grp", "id").alias("leaf")).agg(F.sum("weight").alias("w")).select("leaf.*", "w")
    sure = found.join(again.hint("merge"), ["stream", "grp", "id"]).where(share * F.col("w") > F.col("total"))
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("long")
    return sure.join(ids.hint("merge"), ["stream", "id"]).select("stream", "grp", "item", F.col("n").alias("n_entries"), "total", "w", "low", middle.alias("estimate"), "high")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the heavy keys of each hour's clicks, vendor's lines and client's properties."""
    return heavy_hitters(shop_entries(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sale_lines")))
