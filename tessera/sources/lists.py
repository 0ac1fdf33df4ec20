"""JSON files that are one long list, or an object that wraps lists, read by many tasks.

The text reader cuts a file at every `}` and deals its byte ranges to tasks, so
any store that Spark reads will do, and a file needs no line breaks. What a
brace or comma means depends on what comes before it: whether a string is open,
and how deep the place is. So a first pass sums up each range for both cases,
a string open at its start or not; from these sums each range gets the state
that it starts in. A second pass, which knows strings and depth, cuts the text
at the brackets and commas that separate members and elements. What crosses
ranges comes in pieces, which are joined by their places. Between passes there
is one small row for each range. Nothing larger than a block of BLOCK bytes and
an element is held, and no tree is built: elements are parsed by from_json.

Defined results: a file that is neither list nor object has no rows; an element
that is no JSON of the schema has null fields, and the others stay; null
elements count. Of an object the first of the wrappers that is a list counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are scanned at a time, and ranges whose states are broadcast; beyond, they are joined by a shuffle.
BLOCK, BROADCAST_RANGES = 4 << 20, 500_000
_SIGNS = np.zeros(256, np.int8)
_SIGNS[[ord(c) for c in "[{"]] = 1
_SIGNS[[ord(c) for c in "]}"]] = -1
_SIGNS[ord(",")] = 2
_NAME = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)
PIECE = "file string, start long, seq long, cut boolean, sign string, after long, text string"


def structure(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places, steps, inside): brackets (+1, -1) and commas (0) outside strings, and whether the end is in a string."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 0x22)
    if b"\\" in data:
        plain = np.maximum.accumulate(np.where(b != 0x5C, np.arange(len(b)), -1))  # the last place that has no backslash
        before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    at = np.flatnonzero(_SIGNS[b])
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    steps = _SIGNS[b[at]].astype(np.int64)
    return at, np.where(steps == 2, 0, steps), bool((len(quotes) + inside) % 2)


def fragments(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, start, value): each range's pieces between closing braces, in order."""
    return spark.read.option("lineSep", "}").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, bool]]:
    """(range, bytes, last) of ranges, some bytes at a time; the text is the last column, and a brace goes in front of each piece but a file's first."""
    key, held, size, first = None, [], 0, False
    for batch in batches:
        names = zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True)
        for name, text in zip(names, batch.columns[-1], strict=True):
            if name != key:
                if key is not None:
                    yield key, b"".join(held), True
                key, held, size, first = name, [], 0, name[1] == 0
            piece = text.as_buffer().to_pybytes()
            held.append(piece if first else b"}" + piece)
            first, size = False, size + len(piece) + 1
            if size >= BLOCK:
                yield key, b"".join(held), False
                held, size = [], 0
    if key is not None:
        yield key, b"".join(held), True


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: how the depth changes if it starts outside or inside a string, whether it flips that, and its first sign."""
    depth, inside, opens, out = [0, 0], [False, True], "", []
    for (file, start), data, last in blocks(batches):
        opens = opens or data.lstrip()[:1].decode("latin1")
        for i in (0, 1):
            _, steps, inside[i] = structure(data, inside[i])
            depth[i] += int(steps.sum())
        if last:
            out.append((file, start, *depth, inside[0], opens))
            depth, inside, opens = [0, 0], [False, True], ""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "start", "outside", "within", "flips", "opens"])


def range_states(parts: DataFrame) -> DataFrame:
    """(file, start, inside, depth, level) of each range: a row for each, by file, in order."""
    sums = parts.mapInArrow(_sums, "file string, start long, outside long, within long, flips boolean, opens string")
    ordered = Window.partitionBy("file").orderBy("start")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = sums.withColumn("inside", summed(F.col("flips").cast("int")) % 2 == 1).withColumn("opens", F.first("opens").over(ordered))
    known = known.withColumn("depth", summed(F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))))
    level = F.when(F.col("opens") == "[", 1).when(F.col("opens") == "{", 2)
    return known.select("file", "start", "inside", "depth", level.cast("long").alias("level")).where(F.col("level").isNotNull())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text before each cut of a range, the sign that it is cut at and the depth behind it; last, without a cut, the rest."""
    key, seq, held, inside, depth = None, 0, [], False, 0
    for name, data, last in blocks(batches):
        file, start, begins, deep, level = name
        if name != key:
            key, seq, held, inside, depth = name, 0, [], begins, deep
        at, steps, inside = structure(data, inside)
        after = depth + np.cumsum(steps)
        depth = int(after[-1]) if len(after) else depth
        # Commas up to the level, what opens up to it, what closes from it.
        cut = np.where(steps == 0, (after >= 1) & (after <= level), np.where(steps > 0, after <= level, after < level))
        places, depths, begin, texts = at[cut].tolist(), after[cut].tolist(), 0, []
        for place in places:
            texts.append(b"".join([*held, data[begin:place]]) if held else data[begin:place])
            begin, held = place + 1, []
        held.append(data[begin:])
        signs = [chr(data[p]) for p in places]
        if last:
            texts, signs, depths, held = [*texts, b"".join(held)], [*signs, None], [*depths, None], []
        n = len(texts)
        text = pa.array(texts, pa.binary()).cast(pa.string())
        columns = [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), pa.array([s is not None for s in signs], pa.bool_()), pa.array(signs, pa.string()), pa.array(depths, pa.int64()), text]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "seq", "cut", "sign", "after", "text"])
        seq += n


@F.arrow_udf(T.StringType())
def _member(texts: pa.Array) -> pa.Array:
    """The name that the text before an opening bracket ends with."""
    found = [_NAME.search(t or "") for t in texts.to_pylist()]
    return pa.array([json.loads(f'"{m[1]}"') if m else None for m in found], pa.string())


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """(file, start, seq, sign, after, text) of every cut, with what ranges before it hold of its text."""
    rest = pieces.where(~F.col("cut"))
    firsts = pieces.where(F.col("cut") & (F.col("seq") == 0)).select("file", "start").withColumn("has", F.lit(True))
    ordered = Window.partitionBy("file").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    goes = F.min(F.when(F.col("has"), F.col("start"))).over(ordered)
    ends = rest.select("file", "start").join(firsts, ["file", "start"], "left").withColumn("goes", goes).select("file", "start", "goes")
    lead = rest.join(ends, ["file", "start"]).where(F.col("goes").isNotNull()).groupBy("file", "goes").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    lead = lead.select("file", F.col("goes").alias("start"), F.lit(0).cast("long").alias("seq"), F.array_join(F.col("parts.text"), "").alias("lead"))
    return pieces.where("cut").join(lead, ["file", "start", "seq"], "left").withColumn("text", F.concat(F.coalesce("lead", F.lit("")), F.col("text"))).drop("lead", "cut")


def list_elements(spark: SparkSession, paths: str | Sequence[str], wrappers: Sequence[str], keep) -> DataFrame:
    """(file, pos, text) of the elements of each file's list; `keep` writes a table and reads it again."""
    parts = fragments(spark, paths)
    states = keep(range_states(parts))
    if states.count() <= BROADCAST_RANGES:
        placed = parts.join(F.broadcast(states), ["file", "start"])
    else:
        placed = parts.withColumn("_n", F.monotonically_increasing_id()).join(states, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "_n")
    pieces = keep(placed.select("file", "start", "inside", "depth", "level", "value").mapInArrow(_pieces, PIECE))
    cuts = joined_pieces(pieces).join(F.broadcast(states.select("file", "level").distinct()), "file")

    # What opens at the level is what elements are of: a file's lists, by name where an object wraps them.
    opened = cuts.where(F.col("sign").isin("[", "{") & (F.col("after") == F.col("level"))).select("file", F.struct("start", "seq").alias("at"), "sign", F.when(F.col("level") == 1, F.lit("")).otherwise(_member("text")).alias("name"))
    rank = F.when(F.col("name") == "", 0).otherwise(F.array_position(F.array(*map(F.lit, wrappers)), F.col("name")))
    wanted = F.min(F.when((F.col("sign") == "[") & ((F.col("name") == "") | (rank > 0)), rank)).over(Window.partitionBy("file"))
    opened = opened.withColumn("rank", rank).withColumn("wanted", wanted).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", ((F.col("sign") == "[") & (F.col("rank") == F.col("wanted"))).alias("ours")))).alias("opened"))

    ends = ((F.col("sign") == ",") & (F.col("after") == F.col("level"))) | (F.col("sign").isin("]", "}") & (F.col("after") == F.col("level") - 1))
    held = cuts.where(ends & (F.trim(F.translate("text", "\t\r\n", "   ")) != "")).join(opened, "file")
    last = F.element_at(F.filter("opened", lambda o: o["at"] < F.struct("start", "seq")), -1)
    ours = keep(held.where(last["ours"]).select("file", "start", "seq", "text"))

    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = ours.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("file", "start").orderBy("seq")) - 1
    return ours.join(counts, ["file", "start"]).select("file", (F.col("first") + within).alias("pos"), "text")


def parsed(elements: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of the elements, and file and pos."""
    row = F.from_json("text", schema)
    return elements.select(row.alias("row"), "file", "pos").select("row.*", "file", "pos")


def list_lines(rows: Column) -> Column:
    return F.to_json(rows, {"ignoreNullFields": "false"})


def write_lists(df: DataFrame, path: str) -> None:
    """Each task writes its rows as a file that is a JSON list, line by line; nothing is gathered."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = "["
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([f"{sign}{rows[0]}", *(f",{r}" for r in rows[1:])])], names=["value"])
                sign = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if sign == "," else "[]"])], names=["value"])

    df.select(list_lines(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.text(path)
