"""Best-fit packing with certified bin counts.

Documents become token ids (a byte-level tokenizer, then one end id); only
longer ones are cut, into pieces of `capacity` tokens, the first of which may
be shorter. Pieces are dealt at random into partitions of about `part_rows`
pieces. Each partition is packed by best-fit decreasing, and dual-feasible
functions give a lower bound on its bins. Partitions that meet the bound are
certified. The others put the pieces of their bins that are not full into a
pool; the pool is dealt anew, so that partitions exchange documents, and is
packed again; the new packing is taken if it needs fewer bins. This is tried
`rounds` times, each time dealt in another way.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each on its own; an empty table gives no rows. Keys may repeat or be
null. Very long texts are read whole and cut into pieces. Of bins that fit
equally well the one opened or filled last is taken; pieces of equal length go
by their numbers. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, drop, materialize, table

CAPACITY, END_ID, PART_ROWS, ROUNDS = 1024, 2, 20_000, 3
#: Chunks whose ids a worker keeps, and the longest it keeps.
CACHED, CHUNK = 300_000, 48
#: The pattern by which the byte-level tokenizer cuts a text before its merges: fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S)(?= \S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(spec: str) -> dict[bytes, int]:
    """Bytes of each token of a byte-level vocabulary, with its id.

    Such vocabularies write each byte as a printable character: printable
    Latin-1 bytes as themselves, the others from code point 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    parsed = json.loads(spec)
    special = {t["content"] for t in parsed.get("added_tokens", ())}
    return {bytes(byte_of[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in special}


class _Known(dict):
    """Ids of chunks; those not seen before are encoded, and kept unless they are long."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(self.before + chunk)).tobytes()
        if len(chunk) <= CHUNK:
            self[chunk] = ids
        return ids


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    As in the tokenizers library, added tokens (such as an end mark) are found
    first and have their own ids; what stands between them is encoded by
    itself. The tokenizer's pattern never joins what stands on both sides of a
    single space, so a text is cut there and the ids of its chunks are kept.
    The merges of chunks not seen before are run by tiktoken over the tokenizer
    file's own vocabulary; tests hold the ids against the library's.
    """

    def __init__(self, spec: str):
        ranks = byte_ranks(spec)
        added = json.loads(spec).get("added_tokens", ())
        if any(t.get(f) for t in added for f in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        encode = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.later, self.any = _Known(encode, ""), _Known(encode, " "), _Known(encode, "")

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.added):
            return b"".join([self.added[part] if i % 2 else self.plain(part) for i, part in enumerate(self.cut.split(text)) if part])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if "  " in text:
            return b"".join(map(self.any.__getitem__, _CUT.split(text)))
        chunks = text.split(" ")
        head = self.first[chunks[0]]
        return b"".join([head, *map(self.later.__getitem__, chunks[1:])])

    def trim(self) -> None:
        """Bound what is kept."""
        for known in (self.first, self.later, self.any):
            if len(known) > CACHED:
                known.clear()


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the key, piece, start, length and ids (binary).

    The tokenizer's file is read where the driver runs and sent to the
    executors; it is a fixed vocabulary of a few MB.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    end, names = np.array([end_id], "<u4").tobytes(), [key, "piece", "start", "length", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in names]
            for k, t in zip(keys, texts, strict=True):
                ids = encoder.encode(t or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    for column, value in zip(out, (k, piece, at, size, ids[4 * at : 4 * (at + size)]), strict=True):
                        column.append(value)
                    at, piece = at + size, piece + 1
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
            encoder.trim()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and the bins' fill, by best-fit decreasing.

    The set of free capacities in use is the bits of one number, so the
    tightest bin that holds a length is its lowest bit from there on.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, fill = 0, []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        above = free >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                free &= ~(1 << room)
        else:
            room, at = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += size
        room -= size
        if room:
            open_bins[room].append(at)
            free |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most that three families of dual-feasible functions prove.

    Sizes as they are; sizes with small ones as nothing and their complements
    as whole bins; and sizes rounded to multiples of capacity / k.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    total = int((sizes * counts).sum())
    best = -(-total // capacity)
    for low in sizes[sizes <= capacity // 2].tolist():
        value = np.where(sizes > capacity - low, capacity, np.where(sizes < low, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 21):
        whole = (k + 1) * sizes % capacity == 0
        value = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def _pack_parts(rows: DataFrame, stage: int, part_rows: int, capacity: int) -> DataFrame:
    """rows: _row and length. Deal, pack each part, and tell which bins are settled."""
    parts = max(1, -(-rows.count() // part_rows))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(stage)), F.lit(parts)))

    def pack_part(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        lengths = part["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        certified = len(fill) <= lower_bound(lengths, capacity)
        number = (stage << 56) | (int(part["_part"].iloc[0]) << 26)
        return pd.DataFrame({"_row": part["_row"], "length": lengths, "sequence_id": bins + number, "offset": offsets, "certified": certified, "_settled": certified | (fill[bins] == capacity)})

    return dealt.groupBy("_part").applyInPandas(pack_part, f"_row {rows.schema['_row'].dataType.simpleString()}, length long, sequence_id long, offset long, certified boolean, _settled boolean")


def pack(pieces: DataFrame, row: str, length: str = "length", capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(row, length, sequence_id, offset, certified) of pieces named by a unique `row`, which is not null."""
    rows = pieces.select(F.col(row).alias("_row"), F.col(length).cast("long").alias("length"))
    packed = materialize(_pack_parts(rows, 0, part_rows, capacity), "packed")
    pool = packed.where(~F.col("_settled"))
    settled = packed.where(F.col("_settled"))
    for stage in range(1, rounds + 1):
        before = pool.select("sequence_id").distinct().count()
        if before < 2:
            break
        again = materialize(_pack_parts(pool.select("_row", "length"), stage, part_rows, capacity), "packed")
        if again.select("sequence_id").distinct().count() >= before:
            drop(again)
            continue
        settled = settled.unionByName(again.where(F.col("_settled")))
        pool = again.where(~F.col("_settled"))
    return settled.unionByName(pool).drop("_settled").withColumnRenamed("_row", row)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id, offset and certified to every piece.

    Pieces are written once with a number of their own, so keys may be null or
    repeat, and no key is gathered anywhere.
    """
    named = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    packed = pack(named, "_row", "length", capacity, part_rows, rounds)
    return named.join(packed.select("_row", "sequence_id", "offset", "certified"), "_row").drop("_row")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence (binary), of packed pieces that kept theirs. A sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns; ids are reduced to their checksum before anything is shuffled."""
    pieces = tokenize(docs.select("doc_id", "text")).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every piece of every document and its place."""
    return digests(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage."""
    return digests(docs)
