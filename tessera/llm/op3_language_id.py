"""Language ID by compression: one raw-content zstandard dictionary per language.

Every whole text is brought to lower-case letters and single spaces and cut
into chunks of `chunk` bytes; each chunk is compressed with every language's
dictionary, and the sizes are added up. The language of the smallest total is
chosen. The margin is the second smallest total less the smallest, over the
text's bytes; a text is rejected when its margin is below a threshold. That is
the `tolerance` quantile of the margins of held-back texts that are named
right: so much of them is given up, and texts as unclear as these go.

Training rows are a bounded sample: about `sample` distinct texts of each
language. A third makes the dictionary (`dict_bytes` in all, from PIECE
characters at a hashed place of each text); the others, whole, set the
threshold on the executors, and only their margins come to the driver.
Languages must be few (each costs one compression of every text).

Defined results: a null text, or one without a letter (category L), has
language `und`, score 0, and is rejected; with no language learned every text
is `und`, with one its margin is that to a size twice as large; an empty table
gives no rows. Equal sizes go to the language first in order, margin 0. Very
long texts are read whole. Repeated rows give repeated results, and count once
in training. Other columns pass through; outputs come in one struct, `out`
(`language` if not named), which takes the place of a column of that name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, drop, fold, materialize, sampled, table

#: Distinct texts of a language, bytes of its dictionary, characters that a text may lend it, bytes of a chunk, and the share of right names that rejection gives up.
SAMPLE, DICT_BYTES, PIECE, CHUNK, TOLERANCE = 1200, 8 << 10, 4096, 512, 0.01
#: Lazy matching with short matches tells languages apart better than a higher level does; tables fit the small window.
SEARCH = {"strategy": zstandard.STRATEGY_LAZY, "min_match": 4, "window_log": 15, "chain_log": 14, "hash_log": 14, "search_log": 3, "target_length": 16}
_WORD = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character of category L is there; `re` also has raised and Roman numbers among word characters."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def letters(text: str) -> bytes:
    """Lower-case letters; whatever stands between them is one space."""
    out = _OTHER.sub(" ", text.lower())
    if not out.isascii() and not out.replace(" ", "").isalpha():
        out = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in out))
    return out.encode()


class Compressors:
    """Per language a compressor with its dictionary; they are made on first use in each worker."""

    def __init__(self, contents: dict[str, bytes], threshold: float = 0.0, chunk: int = CHUNK):
        self.contents, self.threshold, self.chunk, self._made = dict(sorted(contents.items())), threshold, chunk, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def sizes(self, data: bytes) -> list[int]:
        if self._made is None:
            self._made = []
            for content in self.contents.values():
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
                d.precompute_compress(compression_params=how)
                self._made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))
        chunks = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)] or [b""]
        return [sum(len(c.compress(x)) for x in chunks) for c in self._made]

    def name(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        if not text or not self.contents or not has_letter(text):
            return "und", 0.0, 0.0, True
        data = letters(text)
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        least = sizes[best]
        margin = (min([s for i, s in enumerate(sizes) if i != best], default=2 * least) - least) / len(data)
        # Sizes are code lengths: a byte less is a likelihood of 256 times, tempered by the number of chunks.
        per = math.log(2) / max(1.0, len(data) / self.chunk)
        score = 1 / sum(math.exp(min(0.0, (least - s) * per)) for s in sizes)
        return list(self.contents)[best], score, margin, margin < self.threshold


def dictionaries(rows: Sequence[tuple[str, str]], dict_bytes: int = DICT_BYTES, chunk: int = CHUNK) -> Compressors:
    """rows: (language, text). A piece of each text in turn, until a language's dictionary is full."""
    by: dict[str, list[bytes]] = {}
    for lang, text in sorted(rows):
        by.setdefault(lang, []).append(letters(text))
    contents = {}
    for lang, texts in by.items():
        each = max(64, dict_bytes // len(texts))
        pieces, total, part = [], 0, 0
        while total < dict_bytes and any(len(t) > part * each for t in texts):
            for t in texts:
                piece = t[part * each : (part + 1) * each]
                if total < dict_bytes and piece:
                    pieces.append(piece)
                    total += len(piece)
            part += 1
        contents[lang] = b" ".join(pieces)[:dict_bytes]
    return Compressors(contents, 0.0, chunk)


def threshold_of(margins: Sequence[float], tolerance: float = TOLERANCE) -> float:
    """The margin below which a share `tolerance` of texts lies that are named right; 0 without any."""
    return float(np.quantile(margins, tolerance, method="lower")) if len(margins) else 0.0


def train(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, sample: int = SAMPLE, tolerance: float = TOLERANCE) -> Compressors:
    """Learn from rows with a language and a text with a letter (and that `where` keeps)."""
    rows = docs.where(where) if where is not None else docs
    rows = rows.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where(F.col("_text").rlike(r"\p{L}"))
    chosen = materialize(sampled(rows, "_text", F.col("_lang"), sample, 3).select("_group", "_text", "_hash"), "languages")
    third = F.pmod(F.xxhash64("_hash", F.lit(33)), F.lit(3)) == 0
    place = F.pmod(F.xxhash64("_hash", F.lit(7)), F.greatest(F.lit(1), F.char_length("_text") - PIECE + 1)) + 1
    pieces = chosen.select("_group", third.alias("lends"), F.substring(F.col("_text"), place.cast("int"), F.lit(PIECE)).alias("piece")).where(F.col("piece").rlike(r"\p{L}"))
    read = [(r["_group"], r["piece"], r["lends"]) for r in pieces.collect()]
    lent = {g for g, _, lends in read if lends}
    model = dictionaries([(g, piece) for g, piece, lends in read if lends or g not in lent])
    if len(model.contents) > 1:
        held = identify(chosen.where(~third), model, "_text", "_found").select("_group", F.col("_found.lang").alias("lang"), F.col("_found.margin").alias("margin"))
        model.threshold = threshold_of([r["margin"] for r in held.collect() if r["lang"] == r["_group"]], tolerance)
    drop(chosen)
    return model


def identify(docs: DataFrame, model: Compressors, text: str = "text", out: str = "language") -> DataFrame:
    """Add the column `out`: a struct of lang, score, margin and rejected."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang string, score double, margin double, rejected boolean>")
    def named(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for part in parts:
            found = list(zip(*map(own.name, part.to_pylist()), strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], ["lang", "score", "margin", "rejected"])

    # A filter on the result must not be pushed below it, which would compute it twice.
    return docs.withColumn(out, named.asNondeterministic()(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of every document, learned off the fold that is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    out = identify(docs.select("doc_id", "text"), train(docs, where=~held_out))
    return out.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.margin").alias("margin"), F.col("language.rejected").alias("rejected"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that are rejected go, the others get the language found."""
    named = identify(docs, train(docs), out="_found_language").where(~F.col("_found_language.rejected"))
    return named.withColumn("lang", F.col("_found_language.lang")).select(*docs.columns)
