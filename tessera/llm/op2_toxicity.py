"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

A text is brought to lower-case letters and cut into overlapping windows. The
library's trainer makes both dictionaries: the ordinary one from all windows of
ordinary documents, the toxic one from windows of toxic documents. Most windows
of a toxic document are ordinary, so the toxic dictionary is trained in ROUNDS:
first on all its windows, then on those alone that it shortens by as many bytes
as sets them best apart from windows of ordinary documents that trained
nothing. Whole windows are chosen, by compression lengths; no words are. In
front of the ordinary content, so that the two differ by what is typical of
toxic text alone, the toxic one's content gives the toxic side. A window's
distance is the bytes that the toxic side saves over the ordinary one.
Thresholds on the distances give the features of a text (shares and counts of
windows beyond each, the mean and the largest), and a logistic calibration on
texts that trained no dictionary weighs them.

Training rows are a bounded sample: about `sample` labelled documents of each
class, and at most PIECE characters, at a hashed place, of each. Labels,
language, source and ids are no inputs of a score.

Defined results: null and empty texts have no window beyond any threshold and
get the score of that; without training rows of both classes every score is 0;
with windows too few for the trainer they are taken raw. Where a document has
several labels the highest counts. Very long texts are scored whole. Repeated
rows give repeated results, and texts count once in training; an empty table
gives no rows. Other columns pass through; the output takes the place of a
column of its name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, fold, sampled, table
from tessera.llm.op3_language_id import letters

#: Labelled documents of a class and characters of each, bytes of a window and between windows, and saved bytes that count.
SAMPLE, PIECE, WINDOW, STEP, CUTS = 3000, 16_384, 80, 64, (2, 3, 4, 6)
#: Bytes of the dictionaries, the trainer's segments and the strings it counts, and rounds of training the toxic one.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, COUNTED, ROUNDS = 100_000, 8000, (16, 12), 6, 3
#: Bytes at the head of a trained dictionary that are tables of codes rather than content.
TABLES = 160
#: As for languages, with tables for the larger dictionary.
SEARCH = {"strategy": zstandard.STRATEGY_LAZY, "min_match": 4, "window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 4, "target_length": 16}


def windows(text: str | None) -> list[bytes]:
    data = letters(text or "")
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP)]


class Distances:
    """Both dictionaries; the compressors are made on first use in each worker."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.weights, self._made = ordinary, toxic, None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def between(self, parts: Sequence[bytes]) -> np.ndarray:
        """Of each window, the bytes that the toxic side saves."""
        if self._made is None:
            self._made = [_compressor(self.ordinary), _compressor(self.toxic + self.ordinary)]
        plain, toxic = self._made
        return np.array([len(plain(w)) - len(toxic(w)) for w in parts], np.float64)

    def of(self, text: str | None) -> np.ndarray:
        return self.between(windows(text))

    def features(self, text: str | None) -> list[float]:
        d = np.sort(self.of(text))[::-1]
        n = len(d)
        beyond = [int((d >= c).sum()) for c in CUTS]
        return [1.0, d.mean(), d[0], d[:3].mean(), *(b / n for b in beyond), *(math.log1p(b) for b in beyond), math.log(n), d.mean() * math.sqrt(n)]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, self.features(text)))))))


def _compressor(content: bytes):
    how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress


def trained(samples: Sequence[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that the library trains on samples; the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(size, list(samples), k=segment, d=COUNTED).as_bytes()[TABLES:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def toxic_content(toxic: Sequence[bytes], ordinary: bytes, held: Sequence[bytes], rounds: int = ROUNDS) -> bytes:
    """Train on windows of toxic documents, then on those alone that the dictionary sets apart from `held` ordinary windows."""
    chosen = list(toxic)
    for left in reversed(range(rounds)):
        content = trained(chosen, TOXIC_BYTES, SEGMENT[1])
        if not left or not held:
            return content
        model = Distances(ordinary, content)
        near, far = model.between(toxic), model.between(held)
        cuts = np.arange(1, max(2, int(near.max()) + 1))
        a, b = ((d[None, :] >= cuts[:, None]).mean(axis=1) for d in (near, far))
        cut = int(cuts[np.argmax((a - b) / np.sqrt(a + b + 1e-4))])
        chosen = [w for w, d in zip(toxic, near, strict=True) if d >= cut] or chosen
    return b""


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic model with a small ridge, by Newton's method with halved steps; the first column is the constant."""
    scale = x.std(axis=0)
    z = x / np.where(scale > 1e-6, scale, np.maximum(1.0, np.abs(x).max(axis=0)))
    ridge = np.array([1e-6, *[1.0] * (x.shape[1] - 1)])
    worth = lambda b: float((weight * (y * (z @ b) - np.logaddexp(0, z @ b))).sum() - (ridge * b * b).sum() / 2)
    beta = np.zeros(x.shape[1])
    at = worth(beta)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve(z.T @ ((weight * p * (1 - p))[:, None] * z) + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * beta)
        size = 1.0
        while worth(beta + size * step) < at and size > 1e-6:
            size /= 2
        new = worth(beta + size * step)
        if new <= at + 1e-9:
            break
        beta, at = beta + size * step, new
    return beta / np.where(scale > 1e-6, scale, np.maximum(1.0, np.abs(x).max(axis=0)))


def fit(toxic: Sequence[str], ordinary: Sequence[str], prior: float = 0.5) -> Distances:
    """Two thirds train the dictionaries, the rest the calibration at the given share of toxic documents."""
    toxic, ordinary = sorted(toxic), sorted(ordinary)
    split = lambda rows, own: [t for i, t in enumerate(rows) if (i % 3 == 0) is own]
    if len(toxic) < 3 or len(ordinary) < 3:
        return Distances(b"", b"")
    cut = lambda rows: [w for t in rows for w in windows(t)]
    plain = trained(cut(split(ordinary, False)), ORDINARY_BYTES, SEGMENT[0])
    model = Distances(plain, toxic_content(cut(split(toxic, False)), plain, cut(split(ordinary, True))))
    held = [(t, 1) for t in split(toxic, True)] + [(t, 0) for t in split(ordinary, True)]
    x, y = np.array([model.features(t) for t, _ in held]), np.array([v for _, v in held], float)
    weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum())) * len(y)
    model.weights = logistic(x, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, key: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, prior: float | None = None) -> Distances:
    """Learn from about `sample` labelled documents of each class.

    Ids are sampled from the labels alone; the join then reads the texts of
    those few ids, whose number is bounded, so it is a broadcast.
    """
    rows = labels.select(F.col(key).alias("_key"), F.col(toxic).cast("int").alias("_toxic")).where(F.col("_toxic").isin(0, 1) & F.col("_key").isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("_key").agg(F.max("_toxic").alias("_toxic"))
    chosen = sampled(rows, "_key", F.col("_toxic"), sample, 2).select("_key", "_toxic").collect()
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "_key long, _toxic int")
    place = F.pmod(F.xxhash64("_text", F.lit(7)), F.greatest(F.lit(1), F.char_length("_text") - PIECE + 1)) + 1
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").where(F.col("_text").isNotNull())
    found = found.select("_toxic", F.substring(F.col("_text"), place.cast("int"), F.lit(PIECE)).alias("piece")).distinct().collect()
    texts = [[r["piece"] for r in found if r["_toxic"] == k] for k in (0, 1)]
    if prior is None:
        total = rows.agg(F.avg("_toxic")).first()[0] or 0.5
        prior = math.sqrt(total / 2)  # between the share that is toxic and a half: misses weigh more than false alarms
    return fit(texts[1], texts[0], prior)


def score_toxicity(docs: DataFrame, model: Distances, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add the column `out`, 0 to 1."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for part in parts:
            yield pa.array([own.score(t) for t in part.to_pylist()], pa.float64())

    return docs.withColumn(out, score(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's score, learned off the fold that is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), where=fold("_key", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
