"""URL filter: rules first, then a ratio of two character language models.

`allow` and `block` rules name a host and a path prefix. A rule fits its host
and all subdomains if the path starts with the rule's path; the longest rule
wins. URLs that no rule fits are judged by two smoothed variable-order Markov
models over bytes, one of accepted and one of rejected URLs (those that the
rules decide). The score is the difference of the log-likelihoods divided by
the length; its threshold is calibrated on URLs that the models did not see.

All different URLs that the rules decide, read whole, are learned from, but
for every fifth of a class in order, which calibrate the threshold. Counts of
bytes after contexts are summed over all tasks; what comes to the driver are
the models themselves, whose size is bounded by the contexts of `order` bytes
that URLs have, and the held-back scores counted in BINS bins.

Ties: of rules of equal length that fit, the one named last wins; a score at
the threshold allows. Very long URLs are scored whole.

Defined results: a null URL, or one without `://`, has an empty host and path
and no rule; a null URL is scored as the empty text (score 0). Repeated rows
give repeated results. Without training URLs of both classes every score is 0
and the threshold 0, so the verdict is `allow`; an empty table gives no rows.
Other columns pass through, also those named like an output: outputs come in
one struct, `judged`, which takes the place of a column of that name.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, drop, materialize, table

#: (verdict, host/path) of the query's contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Bytes of a context, of how many URLs one is held back for the threshold, bins of their scores, and counts that a task holds at most.
ORDER, HELD_BACK, BINS, HELD_COUNTS = 4, 5, 1 << 16, 1 << 20
_END = 256


class MarkovModel:
    """Bytes after contexts of 0 to `order` bytes, interpolated as Witten and Bell do."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = defaultdict(dict)

    def learn(self, text: bytes) -> None:
        for i in range(len(text) + 1):
            symbol = text[i] if i < len(text) else _END
            for k in range(min(self.order, i) + 1):
                after = self.counts[text[i - k : i]]
                after[symbol] = after.get(symbol, 0) + 1

    def probability(self, context: bytes, symbol: int) -> float:
        p = 1 / 257
        for k in range(len(context) + 1):
            after = self.counts.get(context[len(context) - k :])
            if not after:
                break
            kinds = len(after)
            p = (after.get(symbol, 0) + kinds * p) / (sum(after.values()) + kinds)
        return p


class UrlRatio:
    """log P(accepted) - log P(rejected), per byte, with a threshold."""

    def __init__(self, accepted: MarkovModel, rejected: MarkovModel, threshold: float = 0.0):
        self.accepted, self.rejected, self.threshold, self.seen = accepted, rejected, threshold, {}

    def score(self, url: str | None) -> float:
        text = (url or "").encode()
        if not text or not self.accepted.counts or not self.rejected.counts:
            return 0.0
        total, order, seen = 0.0, self.accepted.order, self.seen
        if len(seen) > 500_000:
            seen.clear()
        for i in range(len(text) + 1):
            key = (text[max(0, i - order) : i], text[i] if i < len(text) else _END)
            step = seen.get(key)
            if step is None:
                step = seen[key] = math.log(self.accepted.probability(*key)) - math.log(self.rejected.probability(*key))
            total += step
        return total / (len(text) + 1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}


def fit(accepted: Sequence[str], rejected: Sequence[str], order: int = ORDER) -> UrlRatio:
    """Learn both models; choose the threshold on every fifth URL, which they do not learn."""
    models, held = (MarkovModel(order), MarkovModel(order)), []
    for model, label, urls in ((models[0], 1, accepted), (models[1], 0, rejected)):
        for i, url in enumerate(sorted(urls)):
            if i % HELD_BACK:
                model.learn(url.encode())
            else:
                held.append((url, label))
    ratio = UrlRatio(*models)
    if not (models[0].counts and models[1].counts):
        return ratio
    scores, at = np.unique([ratio.score(url) for url, _ in held], return_inverse=True)
    labels = np.array([label for _, label in held])
    counts = [np.bincount(at[labels == label], minlength=len(scores)) for label in (1, 0)]
    ratio.threshold = best_cut(scores, scores, *counts)
    return ratio


def best_cut(least: np.ndarray, most: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> float:
    """The cut, 0 or between two bins of scores, with the best balance of both classes; the nearest to 0 of equal ones. Bins in order, with their least and greatest score and counts."""
    cuts = np.concatenate([[0.0], (least[1:] + most[:-1]) / 2])
    cuts = cuts[np.argsort(np.abs(cuts), kind="stable")]
    below = np.searchsorted((least + most) / 2, cuts)
    share = lambda counts: np.concatenate([[0], np.cumsum(counts)])[below] / max(1, counts.sum())
    return float(cuts[int(np.argmax((1 - share(accepted)) + share(rejected)))])


def _counted(order: int):
    """Counts of (verdict, context, symbol) of a task's URLs, given out whenever HELD_COUNTS are held."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            verdicts, contexts, symbols = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(verdicts), pa.array(contexts, pa.binary()), pa.array(symbols, pa.int32()), pa.array(list(held.values()), pa.int64())], names=["verdict", "context", "symbol", "n"])

        for batch in batches:
            for verdict, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = url.encode()
                for i in range(len(text) + 1):
                    symbol = text[i] if i < len(text) else _END
                    for k in range(min(order, i) + 1):
                        held[verdict, text[i - k : i], symbol] += 1
                if len(held) > HELD_COUNTS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return count


def fit_all(labelled: DataFrame, order: int = ORDER) -> UrlRatio:
    """fit() of all different URLs of a table (_url, _verdict), wherever they are."""
    spark = labelled.sparkSession
    urls = labelled.where("_url is not null and _verdict is not null").distinct()
    urls = materialize(urls.repartitionByRange("_verdict", "_url").withColumn("_part", F.spark_partition_id()), "op5-urls")
    sizes, starts = defaultdict(int), []
    for r in sorted(urls.groupBy("_verdict", "_part").count().collect()):  # two for each task
        starts.append((r["_verdict"], r["_part"], sizes[r["_verdict"]]))
        sizes[r["_verdict"]] += r["count"]
    models = {"allow": MarkovModel(order), "block": MarkovModel(order)}
    ratio = UrlRatio(models["allow"], models["block"])
    if len(sizes) == 2:
        start = F.broadcast(spark.createDataFrame(starts, "_verdict string, _part int, _start long"))
        place = F.row_number().over(Window.partitionBy("_verdict", "_part").orderBy("_url")) - 1 + F.col("_start")
        placed = urls.join(start, ["_verdict", "_part"]).select("_verdict", "_url", (place % HELD_BACK == 0).alias("held"))
        counts = placed.where("not held").select("_verdict", "_url").mapInArrow(_counted(order), "verdict string, context binary, symbol int, n long")
        counted = counts.groupBy("verdict", "context", "symbol").agg(F.sum("n").alias("n")).toArrow()
        for batch in counted.to_batches():
            for verdict, context, symbol, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                models[verdict].counts[context][symbol] = n
        if models["allow"].counts and models["block"].counts:
            shared = spark.sparkContext.broadcast(ratio)
            held = materialize(placed.where("held").select("_verdict", _score(shared)("_url")["score"].alias("score")), "op5-held")
            ends = held.agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
            width = max((ends["b"] - ends["a"]) / BINS, 1e-300)
            of = lambda v: F.count_if(F.col("_verdict") == v)
            bins = held.groupBy(F.floor((F.col("score") - ends["a"]) / width).alias("bin")).agg(F.min("score").alias("least"), F.max("score").alias("most"), of("allow").alias("accepted"), of("block").alias("rejected"))
            rows = sorted(bins.collect())
            ratio.threshold = best_cut(*(np.array([r[c] for r in rows]) for c in ("least", "most", "accepted", "rejected")))
            drop(held)
    drop(urls)
    return ratio


def _score(shared: Broadcast):
    @F.arrow_udf("struct<score double, threshold double>")
    def ratio(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for urls in parts:
            scores = pa.array([model.score(u) for u in urls.to_pylist()], pa.float64())
            yield pa.StructArray.from_arrays([scores, pa.array([model.threshold] * len(urls), pa.float64())], ["score", "threshold"])

    return ratio


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        at, slash, below = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """Add `judged`: a struct of host, path, rule, verdict, score and threshold."""
    spark = pages.sparkSession
    bound_batches(spark)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    _, verdict = rule_of(host, path, rules)
    labelled = pages.select(F.col(url).alias("_url"), verdict.alias("_verdict")).where(F.col("_url").isNotNull())
    ratio = _score(spark.sparkContext.broadcast(fit_all(labelled, order)))

    rule, verdict = rule_of(F.col("_judged_parts.host"), F.col("_judged_parts.path"), rules)
    out = pages.withColumn("_judged_parts", F.struct(host.alias("host"), path.alias("path"), ratio(F.col(url)).alias("ratio")))
    by_model = F.when(F.col("_judged_parts.ratio.score") >= F.col("_judged_parts.ratio.threshold"), "allow").otherwise("block")
    judged = F.struct(F.col("_judged_parts.host").alias("host"), F.col("_judged_parts.path").alias("path"), rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), F.col("_judged_parts.ratio.score").alias("score"), F.col("_judged_parts.ratio.threshold").alias("threshold"))
    return out.withColumn("judged", judged).drop("_judged_parts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every page's url against the contract's rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", F.col("judged.score").alias("score"))
