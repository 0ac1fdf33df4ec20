"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The base patterns find emails, addresses, cards and phones. Beside them, a
lexer proposes candidate segments (runs around `@`, and runs of digits with
the separators people write between them, cut at their parts). The model gives
every set of candidates that don't overlap, with a type for each, the weight
exp(sum of the segments' features and of the types that follow each other).
The features are of the whole span and its surroundings. Dynamic programming
over the candidates gives the sum over all such sets (the partition function),
each segment's marginal probability, and the best set, which chooses
boundaries and types together. Segments of the best set are added, with their
marginal as score, unless they touch a base span.

Its weights maximise the conditional likelihood of a bounded sample (about
`sample` distinct texts that hold a digit or an `@`, WINDOW characters at a
hashed place of each), with a Gaussian prior around PRIOR. The reference
segments are those of the base patterns, and rewritten ones: half of them are
put, before learning, into forms that people write and no base pattern takes
(` (at) ` for `@`, a phone without `+` behind a cue, a card or a phone in other
groups), so that the model learns more than the patterns say. Entities are
bounded: at most MAX_PARTS parts and MAX_SPAN characters.

Offsets are code points, the end exclusive. Defined results: a null text is
empty and has no spans; an empty table gives no rows; with nothing to learn
from, weights are PRIOR. Very long texts are read whole, in time that grows
with the text. Of sets of equal weight the one whose segments end first is
taken. Repeated rows give repeated results, and count once in training. Other
columns pass through; outputs come in one array, `pii`, which takes the place
of a column of that name.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, covers, sampled, table

KINDS = ("email", "ip", "card", "phone")
#: Texts to learn from and characters of each, bounds of an entity, steps of learning, and the precision of the prior.
SAMPLE, WINDOW, MAX_PARTS, MAX_SPAN, STEPS, RIDGE = 800, 1500, 8, 64, 40, 0.5
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]", re.A)
_LOCAL_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", re.A)
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+", re.A)
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.A)
_ANY = re.compile(r"[0-9@]", re.A)
_CLUSTER = re.compile(r"[+(]?[0-9](?:[\x20().+-]{0,2}[0-9])+", re.A)
_PARTS = re.compile(r"[0-9]+", re.A)
_MAILISH = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++", re.A)
_CUE = {"phone": re.compile(r"(?i)(?:phone|tel|call|mobile|cell|fax|ring)\W{0,4}$"), "card": re.compile(r"(?i)(?:card|visa|credit|debit|amex|mastercard)(?: (?:no|number))?\W{0,4}$"), "ip": re.compile(r"(?i)(?:\bip|address|host|server)\W{0,4}$"), "email": re.compile(r"(?i)(?:e-?mail|contact|write to)\W{0,4}$")}

#: What a segment's features say before any data does.
PRIOR = {
    ("email", "form"): 4.0, ("email", "spelled"): 3.0, ("email", "cue"): 1.0, ("email", "bias"): -2.0,
    ("ip", "quad"): 4.0, ("ip", "range"): 2.0, ("ip", "cue"): 1.0, ("ip", "bias"): -4.0,
    ("card", "luhn"): 3.0, ("card", "length"): 2.0, ("card", "groups"): 1.0, ("card", "cue"): 1.5, ("card", "bias"): -4.5,
    ("phone", "plus"): 2.5, ("phone", "length"): 1.5, ("phone", "cue"): 2.5, ("phone", "paren"): 1.0, ("phone", "bias"): -3.6,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start.

    For emails every match has its `@` right after its first run, so the `@`s
    are visited in turn and the run before each is read backwards: the same
    matches as the pattern's, in time linear in the text.
    """
    spans: list[tuple[str, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        low = at
        while low > last and text[low - 1] in _LOCAL_RUN:
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append(("email", low, m.end()))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", at + 1)
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return spans


def candidates(text: str) -> list[tuple[int, int]]:
    """Segments that may be entities, by end; bounded in length and in parts."""
    found = {m.span() for m in _MAILISH.finditer(text) if m.end() - m.start() <= MAX_SPAN} if "@" in text or "at)" in text or "at]" in text else set()
    for cluster in _CLUSTER.finditer(text):
        parts = [m.span() for m in _PARTS.finditer(text, *cluster.span())]
        for i, (low, _) in enumerate(parts):
            if i == 0:
                low = cluster.start()
            elif text[low - 1] in "+(":
                low -= 1
            for j in range(i, min(len(parts), i + MAX_PARTS)):
                high = parts[j][1]
                if high - low > MAX_SPAN:
                    break
                if high - low >= 7:
                    found.add((low, high))
    return sorted(found, key=lambda s: (s[1], s[0]))


def features(text: str, low: int, high: int) -> dict[str, list[str]]:
    """By type, the names of the features that hold for the whole span."""
    span, before, after = text[low:high], text[max(0, low - 24) : low], text[high : high + 2]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.split(r"[^0-9]+", span.strip("+()"))
    out: dict[str, list[str]] = {k: ["bias"] for k in KINDS}
    inside = bool(re.search(r"[A-Za-z0-9@]$", before)) or bool(re.match(r"[A-Za-z0-9@]|[.-][0-9]", after))
    if "@" in span:
        out["email"].append("form")
    elif re.search(r"[\[(](?:at|dot)[\])]", span):
        out["email"].append("spelled")
    else:
        out["email"].append("numeric")
    if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", span):
        out["ip"] += ["quad", "range" if all(map(_byte, span.split("."))) else "over"]
    else:
        out["ip"].append("other")
    plain = re.fullmatch(r"[0-9](?:[ -]?[0-9])+", span) is not None
    out["card"] += [f for f, holds in (("luhn", plain and 13 <= len(digits) <= 19 and luhn(digits)), ("length", plain and 13 <= len(digits) <= 19), ("groups", [len(g) for g in groups] in ([4, 4, 4, 4], [4, 6, 5])), ("other", not plain)) if holds]
    out["phone"] += [f for f, holds in (("plus", span.startswith("+")), ("length", 9 <= len(digits) <= 15), ("paren", bool(re.match(r"\+?[0-9]{0,3}\s?\([0-9]{2,4}\)", span))), ("dots", bool(re.fullmatch(r"[0-9.]+", span))), ("solid", span.isdigit())) if holds]
    for kind in KINDS:
        if _CUE[kind].search(before):
            out[kind].append("cue")
        if inside:
            out[kind].append("inside")
    return out


class Chain:
    """The candidates of a text in order of their ends, and the segmentations that they make."""

    def __init__(self, text: str):
        self.spans = candidates(text)
        ends = [high for _, high in self.spans]
        self.before = [bisect_right(ends, low) for low, _ in self.spans]  # candidates that end where this one may begin
        self.named = [features(text, low, high) for low, high in self.spans]

    def own(self, weights: dict[tuple[str, str], float]) -> np.ndarray:
        """(candidate, type): what the features of a segment weigh."""
        return np.array([[sum(weights.get((k, f), 0.0) for f in named[k]) for k in KINDS] for named in self.named]).reshape(-1, len(KINDS))

    def forward(self, own: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln sums over the segmentations by the first k candidates whose last segment has each type (first: none), and over those that end in candidate k."""
        n = len(self.spans)
        whole = np.full((n + 1, len(KINDS) + 1), -np.inf)
        whole[:, 0] = 0.0
        ending = np.empty((n, len(KINDS)))
        for k, j in enumerate(self.before):
            ending[k] = own[k] + _log_sum(whole[j][:, None] + follow)
            whole[k + 1, 1:] = np.logaddexp(whole[k, 1:], ending[k])
        return whole, ending

    def marginals(self, own: np.ndarray, follow: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(ln partition function, probability of each candidate as each type, expected times that a type follows another)."""
        whole, ending = self.forward(own, follow)
        total = float(_log_sum(whole[-1]))
        share = np.zeros_like(whole)  # how much of the weight of all passes through each sum
        share[-1] = np.exp(whole[-1] - total)
        each, pairs = np.zeros_like(ending), np.zeros_like(follow)
        for k in range(len(self.spans) - 1, -1, -1):
            j = self.before[k]
            with np.errstate(invalid="ignore"):
                each[k] = share[k + 1, 1:] * np.exp(ending[k] - whole[k + 1, 1:])
            share[k] += share[k + 1]
            share[k, 1:] -= each[k]
            came = each[k] * np.exp(whole[j][:, None] + follow + own[k] - ending[k])
            share[j] += came.sum(axis=1)
            pairs += came
        return total, each, pairs

    def best(self, own: np.ndarray, follow: np.ndarray) -> list[tuple[int, int]]:
        """(candidate, type) of the segmentation of the greatest weight."""
        score = np.full(len(KINDS) + 1, -np.inf)
        score[0] = 0.0
        scores, back = [score], []  # of segmentations by the first k candidates; the candidate that ends the best, and the type before
        last: list[list[int]] = [[-1] * (len(KINDS) + 1)]
        for k, j in enumerate(self.before):
            reach = scores[j][:, None] + follow
            came = reach.argmax(axis=0)
            new = own[k] + reach[came, range(len(KINDS))]
            score, at = scores[-1].copy(), list(last[-1])
            for t in np.flatnonzero(new > score[1:]).tolist():
                score[t + 1], at[t + 1] = new[t], k
            back.append(came.tolist())
            scores.append(score)
            last.append(at)
        out, k, t = [], len(self.spans), int(scores[-1].argmax())
        while t:
            at = last[k][t]
            out.append((at, t - 1))
            k, t = self.before[at], back[at][t - 1]
        return out[::-1]


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def following(weights: dict[tuple[str, str], float]) -> np.ndarray:
    """(type before or none, type): what it weighs that one follows the other."""
    return np.array([[weights.get((k, f"after {j}"), 0.0) for k in KINDS] for j in ("", *KINDS)])


def decode(text: str, weights: dict[tuple[str, str], float]) -> list[tuple[str, int, int, float]]:
    """The best segments that don't overlap: type, start, end, and the marginal probability."""
    chain = Chain(text)
    if not chain.spans:
        return []
    own, follow = chain.own(weights), following(weights)
    best = chain.best(own, follow)
    if not best:
        return []
    each = chain.marginals(own, follow)[1]
    return [(KINDS[t], *chain.spans[k], min(1.0, float(each[k, t]))) for k, t in best]


def rewritten(text: str, r: random.Random) -> tuple[str, set[tuple[str, int, int]]]:
    """The text with half of its base spans in forms that no base pattern takes, and all reference segments."""
    out, gold, at, size = [], set(), 0, 0
    for low, high, kind in sorted((s, e, k) for k, s, e in base_spans(text)):
        if low < at:
            continue
        span = text[low:high]
        if r.random() < 0.5:
            if kind == "email":
                left, right = span.split("@", 1)
                span = f"{left}{r.choice((' (at) ', ' [at] ', '(at)'))}{right}" if r.random() < 0.5 else f"{left} (at) {right.replace('.', ' (dot) ')}"
            elif kind == "phone":
                digits = re.sub(r"[^0-9]", "", span)
                span = r.choice((f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}"))
                span = span if text[:low].rstrip().endswith((":", "phone", "call")) else r.choice(("phone: ", "call ", "tel. ")) + span
            elif kind == "card":
                digits = re.sub(r"[^0-9]", "", span)
                span = r.choice(("", "card ", "card no: ")) + " ".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        lead = re.match(r"(?:phone: |call |tel\. |card no: |card )?", span).end()
        out += [text[at:low], span]
        size += low - at
        if len(span) - lead <= MAX_SPAN:
            gold.add((kind, size + lead, size + len(span)))
        size += len(span)
        at = high
    return "".join([*out, text[at:]]), gold


class Likelihood:
    """The penalised conditional log likelihood of reference segmentations, and its gradient."""

    def __init__(self, rows: list[tuple[str, set[tuple[str, int, int]]]]):
        self.rows = []
        for text, gold in rows:
            chain = Chain(text)
            if chain.spans:
                place = {s: k for k, s in enumerate(chain.spans)}
                self.rows.append((chain, sorted((place[s, e], KINDS.index(k)) for k, s, e in gold if (s, e) in place)))
        names = {(k, f) for chain, _ in self.rows for named in chain.named for k in KINDS for f in named[k]}
        names |= {(k, f"after {j}") for k in KINDS for j in ("", *KINDS)} | set(PRIOR)
        self.names = sorted(names)
        number = {f: i for i, f in enumerate(self.names)}
        self.center = np.array([PRIOR.get(f, 0.0) for f in self.names])
        self.follow = np.array([[number[k, f"after {j}"] for k in KINDS] for j in ("", *KINDS)])
        # Per text, the features that hold: candidate, type and feature, one entry each.
        self.held = []
        for chain, _ in self.rows:
            held = [(c, t, number[k, f]) for c, named in enumerate(chain.named) for t, k in enumerate(KINDS) for f in named[k]]
            self.held.append(tuple(np.array(x) for x in zip(*held, strict=True)))

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = -RIDGE / 2 * float(((w - self.center) ** 2).sum()), -RIDGE * (w - self.center)
        follow = w[self.follow]
        for (chain, gold), (c, t, f) in zip(self.rows, self.held, strict=True):
            own = np.zeros((len(chain.spans), len(KINDS)))
            np.add.at(own, (c, t), w[f])
            total, each, pairs = chain.marginals(own, follow)
            observed, before = np.zeros_like(each), 0
            for k, kind in gold:
                observed[k, kind] = 1.0
                value += own[k, kind] + follow[before, kind]
                slope[self.follow[before, kind]] += 1
                before = kind + 1
            value -= total
            slope += np.bincount(f, (observed - each)[c, t], len(w))
            slope -= np.bincount(self.follow.ravel(), pairs.ravel(), len(w))
        return value, slope


def learn(texts: list[str], steps: int = STEPS) -> dict[tuple[str, str], float]:
    """Weights of the greatest penalised conditional likelihood, by steps that grow while a slope keeps its sign."""
    r = random.Random(8)
    target = Likelihood([rewritten(t, r) for t in texts if _ANY.search(t)])
    if not target.rows:
        return dict(PRIOR)
    w, size, last = target.center.copy(), np.full(len(target.names), 0.1), np.zeros(len(target.names))
    best, kept = -np.inf, w
    for _ in range(steps):
        value, slope = target.at(w)
        if value > best:
            best, kept = value, w.copy()
        same = np.sign(slope) * np.sign(last)
        size = np.clip(np.where(same > 0, size * 1.3, np.where(same < 0, size * 0.5, size)), 1e-4, 1.0)
        last = np.where(same < 0, 0.0, slope)
        w = w + np.sign(last) * size
    return dict(zip(target.names, kept.tolist(), strict=True))


def find(text: str | None, weights: dict[tuple[str, str], float]) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base?, score) by kind, then start: base spans, and segments that touch none."""
    text = text or ""
    if not _ANY.search(text) and "at)" not in text and "at]" not in text:
        return []
    base = base_spans(text)
    starts, ends = covers([(s, e) for _, s, e in base])
    touches = lambda s, e: (i := bisect_left(starts, e)) and ends[i - 1] > s
    added = [(k, s, e, False, p) for k, s, e, p in decode(text, weights) if not touches(s, e)]
    return sorted([*((*s, True, 1.0) for s in base), *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict[tuple[str, str], float]:
    """Weights from WINDOW characters each of about `sample` distinct texts that hold a digit or an `@`."""
    rows = sampled(docs.select(F.col(text).alias("_text")).where(F.col("_text").rlike("[0-9@]")), "_text", F.lit(1), sample, 8)
    place = F.pmod(F.xxhash64("_text", F.lit(7)), F.greatest(F.lit(1), F.char_length("_text") - WINDOW + 1)) + 1
    return learn(sorted(r[0] for r in rows.select(F.substring(F.col("_text"), place.cast("int"), F.lit(WINDOW))).collect()))


def find_pii(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Add `pii`: an array of (kind, start, end, base, score) over the whole text."""
    bound_batches(docs.sparkSession)
    weights = fit(docs, text, sample)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<kind string, start long, end long, base boolean, score double>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "end": e, "base": b, "score": p} for k, s, e, b, p in find(t.as_py(), weights)] for t in texts], kind)

    return docs.withColumn("pii", spans(F.col(text)))


def redact_pii(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Replace every span of the text by its kind in brackets; null stays null."""
    bound_batches(docs.sparkSession)
    weights = fit(docs, text, sample)

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([None if t is None else redact(t, weights) for t in part.to_pylist()], pa.string())

    return docs.withColumn(text, clean(F.col(text)))


def redact(text: str, weights: dict[tuple[str, str], float]) -> str:
    out, at = [], 0
    for low, high, kind in sorted((s, e, k) for k, s, e, _, _ in find(text, weights)):
        if low >= at:
            out += [text[at:low], f"[{kind.upper()}]"]
        at = max(at, high)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: counts and digests of the spans of every document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: every document stays, its personal data does not; n_chars follows the text."""
    clean = redact_pii(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*docs.columns)
