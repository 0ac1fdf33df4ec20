"""Secret scan: fixed patterns, and an assignment-aware lexer.

The base patterns find assignments, access keys and hex runs. The lexer reads
source and configuration syntax as pairs of a name and the literals that it
gets: `name = value` with any of `=`, `:`, `:=`, `=>`, where the name may be
plain, quoted, dotted or a subscript (`cfg["name"] = ...`); call arguments
(`set_name("value")`, `put("name", "value")`); elements (`<name>value</name>`,
`<key>name</key><string>value</string>`); and indented blocks (`name: |`).
Values are strings with prefixes, plain, raw or triple-quoted, escapes decoded;
bare values; or names, joined by `+`. A table of constants carries a literal
that is stored under a harmless name on to a sensitive one. A name that no
constant has is no literal in source; it is one in configuration, a block of
lines that are all `name = value`, section headings, items or comments. What
stands in comments is read as well.

A literal's score is the sensitivity of the target name times the quality of
the whole value; spans of literals that score `threshold` or more are added as
kind `literal`, unless a base span holds them. A constant is a sum that keeps
its parts, its length and how often each character occurs, not its text, so
sums of sums cost no more than what is written down; sums of more than JOINED
characters are judged by these alone, not held against placeholders. Names,
blanks, literals and bare values may be of any length; they are read without
backtracking.

Offsets are code points, the end exclusive. Defined results: a null text is
empty and has no spans; an empty table gives no rows; very long texts are read
whole, in time that grows with the text; literals that several targets reach
count once; repeated rows give repeated results. Other columns pass through;
outputs come in one array, `secrets`, which takes the place of a column of that
name.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, covers, table

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
_HEX = re.compile(r"[0-9a-f]{16,}", re.A)
_HINT = re.compile(r"(?i:passw|secret|token|api_?key)", re.A)

#: Words of a name, alone or in pairs, and how sensitive they make it.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "api key": 1.0, "access key": 1.0, "private key": 1.0, "signing key": 0.9, "encryption key": 0.9, "client secret": 1.0, "connection string": 0.8}
_PLACEHOLDER = re.compile(r"(?i)^(?:change_?me|example|placeholder|none|null|true|false|todo|your[_-].*|x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w+.*)$")
_BLANKS = frozenset(" \t\n\r\f\v")
_NAMED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
#: Characters of a sum up to which its text is kept.
JOINED = 4096
_STRING = r"""[rRbBfFuU]{0,2}(?:"{3}((?:[^"\\]++|\\.|"(?!""))*+)"{3}|'{3}((?:[^'\\]++|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)')"""
#: A part of a value: a string (groups 1 to 4), a name (5) or a bare value (6).
_PART = re.compile(rf"\s*+(?:{_STRING}|([A-Za-z_][A-Za-z0-9_.]*+)(?![A-Za-z0-9_.+/=-])|([A-Za-z0-9+/_.=-]++))", re.A | re.S)
_CALL = re.compile(rf"(?<![A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_.]*+)\(\s*+{_STRING}(?:\s*+,\s*+{_STRING})?+", re.A | re.S)
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)(?:\s[^<>]*+)?+>\s*+([^<>\s][^<>]*+)</\1>", re.A)
_PAIR = re.compile(r"<key>([^<>]*+)</key>\s*+<string>([^<>]*+)</string>", re.A)
_BLOCK = re.compile(r"[ \t]*+[|>][-+]?+[ \t]*+\n")
_SETTING = re.compile(r"""\s*+(?:$|[#;\[].*+|//.*+|-\s.*+|(?:export\s++)?+["']?+[A-Za-z_][A-Za-z0-9_.-]*+["']?+[ \t]*+[:=](?:[ \t]*+(?:"[^"\n]*+"|'[^'\n]*+'|[^\s()\[\]{}"';]*+))[ \t]*+,?+$)""", re.A)
_ESCAPE = re.compile(r"\\(.)", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
_PLUS = re.compile(r"[ \t]*+\+")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in order of start, then kind."""
    spans = []
    if _HINT.search(text):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=_order)


def _order(span: tuple[int, int, str]) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def sensitivity(name: str) -> float:
    """Of the words in a name (snake, kebab, dotted or camel case), 0 to 1."""
    words = [w.lower() for w in _WORD.findall(name)]
    return max([0.0, *(SENSITIVE.get(w, 0) for w in words), *(SENSITIVE.get(f"{a} {b}", 0) for a, b in zip(words, words[1:], strict=False))])


class Value:
    """A literal, or a sum of values."""

    def __init__(self, text: str | None, length: int, counts: Counter, span: tuple[int, int] | None = None, parts: tuple["Value", ...] = ()):
        self.text, self.length, self.counts, self.span, self.parts = text, length, counts, span, parts

    @classmethod
    def literal(cls, text: str, span: tuple[int, int]) -> "Value":
        return cls(text, len(text), Counter(text), span)

    def plus(self, other: "Value") -> "Value":
        text = self.text + other.text if self.text is not None and other.text is not None and self.length + other.length <= JOINED else None
        return Value(text, self.length + other.length, self.counts + other.counts, None, (self, other))

    def spans(self, seen: set[int]) -> Iterator[tuple[int, int]]:
        """The literals below, each once; `seen` has the values that were walked before."""
        stack = [self]
        while stack:
            v = stack.pop()
            if id(v) not in seen:
                seen.add(id(v))
                stack += v.parts
                if v.span is not None:
                    yield v.span

    def quality(self) -> float:
        """How much the value looks like key material, 0 to 1."""
        if self.length < 8 or self.text is not None and _PLACEHOLDER.match(self.text) or any(c.isspace() for c in self.counts):
            return 0.0
        entropy = -sum(c / self.length * math.log2(c / self.length) for c in self.counts.values())
        signs = "".join(self.counts)
        kinds = sum(bool(re.search(p, signs)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return min(1.0, entropy / 4) * (1.0 if kinds >= 2 else 0.6 if self.length >= 20 else 0.4)


def quality(value: str) -> float:
    return Value.literal(value, (0, len(value))).quality()


def decoded(raw: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPED.get(m[1], m[1]), raw) if "\\" in raw else raw


def string_of(m: re.Match, first: int) -> tuple[str, tuple[int, int]] | None:
    """The decoded string and its span, of four groups from `first` on."""
    for k in range(first, first + 4):
        if m[k] is not None:
            return decoded(m[k]), m.span(k)
    return None


def target_before(text: str, low: int, end: int) -> str | None:
    """The name, plain, quoted or a subscript, that stands before `end` and any blanks; read backwards, not beyond `low`."""
    while end > low and text[end - 1] in _BLANKS:
        end -= 1
    if end > low and text[end - 1] == "]":
        end -= 1
        while end > low and text[end - 1] in _BLANKS:
            end -= 1
        if not (end > low and text[end - 1] in "\"'"):
            return None
    quote = text[end - 1] if end > low and text[end - 1] in "\"'" else ""
    end -= len(quote)
    start = end
    while start > low and text[start - 1] in _NAMED:
        start -= 1
    if quote and text[max(low, start - 1) : start] != quote:
        return None
    while not quote and start < end and not (text[start].isalpha() or text[start] == "_"):
        start += 1
    return text[start:end] if start < end and (text[start].isalpha() or text[start] == "_") else None


def settings(text: str) -> list[tuple[int, int]]:
    """The blocks of lines that are all configuration, in order."""
    found, at, start, good = [], 0, 0, True
    for line in [*text.split("\n"), ""]:
        if not line.strip():
            if good and at > start:
                found.append((start, at))
            start, good = at + len(line) + 1, True
        elif good:
            good = _SETTING.fullmatch(line) is not None
        at += len(line) + 1
    return found


def assignments(text: str) -> Iterator[tuple[str, Value | None, str]]:
    """(target name, value, syntax), constants propagated, in order of the assignments; then calls and elements. No value is known of what is set to something else than literals."""
    constants: dict[str, Value] = {}
    blocks = None
    last = 0
    for m in re.finditer(r":=|=>|[=:]", text):
        if m.start() < last or text[m.end() : m.end() + 1] == "=" or text[m.start() - 1 : m.start()] in ("=", "!", "<", ">"):
            continue
        target = target_before(text, last, m.start())
        if target is None:
            continue
        block = _BLOCK.match(text, m.end()) if m[0] == ":" else None
        if block:
            at, deep = block.end(), None
            while at < len(text):
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                line = text[at:end]
                bare = line.strip()
                indent = len(line) - len(line.lstrip())
                deep = indent if deep is None and bare else deep
                if bare and (not indent or indent < deep):
                    break
                if bare:
                    yield target, Value.literal(bare, (at + indent, at + indent + len(bare))), "block"
                at = end + 1
            last = max(m.end(), min(at, len(text)))
            continue
        value, at, end, whole = None, m.end(), m.end(), True
        while part := _PART.match(text, at):
            own = string_of(part, 1)
            if own is not None:
                more = Value.literal(*own)
            elif part[6] is not None:
                more = Value.literal(part[6], part.span(6))
            else:
                more = constants.get(part[5])
                if more is None and value is None and part[5] != target and not text.startswith(("(", "["), part.end()):
                    if blocks is None:
                        blocks = settings(text)
                        starts = [a for a, _ in blocks]
                    i = bisect_right(starts, m.start())
                    if i and m.start() < blocks[i - 1][1]:
                        more = Value.literal(part[5], part.span(5))
                if more is None:
                    whole = False
                    break
            value, at = more if value is None else value.plus(more), part.end()
            end = at
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if not whole:
            constants.pop(target, None)
            last = max(last, end)
            yield target, None, "assignment"
        elif value is not None:
            last = end
            constants[target] = value
            yield target, value, "assignment"
    for m in _CALL.finditer(text):
        first, second = string_of(m, 2), string_of(m, 6)
        if second is None:
            yield m[1], Value.literal(*first), "call"
        else:
            yield first[0], Value.literal(*second), "call"
    if "</" in text:
        for pattern in (_ELEMENT, _PAIR):
            for m in pattern.finditer(text):
                bare = m[2].rstrip()
                yield m[1], Value.literal(bare, (m.start(2), m.start(2) + len(bare))), "element"


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """All spans of a text: base ones, then literals that the lexer scores as secret."""
    text = text or ""
    base = base_spans(text)
    added: set[tuple[int, int, str]] = set()
    seen: set[int] = set()
    kept = []  # values that were walked stay, so that their names aren't given again
    starts, ends = covers([(a, b) for a, b, _ in base])
    held = lambda s, e: (i := bisect_right(starts, s)) and ends[i - 1] >= e
    for name, value, _ in assignments(text):
        weight = sensitivity(name) if value else 0
        if weight and weight * value.quality() >= threshold:
            kept.append(value)
            added |= {(s, e, "literal") for s, e in value.spans(seen) if e > s and not held(s, e)}
    return sorted([*base, *added], key=_order)


def scan_secrets(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add `secrets`: an array of (kind, start, end) over the whole text."""
    bound_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind string, start long, end long>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in scan(t.as_py(), threshold)] for t in texts], kind)

    return docs.withColumn("secrets", spans(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: counts and digests of the spans of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count("literal"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """The contract's digest, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
