"""JSON texts nested to any depth, read in one pass each.

The built-in parsers refuse what is nested deeper than some thousand levels;
these functions read it like anything else, with a stack instead of recursion.
What the json library's own scanner can read goes through that, which is many
times faster; the results are the same. A text that isn't valid JSON gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = re.compile(r"[ \t\n\r]*+")
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null')
_CLOSES = {"[": "]", "{": "}"}
# What stands for a large answer that is left out, and what a cut text ends with.
OMITTED = '"[omitted large endpoint response for ACE]"'
NOTE = "\n...[truncated for ACE]..."


def events(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in order: `[`, `{`, `]`, `}`, `name` of what follows, `value` for a scalar; a ValueError where the text is no JSON."""
    stack: list[str] = []
    at, want = _BLANK.match(text).end(), "value"  # first: a value or the end of a container that has none yet; next: what follows a value
    while True:
        sign = text[at : at + 1]
        held = stack[-1] if stack else ""
        if want == "next" and not stack:
            if at != len(text):
                raise ValueError(f"more text at {at}")
            return
        if stack and sign == _CLOSES[held] and want in ("first", "next"):
            yield sign, at, at + 1
            stack.pop()
            at, want = at + 1, "next"
        elif want == "next":
            if sign != ",":
                raise ValueError(f"no comma at {at}")
            at, want = at + 1, "name" if held == "{" else "value"
        elif held == "{" and want in ("first", "name"):
            m = _SCALAR.match(text, at) if sign == '"' else None
            colon = _BLANK.match(text, m.end()).end() if m else at
            if m is None or text[colon : colon + 1] != ":":
                raise ValueError(f"no name at {at}")
            yield "name", at, m.end()
            at, want = colon + 1, "value"
        elif sign in ("[", "{"):
            yield sign, at, at + 1
            stack.append(sign)
            at, want = at + 1, "first"
        else:
            m = _SCALAR.match(text, at)
            if m is None:
                raise ValueError(f"no value at {at}")
            yield "value", at, m.end()
            at, want = m.end(), "next"
        at = _BLANK.match(text, at).end()


def written(value: str) -> str:
    """A string as JSON; escaped where it has halves of pairs that no text can hold."""
    text = json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = json.dumps(value)
    return text


class _Unlike(Exception):
    """A text that a tree of it can't be written back from as it reads: equal names, numerals in another spelling."""


def _refused(constant: str):
    raise ValueError(f"no value: {constant}")


def _whole(numeral: str) -> int:
    if numeral == "-0" or len(numeral) > 4000:
        raise _Unlike
    return int(numeral)


def _part(numeral: str) -> float:
    number = float(numeral)
    if repr(number) != numeral:
        raise _Unlike
    return number


_ENCODER = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":"))
_SCAN = json.JSONDecoder(parse_float=str, parse_int=str, parse_constant=_refused).scan_once


def shortener(strings: int, lists: int, dropped: frozenset[str]):
    """shortened() with its limits: by the library's tree where that keeps all that is written, else by the stack."""
    left_out = json.loads(OMITTED)

    def cut(value):
        if type(value) is str:
            own = value.strip()
            return own if len(own) <= strings else own[: strings - 32].rstrip() + NOTE
        return [cut(x) for x in value[:lists]] if type(value) is list else value

    def pairs(found: list[tuple]) -> dict:
        own = {name: left_out if name in dropped else cut(value) for name, value in found}
        if len(own) != len(found):
            raise _Unlike
        return own

    decoder = json.JSONDecoder(object_pairs_hook=pairs, parse_float=_part, parse_int=_whole, parse_constant=_refused)

    def short(text: str) -> str:
        try:
            out = _ENCODER.encode(cut(decoder.decode(text)))
            out.encode()
            return out
        except (_Unlike, RecursionError, UnicodeEncodeError):
            return shortened(text, strings, lists, dropped)

    return short


def shortened(text: str, strings: int, lists: int, dropped: frozenset[str]) -> str:
    """The JSON text with strings cut, lists ended after `lists` values, and what dropped names hold left out."""
    out: list[str] = []
    counts: list[int] = []  # of the values of each open container; names count in objects
    kinds: list[str] = []
    skipped, omit = 0, False  # containers open below a value that is left out; the next value is left out
    for kind, start, end in events(text):
        if skipped:
            skipped += 1 if kind in "[{" else -1 if kind in "]}" else 0
            continue
        if kind in ("]", "}"):
            counts.pop()
            kinds.pop()
            out.append(kind)
            continue
        inside_list = bool(kinds) and kinds[-1] == "["
        if kind == "name":
            name = json.loads(text[start:end])
            out.append(("," if counts[-1] else "") + written(name) + ":")
            counts[-1] += 1
            omit = name in dropped
            if omit:
                out.append(OMITTED)
            continue
        if inside_list:
            counts[-1] += 1
            omit = counts[-1] > lists
            if not omit and counts[-1] > 1:
                out.append(",")
        if omit:
            skipped, omit = int(kind in "[{"), False
            continue
        if kind == "value":
            token = text[start:end]
            if token[0] == '"':
                own = json.loads(token).strip()
                token = written(own if len(own) <= strings else own[: strings - 32].rstrip() + NOTE)
            out.append(token)
        else:
            out.append(kind)
            counts.append(0)
            kinds.append(kind)
    return "".join(out)


def fields_of(text: str, paths: Sequence[Sequence[str]]) -> list[tuple[str, str] | None]:
    """(kind, text) of what each path of names leads to, None where nothing is; strings as they read, containers as JSON. The last of equal names counts, with all that it holds."""
    found: list[tuple[str, str] | None] = [None] * len(paths)
    names: list[str | None] = []  # of the open containers, the name that their current value has
    begins: list[tuple[int, list[int]]] = []  # where each container begins, and the paths that end with it
    for kind, start, end in events(text):
        if kind in ("]", "}"):
            names.pop()
            began, ours = begins.pop()
            for i in ours:
                found[i] = ("object" if kind == "}" else "array", text[began:end])
            continue
        if kind == "name":
            names[-1] = json.loads(text[start:end])
            depth = len(names)
            for i, path in enumerate(paths):  # what an equal name before it held is gone
                if depth <= len(path) and found[i] and all(a == b for a, b in zip(names, path[:depth], strict=True)):
                    found[i] = None
            continue
        depth = len(names)
        ours = [i for i, path in enumerate(paths) if len(path) == depth and all(a == b for a, b in zip(names, path, strict=True))]
        if kind == "value":
            token = text[start:end]
            what = "string" if token[0] == '"' else "null" if token == "null" else "boolean" if token in ("true", "false") else "number"
            for i in ours:
                found[i] = (what, json.loads(token).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if what == "string" else token)
        else:
            names.append(None)  # a list's values have no name
            begins.append((start, ours))
    return found


_NAME = re.compile(r'"((?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"[ \t\n\r]*+:[ \t\n\r]*+')
_KINDS = {'"': "string", "[": "array", "{": "object", "t": "boolean", "f": "boolean", "n": "null"}


def fields_reader(paths: Sequence[Sequence[str]]):
    """fields_of() with its paths: only what leads to a path is read by name, the rest by the library's scanner."""
    new = lambda: ([], {}, [])  # noqa: E731  paths that end here, names below, paths that end here or below
    root = new()
    for i, path in enumerate(paths):
        node = root
        for name in path:
            node = node[1].setdefault(name, new())
            node[2].append(i)
        node[0].append(i)

    def value(text: str, at: int, node: tuple, found: list) -> int:
        sign = text[at : at + 1]
        if sign == "{" and node[1]:
            end, own = members(text, at + 1, node[1], found), None
        else:
            own, end = _SCAN(text, at)
        if node[0]:
            kind = _KINDS.get(sign, "number")
            told = text[at:end] if kind != "string" else own if own.isascii() else own.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
            for i in node[0]:
                found[i] = (kind, told)
        return end

    def members(text: str, at: int, names: dict, found: list) -> int:
        at = _BLANK.match(text, at).end()
        if text[at : at + 1] == "}":
            return at + 1
        while True:
            m = _NAME.match(text, at)
            if m is None:
                raise ValueError(f"no name at {at}")
            name = m[1]
            node = names.get(json.loads(f'"{name}"') if "\\" in name else name)
            if node is None:
                at = _SCAN(text, m.end())[1]
            else:
                for i in node[2]:  # what an equal name before it held is gone
                    found[i] = None
                at = value(text, m.end(), node, found)
            at = _BLANK.match(text, at).end()
            sign = text[at : at + 1]
            if sign == "}":
                return at + 1
            if sign != ",":
                raise ValueError(f"no comma at {at}")
            at = _BLANK.match(text, at + 1).end()

    def read(text: str) -> list[tuple[str, str] | None]:
        found: list[tuple[str, str] | None] = [None] * len(paths)
        try:
            at = value(text, _BLANK.match(text).end(), root, found)
        except StopIteration as stop:
            raise ValueError("no value") from stop
        except RecursionError:
            return fields_of(text, paths)
        if _BLANK.match(text, at).end() != len(text):
            raise ValueError(f"more text at {at}")
        return found

    return read


def _or_none(f, text: str | None):
    try:
        return None if text is None else f(text)
    except ValueError:
        return None


def cut_nested(text: Column, strings: int = 2500, lists: int = 20, dropped: Sequence[str] = ("response_json", "bindings", "results")) -> Column:
    """JSON with its strings trimmed and cut, its lists ended, and large answers left out, at any depth."""
    names = frozenset(dropped)

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array) -> pa.Array:
        short = shortener(strings, lists, names)
        return pa.array([_or_none(short, t) for t in texts.to_pylist()], pa.string())

    return cut(text)


def nested_fields(text: Column, paths: Mapping[str, Sequence[str]]) -> Column:
    """A struct with a (kind, text) struct for each path, all read in one pass; null where the path leads nowhere."""
    field = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
    one = pa.struct([("kind", pa.string()), ("text", pa.string())])
    kind = pa.struct([(name, one) for name in paths])
    wanted = [tuple(p) for p in paths.values()]

    @F.arrow_udf(T.StructType([T.StructField(name, field) for name in paths]))
    def read(texts: pa.Array) -> pa.Array:
        of = fields_reader(wanted)
        found = [_or_none(of, t) for t in texts.to_pylist()]
        fields = []
        for i in range(len(wanted)):
            own = [None if f is None else f[i] for f in found]
            parts = [pa.array([None if f is None else f[k] for f in own], pa.string()) for k in (0, 1)]
            fields.append(pa.StructArray.from_arrays(parts, fields=list(one), mask=pa.array([f is None for f in own], pa.bool_())))
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array([f is None for f in found], pa.bool_()))

    return read(text)
