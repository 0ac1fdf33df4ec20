"""Graph-pattern queries as DataFrame plans over a table of triples.

triples(s, p, o): strings; an IRI is written as in the query's prefixes or in
full. A query is parsed to a small tree and compiled to joins, filters and
aggregates: each triple pattern is a scan with its constants pushed down,
patterns are joined on shared variables, the most constant ones first and
connected ones next, so Catalyst sees equi-joins only. OPTIONAL is a left
join, [NOT] EXISTS a semi or anti join, MINUS an anti join on what both sides
bind, UNION a union by name. A property path is a table of pairs: sequences are
joins, alternatives unions, and repeats are closed by rounds over the pairs that
the round before found, from a constant end if there is one.

Supported: SELECT and ASK; DISTINCT; expressions with AS; triples with `;`,
`,` and `a`; paths with `/`, `|`, `^`, `*`, `+`, `?`; OPTIONAL, MINUS, UNION, FILTER, [NOT] EXISTS, BIND, VALUES, sub-SELECT;
GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET; COUNT, SUM, AVG, MIN, MAX, SAMPLE,
GROUP_CONCAT. An error in an expression is null, so a filter drops the row.
Patterns that share no variable are refused unless one side is a single row.
CONSTRUCT and DESCRIBE raise Unsupported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import PREFIXES

_LEX = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w-]*:[\w.-]*\w|[A-Za-z_][\w-]*:)|(?P<word>[A-Za-z_]\w*)|(?P<op>&&|\|\||!=|<=|>=|\^\^|[=<>!+\-*/(){},;.@^|?])"""
)
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class Unsupported(ValueError):
    pass


@dataclass
class Group:
    triples: list[tuple[str, str, str]] = field(default_factory=list)
    parts: list[tuple] = field(default_factory=list)  # (kind, ...) in order
    filters: list[tuple] = field(default_factory=list)


@dataclass
class Select:
    form: str = "SELECT"
    distinct: bool = False
    project: list[tuple[str, tuple | None]] = field(default_factory=list)  # (name, expression); empty is *
    body: Group = field(default_factory=Group)
    by: list[tuple[str, tuple | None]] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order: list[tuple[bool, tuple]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.fresh = 0, {v: k for k, v in PREFIXES.items()}, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1].upper() if self.at + k < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        if wanted and self.peek() not in wanted:
            raise ValueError(f"expected {' or '.join(wanted)}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def skip(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def query(self) -> Select:
        while self.peek() in ("PREFIX", "BASE"):
            if self.take().upper() == "PREFIX":
                name = self.take()
                self.prefixes[self.take()[1:-1]] = name[:-1]
            else:
                self.take()
        if self.peek() not in ("SELECT", "ASK"):
            raise Unsupported(f"form {self.peek()}")
        out = self.select()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.peek()}")
        return out

    def select(self) -> Select:
        q = Select(form=self.take("SELECT", "ASK").upper())
        if q.form == "SELECT":
            q.distinct = self.skip("DISTINCT") or self.skip("REDUCED")
            if not self.skip("*"):
                while self.kind() == "var" or self.peek() == "(":
                    q.project.append(self.named())
        self.skip("WHERE")
        q.body = self.group()
        while self.peek() in ("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET"):
            word = self.take().upper()
            if word == "GROUP":
                self.take("BY")
                while self.kind() == "var" or self.peek() == "(":
                    q.by.append(self.named())
            elif word == "HAVING":
                while self.peek() == "(":
                    q.having.append(self.primary())
            elif word == "ORDER":
                self.take("BY")
                while self.kind() in ("var", "word") and self.peek() not in ("LIMIT", "OFFSET", "HAVING") or self.peek() == "(":
                    down = self.skip("DESC")
                    self.skip("ASC")
                    q.order.append((down, self.primary()))
            elif word == "LIMIT":
                q.limit = int(self.take())
            else:
                q.offset = int(self.take())
        return q

    def named(self) -> tuple[str, tuple | None]:
        if self.kind() == "var":
            return self.take()[1:], None
        self.take("(")
        e = self.expression()
        name = ""
        if self.skip("AS"):
            name = self.take()[1:]
        else:
            self.fresh += 1
            name = f"_e{self.fresh}"
        self.take(")")
        return name, e

    def group(self) -> Group:
        self.take("{")
        g = Group()
        while not self.skip("}"):
            word = self.peek()
            if word == "OPTIONAL":
                self.take()
                g.parts.append(("optional", self.group()))
            elif word == "FILTER":
                self.take()
                if self.skip("NOT", "EXISTS"):
                    g.parts.append(("exists", self.group(), False))
                elif self.skip("EXISTS"):
                    g.parts.append(("exists", self.group(), True))
                else:
                    g.filters.append(self.primary())
            elif word == "BIND":
                self.take()
                self.take("(")
                e = self.expression()
                self.take("AS")
                g.parts.append(("bind", self.take()[1:], e))
                self.take(")")
            elif word == "VALUES":
                self.take()
                g.parts.append(self.values())
            elif word == "{":
                if self.peek(1) == "SELECT":
                    self.take()
                    g.parts.append(("select", self.select()))
                    self.take("}")
                else:
                    branches = [self.group()]
                    while self.skip("UNION"):
                        branches.append(self.group())
                    g.parts.append(("union", branches))
            elif self.skip("MINUS"):
                g.parts.append(("minus", self.group()))
            elif word in ("GRAPH", "SERVICE"):
                raise Unsupported(word)
            else:
                self.triples(g)
            self.skip(".")
        return g

    def values(self) -> tuple:
        single = self.kind() == "var"
        names = [self.take()[1:]] if single else []
        if not single:
            self.take("(")
            while not self.skip(")"):
                names.append(self.take()[1:])
        rows = []
        self.take("{")
        while not self.skip("}"):
            if single:
                rows.append((self.constant(),))
            else:
                self.take("(")
                row = []
                while not self.skip(")"):
                    row.append(None if self.skip("UNDEF") else self.constant())
                rows.append(tuple(row))
        return "values", names, rows

    def triples(self, g: Group) -> None:
        s = self.term()
        while True:
            p = self.verb()
            while True:
                g.triples.append((s, p, self.term()))
                if not self.skip(","):
                    break
            if not self.skip(";"):
                return
            if self.peek() in (".", "}"):
                return

    def verb(self) -> str | tuple:
        """A variable, a constant, or a path as a tree of tuples."""
        if self.kind() == "var":
            return self.term()
        path = self.alternatives()
        return path[1] if path[0] == "one" else path

    def alternatives(self) -> tuple:
        each = [self.sequence()]
        while self.skip("|"):
            each.append(self.sequence())
        return each[0] if len(each) == 1 else ("any", each)

    def sequence(self) -> tuple:
        each = [self.step()]
        while self.skip("/"):
            each.append(self.step())
        return each[0] if len(each) == 1 else ("then", each)

    def step(self) -> tuple:
        if self.skip("^"):
            return "back", self.step()
        if self.skip("("):
            path = self.alternatives()
            self.take(")")
        else:
            path = ("one", self.term(verb=True))
        if self.peek() in ("*", "+", "?"):
            sign = self.take()
            return "repeat", path, sign != "+", sign != "?"
        return path

    def term(self, verb: bool = False) -> str:
        """A variable as ?name, or a constant's text with a leading =."""
        if self.kind() == "var":
            return "?" + self.take()[1:]
        if verb and self.peek() == "A" and self.kind() == "word":
            self.take()
            return "=rdf:type"
        return "=" + str(self.constant())

    def constant(self) -> str:
        kind, text = self.kind(), self.take()
        if kind == "iri":
            for base, name in self.prefixes.items():
                if base and text[1:-1].startswith(base):
                    return f"{name}:{text[1 + len(base) : -1]}"
            return text[1:-1]
        if kind == "str":
            if self.skip("@"):
                self.take()
            elif self.skip("^^"):
                self.take()
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind in ("num", "name") or text.upper() in ("TRUE", "FALSE"):
            return text
        if text == "-" and self.kind() == "num":
            return "-" + self.take()
        raise ValueError(f"unexpected {text}")

    LEVELS = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))

    def expression(self, level: int = 0) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while True:
            if level == 2 and (self.peek() == "IN" or self.peek() == "NOT" and self.peek(1) == "IN"):
                negated = self.skip("NOT")
                self.take("IN")
                left = ("in", left, self.arguments(), negated)
            elif self.kind() == "op" and self.peek() in self.LEVELS[level]:
                left = (self.take(), left, self.expression(level + 1))
            else:
                return left

    def unary(self) -> tuple:
        if self.skip("!"):
            return "not", self.unary()
        if self.skip("-"):
            return "-", ("num", "0"), self.unary()
        return self.primary()

    def arguments(self) -> list[tuple]:
        self.take("(")
        out = []
        while not self.skip(")"):
            out.append(self.expression())
            self.skip(",")
        return out

    def primary(self) -> tuple:
        kind = self.kind()
        if self.skip("("):
            e = self.expression()
            self.take(")")
            return e
        if kind == "var":
            return "var", self.take()[1:]
        if kind == "num":
            return "num", self.take()
        if kind == "word" and self.peek(1) == "(":
            name = self.take().upper()
            if name in _AGGREGATES:
                self.take("(")
                distinct = self.skip("DISTINCT")
                e = None if self.skip("*") else self.expression()
                if self.skip(";"):
                    self.take("SEPARATOR")
                    self.take("=")
                    self.constant()
                self.take(")")
                return "agg", name, distinct, e
            return "call", name, self.arguments()
        if kind == "name" and self.peek(1) == "(":
            return "cast", self.take().split(":")[1].lower(), self.arguments()
        return "str", self.constant()


@dataclass
class Solutions:
    """A table of solutions, and the variables that no row leaves unbound."""

    df: DataFrame
    bound: set[str]
    single: bool = False

    @property
    def names(self) -> set[str]:
        return set(self.df.columns)


def number(e: Column) -> Column:
    return e.cast("string").try_cast("double")


class Compiler:
    def __init__(self, triples: DataFrame):
        self.triples = triples
        self.spark: SparkSession = triples.sparkSession

    def scan(self, s: str, p: str, o: str) -> Solutions:
        constant = lambda term: term[1:] if term[0] == "=" else None
        df, out, seen = self.path(p, constant(s), constant(o)) if isinstance(p, tuple) else self.triples, [], {}
        for column, term in zip(("s", "p", "o"), (s, p, o), strict=True):
            if isinstance(term, tuple):
                continue
            if term[0] == "=":
                df = df.where(F.col(column) == term[1:])
            elif term in seen:
                df = df.where(F.col(column) == F.col(seen[term]))
            else:
                seen[term] = column
                out.append(F.col(column).alias(term[1:]))
        return Solutions(df.select(*(out or [F.lit(True).alias("_found")])), {t[1:] for t in seen})

    def path(self, path: tuple, start: str | None = None, end: str | None = None) -> DataFrame:
        """(s, o) pairs of a path, some of which need not begin at `start` or end at `end`; a row for each way, but for repeats a row for each pair."""
        kind = path[0]
        if kind == "one":
            df = self.triples.where(F.col("p") == path[1][1:])
            df = df if start is None else df.where(F.col("s") == start)
            return (df if end is None else df.where(F.col("o") == end)).select("s", "o")
        if kind == "back":
            return self.path(path[1], end, start).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "any":
            return reduce(DataFrame.unionByName, [self.path(p, start, end) for p in path[1]])
        if kind == "then":
            *others, last = path[1]
            out = self.path(others[0], start)
            for step in others[1:]:
                out = self._then(out, self.path(step))
            return self._then(out, self.path(last, None, end))
        _, inner, none, many = path
        turned = start is None and end is not None
        edges = self.path(("back", inner) if turned else inner)
        near = end if turned else start
        out = edges.distinct() if near is None else edges.where(F.col("s") == near).distinct()
        if many:
            out = self._closed(out, edges.distinct().checkpoint())
        if none:
            ends = self.triples.select("s").unionByName(self.triples.select(F.col("o").alias("s"))) if near is None else self.spark.range(1).select(F.lit(near).alias("s"))
            out = out.unionByName(ends.select("s", F.col("s").alias("o"))).distinct()
        return out.select(F.col("o").alias("s"), F.col("s").alias("o")) if turned else out

    @staticmethod
    def _then(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.select("s", F.col("o").alias("_m")).join(b.select(F.col("s").alias("_m"), "o"), "_m").select("s", "o")

    def _closed(self, first: DataFrame, edges: DataFrame) -> DataFrame:
        """The pairs that the first ones and any number of edges after them make. A round follows only the pairs that are new; cycles end, as no pair is new twice."""
        known = new = first.checkpoint()
        while not new.isEmpty():  # joins by shuffles: what a round broadcasts goes by way of the driver, which would get a side of each
            new = self._then(new, edges.hint("merge")).distinct().join(known.hint("merge"), ["s", "o"], "left_anti").checkpoint()
            known = known.unionByName(new)
        return known

    def minus(self, a: Solutions, b: Solutions) -> Solutions:
        """The solutions of a that no solution of b agrees with in all that both bind, where that is at least one variable."""
        shared = sorted(a.names & b.names)
        if not shared:
            return a
        sure = [c for c in shared if c in a.bound and c in b.bound]
        if not sure:
            raise Unsupported("MINUS over variables that may be unbound")
        right = b.df.select(*[F.col(c).alias(f"_r_{c}") for c in shared]).distinct()
        same = reduce(lambda x, y: x & y, [a.df[c] == right[f"_r_{c}"] if c in sure else a.df[c].isNull() | right[f"_r_{c}"].isNull() | (a.df[c] == right[f"_r_{c}"]) for c in shared])
        return Solutions(a.df.join(right, same, "left_anti"), a.bound, a.single)

    def join(self, a: Solutions, b: Solutions, how: str = "inner") -> Solutions:
        shared = a.names & b.names
        sure = sorted(shared & a.bound & b.bound)
        loose = sorted(shared - set(sure))
        if not sure:
            if not (a.single or b.single) or loose:
                raise Unsupported("patterns that share no variable that is always bound")
            left, right = (a, b) if b.single else (b, a)
            return Solutions(left.df.join(F.broadcast(right.df)), a.bound | b.bound, a.single and b.single)
        right = b.df.select(*[F.col(c).alias(f"_r_{c}") if c in loose else F.col(c) for c in b.df.columns])
        if loose and how == "inner":
            out = a.df.join(right, sure, "inner").where(" and ".join(f"(`{c}` is null or `_r_{c}` is null or `{c}` = `_r_{c}`)" for c in loose))
        elif loose:
            raise Unsupported("OPTIONAL over variables that may be unbound")
        else:
            out = a.df.join(right, sure, how)
        if how == "inner":
            for c in loose:
                out = out.withColumn(c, F.coalesce(c, f"_r_{c}")).drop(f"_r_{c}")
        return Solutions(out, a.bound | b.bound if how == "inner" else a.bound)

    def group(self, g: Group) -> Solutions:
        """Triples first, the most constant and then connected ones; then the other parts in order; filters last."""
        found: Solutions | None = None
        left = sorted(g.triples, key=lambda t: (-sum(x[0] == "=" for x in t), g.triples.index(t)))
        while left:
            names = found.names if found else set()
            at = next((t for t in left if not names or names & {x[1:] for x in t if x[0] == "?"}), None)
            if at is None:  # not connected yet: perhaps by a later part
                break
            left.remove(at)
            found = self.scan(*at) if found is None else self.join(found, self.scan(*at))
        rest = Group(triples=left) if left else None
        for kind, *part in sorted(g.parts, key=lambda p: p[0] in ("optional", "exists", "bind", "minus")) if rest or found is None else g.parts:
            if kind in ("union", "select", "values"):
                other = self.union(part[0]) if kind == "union" else self.select(part[0], inner=True) if kind == "select" else self.values(*part)
                found = other if found is None else self.join(found, other)
                while rest and (t := next((t for t in rest.triples if found.names & {x[1:] for x in t if x[0] == "?"}), None)):
                    rest.triples.remove(t)
                    found = self.join(found, self.scan(*t))
                continue
            if found is None:
                found = Solutions(self.spark.range(1).select(F.lit(True).alias("_found")), set(), True)
            if kind == "optional":
                found = self.join(found, self.group(part[0]), "left")
            elif kind == "minus":
                found = self.minus(found, self.group(part[0]))
            elif kind == "exists":
                inner = self.group(part[0])
                found = Solutions(found.df.join(inner.df, sorted(found.names & inner.names), "left_semi" if part[1] else "left_anti"), found.bound, found.single)
            else:
                found = Solutions(found.df.withColumn(part[0], self.value(part[1]).cast("string")), found.bound, found.single)
        if rest and rest.triples:
            raise Unsupported("patterns that share no variable")
        if found is None:
            found = Solutions(self.spark.range(1).select(F.lit(True).alias("_found")), set(), True)
        for e in g.filters:
            found = Solutions(found.df.where(self.truth(e)), found.bound, found.single)
        return found

    def union(self, branches: list[Group]) -> Solutions:
        each = [self.group(b) for b in branches]
        out, bound = each[0].df, each[0].bound
        for more in each[1:]:
            out, bound = out.unionByName(more.df, allowMissingColumns=True), bound & more.bound
        return Solutions(out, bound)

    def values(self, names: list[str], rows: list[tuple]) -> Solutions:
        df = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
        return Solutions(df, {n for i, n in enumerate(names) if all(r[i] is not None for r in rows)}, len(rows) == 1)

    def select(self, q: Select, inner: bool = False) -> Solutions:
        body = self.group(q.body)
        df = body.df
        project = q.project or [(n, None) for n in sorted(df.columns) if not n.startswith("_")]
        grouped = bool(q.by) or any(_has_aggregate(e) for _, e in project if e) or any(map(_has_aggregate, q.having))
        order = [(down, e) for down, e in q.order]
        if grouped:
            for name, e in q.by:
                if e:
                    df = df.withColumn(name, self.value(e))
            keys = [n for n, _ in q.by]
            aggregates: dict[str, Column] = {}
            lift = lambda e: self._lift(e, aggregates, keys)
            items = [(n, lift(e) if e else ("var", n)) for n, e in project]
            having = [lift(e) for e in q.having]
            order = [(d, lift(e)) for d, e in order]
            for n, e in items:  # a plain variable that is no key: any of its values
                if e == ("var", n) and n not in keys and n in df.columns:
                    aggregates[n] = F.min(n)
            df = df.groupBy(*keys).agg(*[c.alias(n) for n, c in (aggregates or {"_n": F.count(F.lit(1))}).items()])
            for n, e in items:
                if e != ("var", n):
                    df = df.withColumn(n, self.value(e))
            for e in having:
                df = df.where(self.truth(e))
        else:
            for n, e in project:
                if e:
                    df = df.withColumn(n, self.value(e))
                elif n not in df.columns:
                    df = df.withColumn(n, F.lit(None).cast("string"))
        names = [n for n, _ in project]
        sort = []
        for i, (_, e) in enumerate(order):
            numeric, plain = number(self.value(e)), self.value(e).cast("string")
            df = df.withColumn(f"_n{i}", numeric).withColumn(f"_t{i}", plain)
            sort += [f"_n{i}", f"_t{i}"]
        if q.distinct:  # by the projection; each distinct row sorts by its least key
            df = df.groupBy(*names).agg(*[(F.max if order[int(c[2:])][0] else F.min)(c).alias(c) for c in sort]) if sort else df.select(*names).distinct()
        if q.limit is not None or not inner:
            ordered = [F.desc_nulls_last(c) if order[int(c[2:])][0] else F.asc_nulls_first(c) for c in sort]
            if ordered:
                df = df.orderBy(*ordered, *names)
            if q.offset:
                df = df.offset(q.offset)
            if q.limit is not None:
                df = df.limit(q.limit)
        return Solutions(df.select(*names), (body.bound if not grouped else {n for n, _ in q.by}) & set(names), grouped and not q.by)

    def _lift(self, e, aggregates: dict[str, Column], keys: list[str]):
        """Each aggregate in an expression becomes a column of the group."""
        if not isinstance(e, tuple):
            return [self._lift(x, aggregates, keys) for x in e] if isinstance(e, list) else e
        if e[0] == "agg":
            name = f"_a{len(aggregates)}"
            aggregates[name] = self.aggregate(*e[1:])
            return "var", name
        return tuple(self._lift(x, aggregates, keys) if isinstance(x, (tuple, list)) else x for x in e)

    def aggregate(self, name: str, distinct: bool, e: tuple | None) -> Column:
        x = self.value(e) if e else F.lit(1)
        if name == "COUNT":
            return F.countDistinct(x) if distinct else F.count(x)
        if name in ("SUM", "AVG"):
            made = {"SUM": F.sum_distinct if distinct else F.sum, "AVG": lambda c: F.avg(c)}[name](number(x))
            return F.coalesce(made, F.lit(0.0))
        if name == "GROUP_CONCAT":
            return F.array_join(F.array_sort(F.collect_set(x) if distinct else F.collect_list(x)), " ")
        if name == "SAMPLE":
            return F.min(x)
        pick = F.min if name == "MIN" else F.max
        return F.coalesce(pick(number(x)).cast("string"), pick(x.cast("string")))

    def truth(self, e: tuple) -> Column:
        return self.value(e).cast("boolean")

    def value(self, e: tuple) -> Column:
        kind = e[0]
        if kind == "var":
            return F.col(f"`{e[1]}`")
        if kind == "num":
            return F.lit(float(e[1]) if "." in e[1] else int(e[1]))
        if kind == "str":
            return F.lit(e[1].lower() == "true") if e[1].lower() in ("true", "false") else F.lit(e[1])
        if kind in ("||", "&&"):
            a, b = self.truth(e[1]), self.truth(e[2])
            return a | b if kind == "||" else a & b
        if kind == "not":
            return ~self.truth(e[1])
        if kind in ("=", "!=", "<", ">", "<=", ">="):
            a, b = self.value(e[1]), self.value(e[2])
            x, y, s, t = number(a), number(b), a.cast("string"), b.cast("string")
            test = {"=": lambda l, r: l == r, "!=": lambda l, r: l != r, "<": lambda l, r: l < r, ">": lambda l, r: l > r, "<=": lambda l, r: l <= r, ">=": lambda l, r: l >= r}[kind]  # noqa: E741
            return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(s, t))
        if kind in ("+", "-", "*", "/"):
            x, y = number(self.value(e[1])), number(self.value(e[2]))
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[kind]()
        if kind == "in":
            any_ = self.value(("=", e[1], e[2][0]))
            for more in e[2][1:]:
                any_ = any_ | self.value(("=", e[1], more))
            return ~any_ if e[3] else any_
        if kind == "cast":
            x = self.value(e[2][0])
            whole = {"integer": "bigint", "int": "bigint", "long": "bigint", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz", "string": "string"}.get(e[1], "double")
            return x.cast("string").try_cast(whole)
        if kind == "call":
            return self.call(e[1], e[2])
        raise Unsupported(str(kind))

    def call(self, name: str, given: list[tuple]) -> Column:
        args = [self.value(a) for a in given]
        text = [a.cast("string") for a in args]
        plain = {
            "STR": lambda: text[0], "LCASE": lambda: F.lower(text[0]), "UCASE": lambda: F.upper(text[0]), "STRLEN": lambda: F.length(text[0]),
            "CONTAINS": lambda: text[0].contains(text[1]), "STRSTARTS": lambda: text[0].startswith(text[1]), "STRENDS": lambda: text[0].endswith(text[1]),
            "REPLACE": lambda: F.regexp_replace(text[0], text[1], text[2]), "CONCAT": lambda: F.concat(*text), "SUBSTR": lambda: F.substring(text[0], args[1].cast("int"), args[2].cast("int") if len(args) > 2 else F.length(text[0])),
            "BOUND": lambda: args[0].isNotNull(), "COALESCE": lambda: F.coalesce(*text), "ABS": lambda: F.abs(number(args[0])), "ROUND": lambda: F.round(number(args[0])),
            "IF": lambda: F.when(self.truth(given[0]), text[1]).when(~self.truth(given[0]), text[2]), "YEAR": lambda: F.coalesce(F.year(text[0].try_cast("date")), F.regexp_extract(text[0], r"^(\d{4})", 1).try_cast("int")),
        }.get(name)
        if plain:
            return plain()
        if name == "REGEX":
            flags = given[2][1] if len(given) > 2 else ""
            return F.regexp_like(text[0], F.concat(F.lit(f"(?{flags})" if flags else ""), text[1]))
        raise Unsupported(name)


def _has_aggregate(e) -> bool:
    return isinstance(e, (tuple, list)) and (bool(e) and e[0] == "agg" or any(map(_has_aggregate, e)))


def run(query: str, triples: DataFrame) -> DataFrame:
    """The solutions of a SELECT; for ASK one row, `answer`."""
    parsed = Parser(query).query()
    compiler = Compiler(triples)
    if parsed.form == "ASK":
        return compiler.group(parsed.body).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
    return compiler.select(parsed).df
