"""Reports over runs: mined token pairs, counts and rates, terms by split, rendered playbooks, joined summaries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.nested import events
from tessera.operators.placeholders import bounded
from tessera.operators.rules import render_line

#: A tile of a product, at most about: places that lead to a walk, and lines below each of them; places that are written out together; walks whose tiles share a task.
LEADS, LINES, TOGETHER, SHARED = 800, 128, 8, 32

_PLACEHOLDER = re.compile(r"\bpgmrc?:[A-Za-z_][A-Za-z0-9_]*")
_IDENTIFIER = re.compile(r"\borkg[prc]:[A-Za-z0-9_]+")


def token_pairs(text: str | None) -> list[tuple[str, str]]:
    """(placeholder, identifier) of every object, at any depth of a JSON text, whose strings name one of each; in order of where the objects begin.

    A text that is no JSON has no pairs. Only tokens are kept of strings, and
    of an object that has two of a kind just that, as no object around it can
    have a pair: so memory stays small however deep the text is.
    """
    found: list[tuple[int, str, str]] = []
    held: list[tuple[str, int, set[str], set[str]]] = []
    place = 0
    try:
        for kind, start, end in events(text or "null"):
            if kind in ("[", "{"):
                place += 1
                held.append((kind, place, set(), set()))
            elif kind in ("]", "}"):
                sign, own, *tokens = held.pop()
                if sign == "{" and len(tokens[0]) == len(tokens[1]) == 1:
                    found.append((own, *tokens[0], *tokens[1]))
                for all_, more in zip(held[-1][2:] if held else (), tokens, strict=False):
                    all_.update(sorted(more)[:2])
            elif kind == "value" and held and text[start] == '"':
                own = json.loads(text[start:end])
                for all_, more in zip(held[-1][2:], (_PLACEHOLDER.findall(own), _IDENTIFIER.findall(own)), strict=True):
                    all_.update(more)
    except ValueError:
        return []
    return [(p, i) for _, p, i in sorted(found)]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("target", T.StringType())])))
def _token_pairs(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("token", pa.string()), ("target", pa.string())]))
    return pa.array([[{"token": p, "target": i} for p, i in token_pairs(t)] for t in texts.to_pylist()], kind)


def mined_mapping(files: DataFrame, text: str, order: str) -> DataFrame:
    """(token, target) over all JSON texts; the last pair of a token counts, by file, then place in it."""
    pairs = files.select(order, F.posexplode(_token_pairs(text)).alias("at", "pair"))
    return pairs.groupBy("pair.token").agg(F.max_by("pair.target", F.struct(order, "at")).alias("target"))


def counters(df: DataFrame, flags: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """`total`, and of each flag its count and its rate to four places."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[c for n, f in flags.items() for c in (F.count_if(f).alias(f"{n}_count"), F.bround(F.count_if(f) / F.count(F.lit(1)), 4).alias(f"{n}_rate"))])


def terms_by_split(terms: DataFrame, group: Sequence[str], split: str, splits: Sequence[str], example: str, most: int = 5) -> DataFrame:
    """Of each term the total, a count for each split, and the first examples; most frequent first by `place`.

    Examples are ranked before they are gathered, so a hot term costs as many.
    """
    counts = terms.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(split) == s).alias(s) for s in splits])
    few = terms.select(*group, example).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(example))).where(F.col("_n") <= most)
    shown = few.groupBy(*group).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return counts.join(shown, list(group), "left").withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), *group)))


def top_terms(terms: DataFrame, term: str, most: int = 30) -> DataFrame:
    return terms.groupBy(term).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), term).limit(most)


def executed(items: DataFrame, runs: DataFrame, key: str, missing: str = "not_executed") -> DataFrame:
    """Items with the record of their run: status, cardinality, error; those without one have the status `missing`."""
    record = runs.groupBy(key).agg(F.max_by(F.struct("status", "cardinality", "error"), "pos").alias("_r"))
    joined = items.join(record, key, "left")
    return joined.select(*items.columns, F.coalesce("_r.status", F.lit(missing)).alias("status"), "_r.cardinality", "_r.error")


def with_judgement(summaries: DataFrame, judged: DataFrame, run: str) -> DataFrame:
    """Run summaries with their judge's summary as one struct; null where there is none."""
    fields = [c for c in judged.columns if c != run]
    return summaries.join(judged.select(run, F.struct(*fields).alias("llm_judge")), run, "left")


def rendered(rules: DataFrame, book: str, section: str, position: str) -> DataFrame:
    """(book, text): sections under their headings in order of first use, rules in order; ids are `{section's number}-{nnnnn}` anew."""
    order = rules.withColumn("_s", F.min(position).over(Window.partitionBy(book, section)))
    numbered = order.withColumn("_n", F.row_number().over(Window.partitionBy(book).orderBy("_s", position)))
    numbered = numbered.withColumn("_k", F.dense_rank().over(Window.partitionBy(book).orderBy("_s")))
    line = render_line(F.format_string("s%d-%05d", F.col("_k"), F.col("_n")), F.col("helpful"), F.col("harmful"), F.col("content"))
    headed = numbered.withColumn("_line", F.when(F.col(position) == F.col("_s"), F.concat(F.lit("## "), F.col(section), F.lit("\n"), line)).otherwise(line))
    return headed.groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n").alias("text"))


def item_playbook(plan: DataFrame, ranked: DataFrame, extra: DataFrame, item: str) -> DataFrame:
    """(item, place, content): an item's plan first, then its ranked rules, then the rules that all get; a content once.

    plan: item, content; ranked: item, rank, content; extra: rank, content, a few.
    """
    rows = plan.select(item, F.lit(0).alias("_from"), F.lit(0).alias("_rank"), "content").unionByName(ranked.select(item, F.lit(1).alias("_from"), F.col("rank").alias("_rank"), "content"))
    few = extra.agg(F.collect_list(F.struct(F.lit(2).alias("_from"), F.col("rank").alias("_rank"), "content")).alias("_few"))  # rules that all items get, by construction few
    rows = rows.unionByName(plan.select(item).distinct().crossJoin(F.broadcast(few)).select(item, F.inline("_few")))
    once = rows.groupBy(item, "content").agg(F.min(F.struct("_from", "_rank")).alias("_at"))
    return once.select(item, F.row_number().over(Window.partitionBy(item).orderBy("_at", "content")).alias("place"), "content")


def compactions(log: DataFrame, book: str, position: str, accepted: Column, every: int) -> DataFrame:
    """(book, position): after which steps of a playbook's log it is compacted: each `every` accepted rules."""
    so_far = F.sum(F.when(accepted, 1).otherwise(0)).over(Window.partitionBy(book).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("_n", so_far).where(accepted & (F.col("_n") % every == 0)).select(book, position)


def class_tree(properties: DataFrame) -> DataFrame:
    """(template, property, child_property, grandchild_property) two levels down. properties: template, property, target (a template or null)."""
    first = properties.select("template", "property", "target")
    down = lambda level: properties.select(F.col("template").alias(f"t{level}"), F.col("property").alias(f"p{level}"), F.col("target").alias(f"g{level}"))
    return first.join(down(1), F.col("target") == F.col("t1"), "left").join(down(2), F.col("g1") == F.col("t2"), "left").select("template", "property", F.col("p1").alias("child_property"), F.col("p2").alias("grandchild_property"))


def class_paths(properties: DataFrame, order: str) -> DataFrame:
    """(template, path, depth) of all properties below each template, to any depth.

    properties: template, property, target (a template or null) and their
    order in the template. path is an array of (order, property). A round
    follows the properties that the one before reached; a template isn't
    entered twice on a path, so circles end.
    """
    own = properties.select("template", "property", "target", F.col(order).alias("_order"))
    step = F.struct(F.col("_order").alias("order"), "property")
    below = own.select(F.col("template").alias("target"), step.alias("_step"), F.col("target").alias("_next")).checkpoint()
    level = own.select("template", F.array(step).alias("path"), F.array("template").alias("_seen"), "target").checkpoint()
    found = level
    while not level.isEmpty():
        into = level.where(F.col("target").isNotNull() & ~F.array_contains("_seen", F.col("target")))
        level = into.join(below, "target").select("template", F.array_append("path", F.col("_step")).alias("path"), F.array_append("_seen", F.col("target")).alias("_seen"), F.col("_next").alias("target")).checkpoint()
        found = found.unionByName(level)
    return found.select("template", "path", F.size("path").alias("depth"))


def class_lines(properties: DataFrame, order: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """(template, place, line): a template's properties in order, each followed by those of the template that it leads to, indented by their depth.

    The same rows as of class_paths(), numbered without building or sorting
    the paths: what is below a property depends on the templates walked so far
    alone. So each walk over templates is sized once, from its end; a
    property's place in its template is a running sum of these sizes, and its
    place below a path the path's place plus that. A template's properties of
    one walk are ordered at once; their product with all places that lead to
    them is joined in tiles, dealt to any number of tasks however hot the walk
    is. A task's rows have few different lines, in order, so files of them
    stay small. Orders are unique in a template.
    """
    own = keep(properties.select("template", F.col(order).alias("_order"), "property", "target"))
    widths = keep(own.groupBy("template").agg(F.count(F.lit(1)).alias("width")))
    edges = own.where(F.col("target").isNotNull()).groupBy("template", "target").agg(F.count(F.lit(1)).alias("n"))
    edges = keep(edges.join(widths.select(F.col("template").alias("target"), "width"), "target").select(F.col("template").alias("last"), "target", "n", "width"))
    walks = [keep(widths.select(F.array("template").alias("walk"), F.col("template").alias("last"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("paths"), "width"))]
    while not walks[-1].isEmpty():
        into = walks[-1].select("walk", "last", "paths").join(edges, "last").where(~F.array_contains("walk", F.col("target")))
        walks.append(keep(into.select(F.array_append("walk", F.col("target")).alias("walk"), F.col("target").alias("last"), "n", (F.col("paths") * F.col("n")).alias("paths"), "width")))
    placed, below = [], None  # from the longest walks on
    for depth in range(len(walks) - 1, 0, -1):
        level = walks[depth - 1]
        held = level.select("walk", "last").join(own.withColumnRenamed("template", "last"), "last")
        if below is None:
            held, sizes = held.withColumn("under", F.lit(0).cast("long")), level.withColumn("size", F.col("width"))
        else:
            parts = below.select(F.slice("walk", 1, depth).alias("walk"), F.col("last").alias("target"), F.col("size").alias("under"), (F.col("n") * F.col("size")).alias("all"))
            held = held.join(parts.select("walk", "target", "under"), ["walk", "target"], "left").withColumn("under", F.coalesce("under", F.lit(0).cast("long")))
            sizes = level.join(parts.groupBy("walk").agg(F.sum("all").alias("all")), "walk", "left").withColumn("size", F.col("width") + F.coalesce("all", F.lit(0).cast("long"))).drop("all")
        running = Window.partitionBy("walk").orderBy("_order", "property").rowsBetween(Window.unboundedPreceding, 0)
        line = F.concat(F.repeat(F.lit("  "), F.lit(depth - 1)), F.lit("- "), F.col("property"))
        place = F.sum(F.col("under") + 1).over(running) - F.col("under")
        block = F.floor((F.count(F.lit(1)).over(running) - 1) / LINES)
        placed.append(keep(held.select("walk", block.alias("block"), place.alias("place"), line.alias("line"), F.when(F.col("under") > 0, F.col("target")).alias("target"))))
        below = keep(sizes.select("walk", "last", "n", "size"))
    if not placed:
        return own.select("template", F.lit(0).cast("long").alias("place"), F.lit("").alias("line")).where(F.lit(False))
    placed.reverse()
    found = placed[0].select(F.element_at("walk", 1).alias("template"), "place", "line")
    lead = placed[0]
    for depth, (level, reached) in enumerate(zip(placed[1:], walks[1:], strict=False), 2):
        lead = lead.where(F.col("target").isNotNull()).select(F.array_append("walk", F.col("target")).alias("walk"), F.col("place").alias("_at"))
        found = found.unionByName(_below(lead, level, reached).select(F.element_at("walk", 1).alias("template"), "place", "line"))
        if depth < len(placed):
            lead = _below(lead, level.where(F.col("target").isNotNull()), reached)
    return found


def _below(lead: DataFrame, level: DataFrame, walks: DataFrame) -> DataFrame:
    """(walk, place, line, target): a walk's lines below each place that leads to it.

    Places are dealt to parts by hash, lines cut into blocks in order. A tile,
    a part and a block, is shuffled as two arrays, and its rows are written
    out from a few places at a time, so memory is bounded. Walks with as many
    and as wide paths have much the same places: their tiles of a part and
    block are in one task, side by side, where equal places compress.
    """
    alike = ["paths", "width"]
    shares = walks.groupBy(*alike).agg(F.count(F.lit(1)).alias("share"), F.sum(F.col("paths") * F.col("width")).alias("rows"))
    tasks = max(1, -(-2 * (shares.agg(F.sum("rows")).first()[0] or 0) // (LEADS * LINES * SHARED)))
    bundle = F.xxhash64(*alike, F.pmod(F.xxhash64("walk"), F.ceil(F.col("share") / SHARED)))
    known = walks.join(bounded(shares), alike).select("walk", F.ceil(F.col("paths") / LEADS).alias("parts"), bundle.alias("bundle"))
    leads = lead.join(bounded(known), "walk").groupBy("walk", "bundle", "parts", F.pmod(F.xxhash64("_at"), "parts").alias("part")).agg(F.array_sort(F.collect_list("_at")).alias("leads"))
    lines = level.groupBy("walk", "block").agg(F.array_sort(F.collect_list(F.struct("place", "line", "target"))).alias("lines"))
    dealt = F.pmod(F.pmod("bundle", F.lit(tasks)) + F.col("block") * F.col("parts") + F.col("part"), F.lit(tasks)).cast("int")
    few = F.transform(F.sequence(F.lit(1), F.size("leads"), F.lit(TOGETHER)), lambda i: F.slice("leads", i, TOGETHER))
    tiles = leads.join(lines, "walk").repartitionById(tasks, dealt).select("walk", "bundle", "part", "block", "lines", F.posexplode(few).alias("nth", "few"))
    tiles = tiles.sortWithinPartitions("bundle", "part", "block", "nth", "walk")
    rows = tiles.select("walk", F.explode("few").alias("_at"), "lines").select("walk", "_at", F.inline("lines"))
    return rows.select("walk", (F.col("_at") + F.col("place")).alias("place"), "line", "target")


def price(prompt: Column, completion: Column, model: Column, prices: Mapping[str, tuple[float, float]]) -> Column:
    """Dollars of a call by a list without a tier for cached tokens, to 8 places; null for a model that isn't listed. Prices are for a million tokens."""
    out = F.lit(None).cast("double")
    for name, (into, out_of) in prices.items():
        out = F.when(model == name, F.bround((prompt * into + completion * out_of) / 1e6, 8)).otherwise(out)
    return out


def feedback(fields: Mapping[str, Column]) -> Column:
    """A JSON document of the fields that aren't null or blank."""
    return F.to_json(F.map_filter(F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), c.cast("string"))]), lambda _, v: v.isNotNull() & (v != "")))
