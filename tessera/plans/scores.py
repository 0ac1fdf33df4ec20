"""Queries that score answers, texts and references, and summarise the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import summary
from tessera.plans.registry import query

PRF = """
  case when g = 0 and p = 0 then 1.0 when g = 0 or p = 0 then 0.0 else b / p end as precision,
  case when g = 0 and p = 0 then 1.0 when g = 0 or p = 0 then 0.0 else b / g end as recall,
  case when g = 0 and p = 0 then 1.0 when g = 0 or p = 0 or b = 0 then 0.0 else 2 * (b / p) * (b / g) / (b / p + b / g) end as f1"""

ANSWERS = """
with sides as (
  select user_id, list(distinct {key}) filter (where event_id % 2 = 1) as gold, list(distinct {key}) filter (where event_id % 2 = 0) as pred
  from events group by user_id),
n as (select user_id, coalesce(len(gold), 0) * 1.0 as g, coalesce(len(pred), 0) * 1.0 as p, coalesce(len(list_intersect(gold, pred)), 0) * 1.0 as b,
             coalesce(list_sort(gold), []) = coalesce(list_sort(pred), []) as same from sides),
scored as (select user_id, same, """ + PRF + " from n)"
BY_DAY = "event_type || ' ' || strftime(ts, '%Y-%m-%d')"


def answers(events, key):
    """Gold answers are the distinct keys of odd events, predicted ones those of even events, by user."""
    side = lambda odd: F.collect_set(F.when(F.col("event_id") % 2 == odd, key))
    sides = events.groupBy("user_id").agg(side(1).alias("gold"), side(0).alias("pred"))
    return sides.withColumn("m", scores.set_overlap(F.col("pred"), F.col("gold"))).withColumn("same", F.array_sort("gold") == F.array_sort("pred"))


def by_day(events):
    return answers(events, F.concat_ws(" ", "event_type", F.date_format("ts", "yyyy-MM-dd")))


@query("answer_set_prf1", ANSWERS.format(key=BY_DAY) + " select user_id, round_even(precision, 4) as precision, round_even(recall, 4) as recall, round_even(f1, 4) as f1 from scored")
def answer_set_prf1(tables):
    m = by_day(tables("events"))
    return m.select("user_id", *[scores.r4(F.col(f"m.{c}")).alias(c) for c in ("precision", "recall", "f1")])


@query("answer_exact_match", ANSWERS.format(key="event_type") + " select user_id, cast(same as int) as exact_match from scored")
def answer_exact_match(tables):
    return answers(tables("events"), F.col("event_type")).select("user_id", F.col("same").cast("int").alias("exact_match"))


@query(
    "answer_slices",
    ANSWERS.format(key=BY_DAY)
    + """, keyed as (select cast(user_id % 3 as varchar) as third, cast(user_id % 2 as varchar) as half, f1, same from scored)
    select case when grouping(third) = 0 then 'third' when grouping(half) = 0 then 'half' else 'overall' end as slice,
           case when grouping(third) = 0 then third when grouping(half) = 0 then half else 'all' end as slice_value,
           round_even(avg(f1), 4) as mean_f1, count_if(same) as n_exact, count(*) as n
    from keyed group by grouping sets ((third), (half), ())""",
)
def answer_slices(tables):
    """Mean answer F1, exact matches and items by slice: scan, set overlap and grouping sets, in two shuffles."""
    rows = by_day(tables("events")).select("same", F.col("m.f1").alias("f1"), (F.col("user_id") % 3).alias("third"), (F.col("user_id") % 2).alias("half"))
    return summary.slices(rows, ["third", "half"], [scores.r4(F.avg("f1")).alias("mean_f1"), F.count_if("same").alias("n_exact"), F.count(F.lit(1)).alias("n")])


@query(
    "answer_cell_overlap",
    """with cells as (select user_id, event_id % 2 = 1 as gold, unnest([event_type, strftime(ts, '%Y-%m-%d')]) as cell from events),
    flags as (select user_id, cell, bool_or(gold) as g, bool_or(not gold) as p from cells group by all)
    select user_id, count_if(g and p) as matched, count_if(g and not p) as missing, count_if(p and not g) as extra,
      array_to_string(list_slice(list_sort(list(cell) filter (where g and not p)), 1, 50), '|') as missing_cells from flags group by user_id""",
)
def answer_cell_overlap(tables):
    cells = tables("events").select("user_id", (F.col("event_id") % 2 == 1).alias("gold"), F.explode(F.array("event_type", F.date_format("ts", "yyyy-MM-dd"))).alias("cell"))
    flags = cells.groupBy("user_id", "cell").agg(F.bool_or("gold").alias("g"), F.bool_or(~F.col("gold")).alias("p"))
    lost = F.slice(F.array_sort(F.collect_list(F.when(F.col("g") & ~F.col("p"), F.col("cell")))), 1, 50)
    return flags.groupBy("user_id").agg(F.count_if(F.col("g") & F.col("p")).alias("matched"), F.count_if(F.col("g") & ~F.col("p")).alias("missing"), F.count_if(F.col("p") & ~F.col("g")).alias("extra"), F.when(F.size(lost) > 0, F.array_join(lost, "|")).alias("missing_cells"))


SLICED = """
with long as (
  select c_mktsegment, n_name, o_orderpriority, metric,
         case metric when 'price' then o_totalprice when 'open' then case when o_orderstatus = 'O' then 1.0 else 0.0 end else c_acctbal end as value,
         metric <> 'balance' or c_acctbal > 0 as comparable
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey, (select unnest(['price', 'open', 'balance']) as metric)),
v as (select *, case when comparable then value end as u from long)
"""


def order_metrics(tables):
    """The long table of three metrics for each order, with its slice fields."""
    o = tables("orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    c = tables("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = tables("nation").select("n_nationkey", "n_name")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    record = lambda name, value, ok: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), ok.alias("comparable"))
    each = F.array(record("price", F.col("o_totalprice"), F.lit(True)), record("open", (F.col("o_orderstatus") == "O").cast("int"), F.lit(True)), record("balance", F.col("c_acctbal"), F.col("c_acctbal") > 0))
    return rows.select("c_mktsegment", "n_name", "o_orderpriority", F.inline(each))


@query(
    "metric_slice_grouping_sets",
    SLICED
    + """select metric, case when grouping(c_mktsegment) = 0 then 'c_mktsegment' when grouping(n_name) = 0 then 'n_name' when grouping(o_orderpriority) = 0 then 'o_orderpriority' else 'overall' end as slice,
       case when grouping(c_mktsegment) = 0 then c_mktsegment when grouping(n_name) = 0 then n_name when grouping(o_orderpriority) = 0 then o_orderpriority else 'all' end as slice_value,
       round(avg(u), 2) as mean, count(u) as comparable_count, count(*) - count(u) as non_comparable_count
       from v group by grouping sets ((metric, c_mktsegment), (metric, n_name), (metric, o_orderpriority), (metric))""",
)
def metric_slice_grouping_sets(tables):
    rows = order_metrics(tables)
    v = F.when(F.col("comparable"), F.col("value"))
    aggs = [F.round(F.avg(v), 2).alias("mean"), F.count(v).alias("comparable_count"), F.count_if(v.isNull()).alias("non_comparable_count")]
    fields = ["c_mktsegment", "n_name", "o_orderpriority"]
    keys = [F.col(f) for f in fields]
    grouped = rows.groupingSets([[F.col("metric"), k] for k in keys] + [[F.col("metric")]], F.col("metric"), *keys).agg(*aggs, *[F.grouping(f).alias(f"_g{i}") for i, f in enumerate(fields)])
    name, value = F.lit("overall"), F.lit("all")
    for i, f in enumerate(fields):
        name, value = F.when(F.col(f"_g{i}") == 0, f).otherwise(name), F.when(F.col(f"_g{i}") == 0, F.coalesce(f, F.lit(summary.MISSING))).otherwise(value)
    return grouped.select("metric", name.alias("slice"), value.alias("slice_value"), "mean", "comparable_count", "non_comparable_count")


@query(
    "metric_binary_summary",
    """with long as (select 'toxic' as metric, cast(toxic as double) as v from labels union all select 'quality', cast(quality as double) from labels
      union all select 'n_chars', cast(n_chars as double) from documents)
    select metric, round_even(avg(v), 4) as mean, count(v) as comparable_count, count(*) - count(v) as non_comparable_count,
      case when bool_and(v in (0, 1)) then count_if(v = 1) end as success_count, case when bool_and(v in (0, 1)) then count_if(v = 0) end as failure_count from long group by metric""",
)
def metric_binary_summary(tables):
    labels, docs = tables("labels"), tables("documents")
    long = labels.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("toxic", "quality")])))
    long = long.unionByName(docs.select(F.lit("n_chars").alias("metric"), F.col("n_chars").cast("double").alias("value"))).withColumn("comparable", F.lit(True))
    return summary.metric_summary(long)


@query(
    "error_category_ladder",
    """select case when value is null then 'missing_value' when value < 0 then 'negative' when event_type = 'error' then 'event_error' when value > 900 then 'outlier' when value = 0 then 'zero' else 'success' end as category,
       count(*) as n from events group by 1""",
)
def error_category_ladder(tables):
    from tessera.operators.rules import first_failure

    v = F.col("value")
    ladder = first_failure([("missing_value", v.isNull()), ("negative", v < 0), ("event_error", F.col("event_type") == "error"), ("outlier", v > 900), ("zero", v == 0)])
    return summary.histogram(tables("events").select(F.coalesce(ladder, F.lit("success")).alias("category")), "category")


@query(
    "error_breakdown_topn",
    """with r as (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id) as rank from events)
    select event_type, event_id, value, rank from r where rank <= 3""",
)
def error_breakdown_topn(tables):
    return summary.top_examples(tables("events").select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.col("event_id")], 3).withColumn("rank", F.col("rank").cast("long"))


@query("response_time_summary", "select event_type, count(value) as n, round(avg(value), 3) as mean_s, min(value) as min_s, max(value) as max_s, round(sum(value), 2) as total_s from events group by event_type")
def response_time_summary(tables):
    return summary.time_summary(tables("events"), "value", ["event_type"], (3, 2), F.round)


@query(
    "hallucination_summary",
    """with refs as (select l_orderkey, l_partkey, p_partkey is null as unknown from lineitem left join (select p_partkey from part where p_size <= 25) on l_partkey = p_partkey),
    items as (select l_orderkey, count(distinct l_partkey) as n_refs, count(distinct case when unknown then l_partkey end) as n_unknown from refs group by all)
    select count(*) as n_items, count_if(n_unknown > 0) as n_hallucinating, cast(sum(n_refs) as bigint) as n_refs, cast(sum(n_unknown) as bigint) as n_unknown, round(avg(n_unknown / n_refs), 4) as mean_rate from items""",
)
def hallucination_summary(tables):
    """References that an allow-list lacks; the list is joined, so it may be of any size."""
    known = tables("part").where(F.col("p_size") <= 25).select("p_partkey")
    refs = tables("lineitem").select("l_orderkey", "l_partkey").distinct().join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    items = refs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("p_partkey").isNull()).alias("n_unknown"))
    return items.agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("n_unknown") > 0).alias("n_hallucinating"), F.sum("n_refs").alias("n_refs"), F.sum("n_unknown").alias("n_unknown"), F.round(F.avg(F.col("n_unknown") / F.col("n_refs")), 4).alias("mean_rate"))


@query(
    "token_cost_rollup",
    """with prices(model, price_in, price_cached, price_out) as (values ('click', 2.5, 0.25, 15.0), ('view', 0.4, 0.1, 1.6), ('purchase', 1.1, 0.55, 4.4)),
    u as (select event_type as model, cast(floor(abs(value)) as bigint) as prompt, event_id % 400 as cached, user_id % 100 as completion from events),
    c as (select u.*, round_even(((prompt - least(cached, prompt)) * price_in + least(cached, prompt) * price_cached + completion * price_out) / 1e6, 8) as usd from u left join prices using (model))
    select model, cast(sum(prompt) as bigint) as prompt_tokens, cast(sum(completion) as bigint) as completion_tokens, count(usd) as n_priced, count(*) - count(usd) as n_unpriced, round(sum(usd), 6) as usd from c group by model""",
)
def token_cost_rollup(tables):
    spark = tables("events").sparkSession
    prices = spark.createDataFrame([("click", 2.5, 0.25, 15.0), ("view", 0.4, 0.1, 1.6), ("purchase", 1.1, 0.55, 4.4)], "model string, price_in double, price_cached double, price_out double")
    usage = tables("events").select(F.col("event_type").alias("model"), F.floor(F.abs("value")).cast("long").alias("prompt"), (F.col("event_id") % 400).alias("cached"), (F.col("user_id") % 100).alias("completion"))
    priced = usage.join(F.broadcast(prices), "model", "left").withColumn("usd", scores.token_cost(*[F.col(c) for c in ("prompt", "cached", "completion", "price_in", "price_cached", "price_out")]))
    return priced.groupBy("model").agg(F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"), F.count("usd").alias("n_priced"), F.count_if(F.col("usd").isNull()).alias("n_unpriced"), F.round(F.sum("usd"), 6).alias("usd"))


WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z]+'), lambda w: w <> '')"
PAIRS = f"""
with pairs as (
  select c.conv_id, c.turn, {WORDS.format('c.text')} as p, {WORDS.format('n.text')} as g
  from conversations c join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1),
grams as (select conv_id, turn, k, side, gram, count(*) as n from (
    select conv_id, turn, k, 'p' as side, array_to_string(p[i:i + k - 1], ' ') as gram from pairs, range(1, 5) as ks(k), lateral (select unnest(range(1, len(p) - k + 2)) as i)
    union all select conv_id, turn, k, 'g', array_to_string(g[i:i + k - 1], ' ') from pairs, range(1, 5) as ks(k), lateral (select unnest(range(1, len(g) - k + 2)) as i)) group by all),
matched as (select a.conv_id, a.turn, a.k, sum(least(a.n, b.n)) as m from grams a join grams b on a.conv_id = b.conv_id and a.turn = b.turn and a.k = b.k and a.gram = b.gram and a.side = 'p' and b.side = 'g' group by all),
sized as (select p.conv_id, p.turn, ks.k, len(p) as lp, len(g) as lg, greatest(len(p) - ks.k + 1, 0) as np, greatest(len(g) - ks.k + 1, 0) as ng, p = g as same, coalesce(m, 0) as m
  from pairs p cross join range(1, 5) as ks(k) left join matched x on x.conv_id = p.conv_id and x.turn = p.turn and x.k = ks.k)
"""


def neighbours(tables):
    """Each turn's words (as predicted) and the next turn's (as gold)."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    c = tables("conversations").select("conv_id", "turn", words.alias("w"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("g"))
    return c.withColumnRenamed("w", "p").join(after, ["conv_id", "turn"])


@query("bleu4_turns", PAIRS + " select conv_id, turn, case when min(lp) >= 4 then round(exp(sum(ln((m + 1.0) / (np + 1.0))) / 4) * case when min(lp) > min(lg) then 1.0 else exp(1 - min(lg) / min(lp)) end, 6) end as bleu from sized group by conv_id, turn")
def bleu4_turns(tables):
    return neighbours(tables).select("conv_id", "turn", F.round(scores.bleu(F.col("p"), F.col("g")), 6).alias("bleu"))


@query(
    "rouge12_turns",
    PAIRS
    + """, f as (select conv_id, turn, k, case when np = 0 and ng = 0 then case when same then 1.0 else 0.0 end when np = 0 or ng = 0 or m = 0 then 0.0 else 2 * (m / np) * (m / ng) / (m / np + m / ng) end as f1 from sized where k <= 2)
    select conv_id, turn, round(max(case when k = 1 then f1 end), 6) as rouge1, round(max(case when k = 2 then f1 end), 6) as rouge2 from f group by conv_id, turn""",
)
def rouge12_turns(tables):
    return neighbours(tables).select("conv_id", "turn", *[F.round(scores.rouge_n(F.col("p"), F.col("g"), n), 6).alias(f"rouge{n}") for n in (1, 2)])


@query("multiset_overlap_turns", PAIRS + " select conv_id, turn, cast(m as int) as matched, case when np = 0 and ng = 0 then 1.0 when np = 0 or ng = 0 or m = 0 then 0.0 else round(2 * (m / np) * (m / ng) / (m / np + m / ng), 6) end as f1 from sized where k = 1")
def multiset_overlap_turns(tables):
    pairs = neighbours(tables)
    return pairs.select("conv_id", "turn", scores.multiset_matches(F.col("p"), F.col("g")).alias("matched"), F.round(scores.multiset_overlap(F.col("p"), F.col("g"))["f1"], 6).alias("f1"))


@query("rouge_l_lcs")
def rouge_l_lcs(tables):
    pairs = neighbours(tables).withColumn("m", scores.rouge_l(F.col("p"), F.col("g")))
    return pairs.select("conv_id", "turn", scores.lcs_length(F.col("p"), F.col("g")).alias("lcs"), F.round("m.f1", 6).alias("rouge_l"))


@query(
    "kg_ref_prf1",
    """with r as (select page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="(/[A-Za-z0-9_-]+)"', 1))) as pred, list_sort(list_distinct(regexp_extract_all(url, '(/[A-Za-z0-9_-]+)', 1))) as gold from pages),
    n as (select page_id, len(pred) * 1.0 as p, len(gold) * 1.0 as g, len(list_intersect(pred, gold)) * 1.0 as b from r)
    select page_id, cast(p as int) as n_pred, cast(g as int) as n_gold, round_even(precision, 4) as precision, round_even(recall, 4) as recall, round_even(f1, 4) as f1 from (select page_id, p, g, """ + PRF + " from n)",
)
def kg_ref_prf1(tables):
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(p), F.lit(1)))
    rows = tables("pages").select("page_id", found("html", 'href="(/[A-Za-z0-9_-]+)"').alias("pred"), found("url", "(/[A-Za-z0-9_-]+)").alias("gold"))
    rows = rows.withColumn("m", scores.set_overlap(F.col("pred"), F.col("gold")))
    return rows.select("page_id", F.size("pred").alias("n_pred"), F.size("gold").alias("n_gold"), *[scores.r4(F.col(f"m.{c}")).alias(c) for c in ("precision", "recall", "f1")])


@query("judge_summary", """select d.lang, l.toxic as verdict, count(*) as n, count_if(l.quality = 0) as n_skipped, round_even(avg(case when l.quality = 0 then 0 else length(d.text) % 3 end), 4) as mean_score,
    round_even(avg(case when l.quality <> 0 then length(d.text) % 3 end), 4) as judged_score from labels l join documents d using (doc_id) group by all""")
def judge_summary(tables):
    rows = tables("labels").join(tables("documents").select("doc_id", "lang", (F.length("text") % 3).alias("score")), "doc_id").withColumn("skipped", F.col("quality") == 0).withColumnRenamed("toxic", "verdict")
    return summary.judge_summary(rows, ["score"], "verdict", ["lang"])


@query("decimal_forms", "select l_orderkey, l_linenumber, rtrim(rtrim(cast(cast(l_extendedprice as decimal(18,2)) as varchar), '0'), '.') as price from lineitem")
def decimal_forms(tables):
    spelled = F.concat(F.lit("+00"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("0e0"))
    return tables("lineitem").select("l_orderkey", "l_linenumber", scores.decimal_form(spelled).alias("price"))


@query("extract_query_text")
def extract_query_text(tables):
    escaped = F.regexp_replace("text", r'(["\\])', r"\\$1")
    for end, name in (("\n", "n"), ("\r", "r"), ("\u0085", "u0085"), ("\u2028", "u2028"), ("\u2029", "u2029")):
        escaped = F.replace(escaped, F.lit(end), F.lit("\\" + name))
    raw = F.concat(F.lit("```sparql\n# note\nPREFIX x: <http://x/>\nselect ?d where { ?d x:text \""), escaped, F.lit('" . }\n```'))
    return tables("documents").select("doc_id", text.extract_query(raw).alias("query"), text.query_form(text.extract_query(raw)).alias("form"), text.comparison_form(raw).alias("compared"))


@query("normalize_text_compare", "select doc_id, trim(translate(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '\"''?.!,;:', '')) as key from documents")
def normalize_text_compare(tables):
    return tables("documents").select("doc_id", text.question_key(F.col("text")).alias("key"))


@query("placeholder_scan", "select page_id, len(list_distinct(regexp_extract_all(html, '\\{\\{[^{}]+\\}\\}|\\[\\[[^\\[\\]]+\\]\\]'))) as n_placeholders from pages")
def placeholder_scan(tables):
    return tables("pages").select("page_id", F.size(text.placeholders(F.col("html"))).cast("long").alias("n_placeholders"))
