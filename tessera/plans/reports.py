"""Queries that report on runs, terms and playbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import reports
from tessera.plans.registry import query

MINED = """(select p_partkey as pos, '{"list": [{"uri": "orkgp:P' || p_partkey || '", "more": {"name": "see pgmr:t' || (p_size % 9) || ' twice pgmr:t' || (p_size % 9) || '"}}, {"x": "orkgc:C1 orkgc:C2 pgmr:none"}]}' as body, p_size % 9 as t from part)"""


@query("mined_mapping", f"select 'pgmr:t' || t as token, max_by('orkgp:P' || pos, pos) as target from {MINED} group by 1")
def mined_mapping(tables):
    k, t = F.col("p_partkey").cast("string"), (F.col("p_size") % 9).cast("string")
    body = F.concat(F.lit('{"list": [{"uri": "orkgp:P'), k, F.lit('", "more": {"name": "see pgmr:t'), t, F.lit(" twice pgmr:t"), t, F.lit('"}}, {"x": "orkgc:C1 orkgc:C2 pgmr:none"}]}'))
    return reports.mined_mapping(tables("part").select(F.col("p_partkey").alias("pos"), body.alias("body")), "body", "pos")


@query(
    "usability_counters",
    "select event_type, count(*) as total, count_if(value > 50) as usable_count, round_even(count_if(value > 50) / count(*), 4) as usable_rate, count_if(event_id % 3 = 0) as restored_count, round_even(count_if(event_id % 3 = 0) / count(*), 4) as restored_rate from events group by 1",
)
def usability_counters(tables):
    return reports.counters(tables("events"), {"usable": F.col("value") > 50, "restored": F.col("event_id") % 3 == 0}, ["event_type"])


@query(
    "terms_by_split",
    """with t as (select l_returnflag as family, l_suppkey as uri, case l_orderkey % 3 when 0 then 'train' when 1 then 'test' else 'other' end as split, l_partkey as example from lineitem),
    e as (select family, uri, example, row_number() over (partition by family, uri order by example) as n from (select distinct family, uri, example from t)),
    x as (select family, uri, array_to_string(list(example order by example), ' ') as examples from e where n <= 5 group by all),
    c as (select family, uri, count(*) as total, count_if(split = 'train') as train, count_if(split = 'test') as test from t group by all)
    select c.*, x.examples, row_number() over (order by total desc, family, uri) as place from c join x using (family, uri)""",
)
def terms_by_split(tables):
    o = F.col("l_orderkey") % 3
    terms = tables("lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("uri"), F.when(o == 0, "train").when(o == 1, "test").otherwise("other").alias("split"), F.col("l_partkey").alias("example"))
    return reports.terms_by_split(terms, ["family", "uri"], "split", ["train", "test"], "example").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), " "))


@query("top_terms", "with w as (select unnest(string_split(text, ' ')) as term from conversations) select term, count(*) as n from w group by 1 order by n desc, term limit 30")
def top_terms(tables):
    """The limit is the feature: the thirty most frequent terms."""
    return reports.top_terms(tables("conversations").select(F.explode(F.split("text", " ")).alias("term")), "term")


@query(
    "gold_enrichment",
    "select c_custkey, c_name, coalesce(max_by(o_orderstatus, o_orderkey), 'not_executed') as status, max_by(o_orderkey % 5, o_orderkey) as cardinality, max_by(case when o_orderstatus = 'F' then 'e' || o_orderkey else '' end, o_orderkey) as error from customer left join orders on o_custkey = c_custkey group by 1, 2",
)
def gold_enrichment(tables):
    o = F.col("o_orderkey")
    runs = tables("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), (o % 5).alias("cardinality"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("e"), o)).otherwise("").alias("error"), o.alias("pos"))
    return reports.executed(tables("customer").select("c_custkey", "c_name"), runs, "c_custkey")


@query("judged_summaries", "with j as (select o_orderpriority as run, round_even(avg(o_custkey % 3), 4) as mean, count(*) as n from orders where o_orderpriority < '4' group by 1), s as (select o_orderpriority as run, count(*) as items from orders group by 1) select run, items, j.mean as judge_mean, j.n as judge_n from s left join j using (run)")
def judged_summaries(tables):
    orders = tables("orders").withColumn("run", F.col("o_orderpriority"))
    judged = orders.where("run < '4'").groupBy("run").agg(F.bround(F.avg(F.col("o_custkey") % 3), 4).alias("mean"), F.count(F.lit(1)).alias("n"))
    both = reports.with_judgement(orders.groupBy("run").agg(F.count(F.lit(1)).alias("items")), judged, "run")
    return both.select("run", "items", F.col("llm_judge.mean").alias("judge_mean"), F.col("llm_judge.n").alias("judge_n"))


@query(
    "rendered_playbooks",
    """with r as (select n_nationkey % 2 as book, n_regionkey as section, n_nationkey as position, n_name as content, min(n_nationkey) over (partition by n_nationkey % 2, n_regionkey) as s from nation),
    n as (select *, row_number() over (partition by book order by s, position) as n, dense_rank() over (partition by book order by s) as k from r)
    select book, string_agg(case when position = s then '## region ' || section || chr(10) else '' end || '[s' || k || '-' || lpad(n::varchar, 5, '0') || '] helpful=1 harmful=0 :: ' || content, chr(10) order by n) as text from n group by 1""",
)
def rendered_playbooks(tables):
    k = F.col("n_nationkey")
    rows = tables("nation").select((k % 2).alias("book"), F.concat(F.lit("region "), "n_regionkey").alias("section"), k.alias("position"), F.lit(1).alias("helpful"), F.lit(0).alias("harmful"), F.col("n_name").alias("content"))
    return reports.rendered(rows, "book", "section", "position")


@query(
    "item_playbooks",
    """with p as (select s_suppkey as item, 0 as f, 0 as r, 'plan ' || s_suppkey as content from supplier union all select s_suppkey, 1, n_nationkey, 'rule ' || n_name from supplier join nation on n_nationkey % 5 = s_suppkey % 5 union all select s_suppkey, 2, n_nationkey, 'rule ' || n_name from supplier, (select * from nation where n_nationkey < 4)),
    o as (select item, content, min(f * 1000 + r) as at_ from p group by all) select item, row_number() over (partition by item order by at_, content) as place, content from o""",
)
def item_playbooks(tables):
    s, n = tables("supplier").select(F.col("s_suppkey").alias("item")), tables("nation")
    rule = F.concat(F.lit("rule "), "n_name").alias("content")
    ranked = s.withColumn("_m", F.col("item") % 5).join(n.withColumn("_m", F.col("n_nationkey") % 5), "_m").select("item", F.col("n_nationkey").cast("int").alias("rank"), rule)
    return reports.item_playbook(s.select("item", F.concat(F.lit("plan "), "item").alias("content")), ranked, n.where("n_nationkey < 4").select(F.col("n_nationkey").cast("int").alias("rank"), rule), "item")


@query("compaction_points", "with l as (select user_id, event_id, value > 50 as ok, sum((value > 50)::int) over (partition by user_id order by event_id rows unbounded preceding) as n from events) select user_id, event_id from l where ok and n % 4 = 0")
def compaction_points(tables):
    return reports.compactions(tables("events"), "user_id", "event_id", F.col("value") > 50, 4)


@query(
    "class_tree",
    """with p as (select n_regionkey as template, n_name as property, case when n_nationkey % 3 = 0 then (n_nationkey + 1) % 5 end as target from nation)
    select a.template, a.property, b.property as child_property, c.property as grandchild_property from p a left join p b on a.target = b.template left join p c on b.target = c.template""",
)
def class_tree(tables):
    k = F.col("n_nationkey")
    return reports.class_tree(tables("nation").select(F.col("n_regionkey").cast("long").alias("template"), F.col("n_name").alias("property"), F.when(k % 3 == 0, (k + 1) % 5).cast("long").alias("target")))


@query(
    "class_lines",
    """with recursive p as (select p_partkey % 300 as template, p_partkey as o, p_name || ' ' || p_partkey as property, case when p_partkey % 10 = 0 then (p_partkey * 7 + 1) % 300 end as target from part),
    r(template, path, seen, property, target) as (select template, [o], [template], property, target from p union all select r.template, list_append(r.path, p.o), list_append(r.seen, p.template), p.property, p.target from r join p on r.target = p.template where not list_contains(r.seen, r.target))
    select template, row_number() over (partition by template order by path) as place, repeat('  ', len(path) - 1) || '- ' || property as line from r""",
)
def class_lines(tables):
    """Every template with what is below it, to any depth; templates may lead back to themselves."""
    k = F.col("p_partkey")
    properties = tables("part").select((k % 300).alias("template"), k.alias("order"), F.concat_ws(" ", "p_name", k).alias("property"), F.when(k % 10 == 0, (k * 7 + 1) % 300).alias("target"))
    return reports.class_lines(properties, "order")


@query("call_prices", "select event_id, case event_type when 'click' then round_even((event_id * 2.0 + user_id * 8.0) / 1e6, 8) when 'error' then round_even((event_id * 0.5 + user_id * 1.0) / 1e6, 8) end as dollars from events")
def call_prices(tables):
    return tables("events").select("event_id", reports.price(F.col("event_id"), F.col("user_id"), F.col("event_type"), {"click": (2.0, 8.0), "error": (0.5, 1.0)}).alias("dollars"))


@query("feedback_documents", """select doc_id, '{"lang":"' || lang || '","id":"' || doc_id || '"' || case when doc_id % 2 = 0 then ',"source":"' || source || '"' else '' end || '}' as feedback from documents""")
def feedback_documents(tables):
    fields = {"lang": F.col("lang"), "id": F.col("doc_id"), "none": F.lit(None).cast("string"), "blank": F.lit(""), "source": F.when(F.col("doc_id") % 2 == 0, F.col("source"))}
    return tables("documents").select("doc_id", reports.feedback(fields).alias("feedback"))


@query("enrichment_summary", "select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'overall' end as slice, coalesce(case when grouping(lang) = 0 then lang when grouping(source) = 0 then source else 'all' end, '__missing__') as slice_value, count(*) as n from documents group by grouping sets ((lang), (source), ())")
def enrichment_summary(tables):
    from tessera.operators import summary

    return summary.slices(tables("documents").select("lang", "source"), ["lang", "source"], [F.count(F.lit(1)).alias("n")])
