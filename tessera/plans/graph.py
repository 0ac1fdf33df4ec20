"""Graph-pattern queries over the tables read as triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.plans import sparql
from tessera.plans.registry import query


def as_triples(tables):
    """Nations, regions, customers, suppliers and orders as triples of text.

    One branch of a union for each predicate, with the predicate a literal: a
    pattern's constant predicate folds all other branches away, so a pattern
    reads the two columns of the one table that it is about.
    """
    iri = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))

    def of(table, key, prefix, columns):
        df, s = tables(table), iri(prefix, key).alias("s")
        yield df.select(s, F.lit("rdf:type").alias("p"), F.lit(f"t:{table}").alias("o"))
        for p, c in columns.items():
            o = iri(*c) if isinstance(c, tuple) else F.col(c).cast("string")
            yield df.where(F.col(c[1] if isinstance(c, tuple) else c).isNotNull()).select(s, F.lit(p).alias("p"), o.alias("o"))

    return reduce(lambda a, b: a.unionByName(b), [
        *of("region", "r_regionkey", "region", {"t:name": "r_name"}),
        *of("nation", "n_nationkey", "nation", {"t:name": "n_name", "t:in": ("region", "n_regionkey")}),
        *of("supplier", "s_suppkey", "supplier", {"t:name": "s_name", "t:nation": ("nation", "s_nationkey"), "t:balance": "s_acctbal"}),
        *of("customer", "c_custkey", "customer", {"t:name": "c_name", "t:nation": ("nation", "c_nationkey"), "t:segment": "c_mktsegment", "t:balance": "c_acctbal"}),
        *of("orders", "o_orderkey", "order", {"t:by": ("customer", "o_custkey"), "t:status": "o_orderstatus", "t:price": "o_totalprice", "t:priority": "o_orderpriority"}),
    ])


CASES = {
    "sparql_bgp": ("SELECT ?name ?region WHERE { ?n a t:nation ; t:name ?name ; t:in ?r . ?r t:name ?region . }", "select n_name as name, r_name as region from nation join region on n_regionkey = r_regionkey"),
    "sparql_optional": (
        "SELECT ?c ?o WHERE { ?c a t:customer ; t:segment \"BUILDING\" . OPTIONAL { ?o t:by ?c ; t:status \"P\" . } }",
        "select 'customer:' || c_custkey as c, 'order:' || o_orderkey as o from customer left join (select * from orders where o_orderstatus = 'P') on o_custkey = c_custkey where c_mktsegment = 'BUILDING'",
    ),
    "sparql_filter_regex": (
        "SELECT ?s ?b WHERE { ?s a t:supplier ; t:name ?n ; t:balance ?b . FILTER(REGEX(?n, \"5$\", \"i\") && ?b > 0 && CONTAINS(LCASE(STR(?n)), \"supplier\")) }",
        "select 'supplier:' || s_suppkey as s, cast(s_acctbal as varchar) as b from supplier where s_name like '%5' and s_acctbal > 0 and contains(lower(s_name), 'supplier')",
    ),
    "sparql_union": (
        "SELECT ?x ?b WHERE { { ?x a t:supplier . } UNION { ?x a t:customer ; t:segment \"MACHINERY\" . } ?x t:balance ?b . FILTER(?b < 0) }",
        "select 'supplier:' || s_suppkey as x, cast(s_acctbal as varchar) as b from supplier where s_acctbal < 0 union all select 'customer:' || c_custkey, cast(c_acctbal as varchar) from customer where c_mktsegment = 'MACHINERY' and c_acctbal < 0",
    ),
    "sparql_not_exists": ("SELECT ?c WHERE { ?c a t:customer . FILTER NOT EXISTS { ?o t:by ?c ; t:status \"F\" . } }", "select 'customer:' || c_custkey as c from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')"),
    "sparql_exists": ("SELECT ?n WHERE { ?n a t:nation . FILTER EXISTS { ?s t:nation ?n ; a t:supplier ; t:balance ?b . FILTER(?b > 9000) } }", "select 'nation:' || n_nationkey as n from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 9000)"),
    "sparql_group_having": (
        "SELECT ?name (COUNT(?c) AS ?n) WHERE { ?c a t:customer ; t:nation ?x . ?x t:name ?name . } GROUP BY ?name HAVING (COUNT(?c) > 55)",
        "select n_name as name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name having count(*) > 55",
    ),
    "sparql_count_distinct": ("SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(?o) AS ?m) WHERE { ?o a t:orders ; t:by ?c . }", "select count(distinct o_custkey) as n, count(*) as m from orders"),
    "sparql_minmaxavg": (
        "SELECT ?s (MIN(?b) AS ?low) (MAX(?b) AS ?high) (ROUND(AVG(?b) * 100) / 100 AS ?mean) WHERE { ?c t:segment ?s ; t:balance ?b . } GROUP BY ?s",
        "select c_mktsegment as s, cast(min(c_acctbal) as varchar) as low, cast(max(c_acctbal) as varchar) as high, round(avg(c_acctbal) * 100) / 100 as mean from customer group by 1",
    ),
    "sparql_subselect": (
        "SELECT ?name ?n WHERE { ?x t:name ?name ; t:in ?r . ?r t:name \"ASIA\" . { SELECT ?x (COUNT(?s) AS ?n) WHERE { ?s a t:supplier ; t:nation ?x . } GROUP BY ?x } }",
        "select n_name as name, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by n_name",
    ),
    "sparql_order_limit": (
        "SELECT DISTINCT ?c ?p WHERE { ?o t:by ?c ; t:price ?p ; t:status \"O\" . } ORDER BY DESC(?p) ?c LIMIT 10",
        "select distinct 'customer:' || o_custkey as c, cast(o_totalprice as varchar) as p, o_totalprice from orders where o_orderstatus = 'O' order by o_totalprice desc, c limit 10",
    ),
    "sparql_ask": ("ASK { ?n t:name \"NATION_3\" ; a t:nation . }", "select count(*) > 0 as answer from nation where n_name = 'NATION_3'"),
    "sparql_bind_if": (
        "SELECT ?level (COUNT(?s) AS ?n) WHERE { ?s a t:supplier ; t:balance ?b . BIND(IF(?b > 5000, \"high\", IF(?b > 0, \"low\", \"debt\")) AS ?level) } GROUP BY ?level",
        "select case when s_acctbal > 5000 then 'high' when s_acctbal > 0 then 'low' else 'debt' end as level, count(*) as n from supplier group by 1",
    ),
    "sparql_values": (
        "SELECT ?n ?c WHERE { VALUES (?name ?tag) { (\"NATION_3\" 1) (\"NATION_7\" 2) } ?x t:name ?name . ?c t:nation ?x ; a t:customer . BIND(CONCAT(?name, \"-\", ?tag) AS ?n) }",
        "select n_name || case n_name when 'NATION_3' then '-1' else '-2' end as n, 'customer:' || c_custkey as c from customer join nation on c_nationkey = n_nationkey where n_name in ('NATION_3', 'NATION_7')",
    ),
}
CASES["sparql_order_limit"] = (CASES["sparql_order_limit"][0], f"select c, p from ({CASES['sparql_order_limit'][1]})")

for _name, (_text, _sql) in CASES.items():
    query(_name, _sql)(lambda tables, _text=_text: sparql.run(_text, as_triples(tables)))


def linked(tables):
    """The triples, and for each customer but the first the one that it came after and one that it knows, in circles."""
    k, iri = F.col("c_custkey"), lambda e: F.concat(F.lit("customer:"), e.cast("long").cast("string"))
    c = tables("customer").withColumn("n", F.lit(50))
    after = c.where(k > 0).select(iri(k).alias("s"), F.lit("t:after").alias("p"), iri(F.floor(k / 3)).alias("o"))
    knows = c.where(k < 60).select(iri(k).alias("s"), F.lit("t:knows").alias("p"), iri((k * 7 + 1) % 60).alias("o"))
    return as_triples(tables).unionByName(after).unionByName(knows)


CLOSED = "with recursive f as (select c_custkey as x, c_custkey // 3 as y from customer where c_custkey > 0), k as (select c_custkey as x, (c_custkey * 7 + 1) % 60 as y from customer where c_custkey < 60), r(x, y) as (select x, y from f union select r.x, f.y from r join f on r.y = f.x), q(x, y) as (select x, y from k union select q.x, k.y from q join k on q.y = k.x)"
PATHS = {
    "sparql_path_sequence": (
        "SELECT ?o ?r WHERE { ?o t:status \"P\" ; t:by/t:nation/t:in ?r . }",
        "select 'order:' || o_orderkey as o, 'region:' || n_regionkey as r from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'P'",
    ),
    "sparql_path_plus": ("SELECT ?x ?y WHERE { ?x t:after+ ?y . }", f"{CLOSED} select 'customer:' || x as x, 'customer:' || y as y from r"),
    "sparql_path_star_in_circles": ("SELECT ?y WHERE { <customer:3> (t:knows|^t:knows)* ?y . }", "with recursive k as (select c_custkey as x, (c_custkey * 7 + 1) % 60 as y from customer where c_custkey < 60), e as (select x, y from k union select y, x from k), q(y) as (select 3::bigint union select e.y from q join e on q.y = e.x) select 'customer:' || y as y from q"),
    "sparql_path_back_to_a_constant": ("SELECT ?x ?n WHERE { ?x t:after+ <customer:2> ; t:nation/t:name? ?n . }", f"{CLOSED} select 'customer:' || x as x, n from r join customer on c_custkey = x join (select n_nationkey, n_name as n from nation union all select n_nationkey, 'nation:' || n_nationkey from nation) on n_nationkey = c_nationkey where y = 2"),
    "sparql_minus": ("SELECT ?c WHERE { ?c a t:customer ; t:nation ?n . MINUS { ?o t:by ?c ; t:status \"F\" . } MINUS { ?z t:in ?n . } }", "select 'customer:' || c_custkey as c from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')"),
    "sparql_minus_unbound": (
        "SELECT ?c ?b WHERE { ?c a t:customer . OPTIONAL { ?c t:knows ?b . } MINUS { ?c t:after ?a . OPTIONAL { ?c t:knows ?b . FILTER(?b != <customer:8>) } } }",
        "with c as (select c_custkey as c, case when c_custkey < 60 then (c_custkey * 7 + 1) % 60 end as b from customer) select 'customer:' || c as c, 'customer:' || b as b from c where not (c > 0)",
    ),
}
for _name, (_text, _sql) in PATHS.items():
    query(_name, _sql)(lambda tables, _text=_text: sparql.run(_text, linked(tables)))
