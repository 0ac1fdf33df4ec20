"""Queries over what models write, over files that are written and read again, and over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import parsing, repair, text
from tessera.plans.registry import query
from tessera.sources import io, lists
from tessera.streaming import replay


def case(key, texts):
    """The text of each remainder of a key; `{n}` is the key."""
    n = F.col(key)
    parts = [F.replace(F.lit(t), F.lit("{n}"), n.cast("string")) if t is not None else F.lit(None).cast("string") for t in texts]
    return F.element_at(F.array(*parts), (n % len(texts) + 1).cast("int"))


def case_sql(key, texts):
    own = lambda t: "null" if t is None else "replace('" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + f"', '{{n}}', {key}::varchar)"
    return f"case {key} % {len(texts)} " + " ".join(f"when {i} then {own(t)}" for i, t in enumerate(texts)) + " end"


#: Queries as models write them, and as they are repaired.
REPAIRED = (
    ("SELECT ?p WHERE { FILTER NOT EXISTS ?c orkgp:P{n} ?d . ?d orkgp:P2 ?e . }", "SELECT ?p WHERE { FILTER NOT EXISTS { ?c orkgp:P{n} ?d . ?d orkgp:P2 ?e . } }"),
    ('SELECT ?p WHERE { FILTER(REGEX(LCASE(STR(?v)) = "a{n}") }', 'SELECT ?p WHERE { FILTER(LCASE(STR(?v)) = "a{n}") }'),
    ("SELECT ?p ?l WHERE { ?p orkgp:P{n} ?c . ?p rdfs:label ?l . } ORDER BY ?l", "SELECT ?p ?l WHERE { ?p orkgp:P{n} ?c . OPTIONAL { ?p rdfs:label ?l . } } ORDER BY ?l"),
    ("```sparql\nSELECT ?p WHERE ?p orkgp:P{n} ?x . LIMIT 3\n```", "SELECT ?p WHERE { ?p orkgp:P{n} ?x . } LIMIT 3"),
    ("SELECT ?p WHERE { ?p orkgp:P{n} ?x . OPTIONAL ?p orkgp:P2 ?y . ORDER BY ?p }", "SELECT ?p WHERE { ?p orkgp:P{n} ?x . OPTIONAL { ?p orkgp:P2 ?y . } } ORDER BY ?p"),
    (None, None),
    ('SELECT ?p WHERE { FILTER(REGEX(?label, "b{n}")) }', 'SELECT ?p WHERE { FILTER(REGEX(?label, "b{n}")) }'),
)


@query("repair_queries", f"select page_id, {case_sql('page_id', [b for _, b in REPAIRED])} as repaired from pages")
def repair_queries(tables):
    return tables("pages").select("page_id", repair.repaired(case("page_id", [a for a, _ in REPAIRED])).alias("repaired"))


#: Queries, and their patterns with variables made alike.
STRUCTURED = (
    ("SELECT ?a WHERE { ?a orkgp:Q{n} ?b ; orkgp:P2 ?c . FILTER(?c > 3) }", "?VAR orkgp:P2 ?VAR | ?VAR orkgp:Q{n} ?VAR | FILTER ( ?VAR > 3 )"),
    ("ASK { ?x a orkgc:C{n} . OPTIONAL { ?x rdfs:label ?l . } }", "?VAR a orkgc:C{n} | ?VAR rdfs:label ?VAR"),
    ("ASK", ""),
)


@query("query_structure", f"select page_id, {case_sql('page_id', [b for _, b in STRUCTURED])} as patterns from pages")
def query_structure(tables):
    return tables("pages").select("page_id", F.array_join(F.array_sort(repair.structure(case("page_id", [a for a, _ in STRUCTURED]))), " | ").alias("patterns"))


#: Answers of models, and the query in them, its form and how it is stored.
EXTRACTED = (
    ("```sparql\n# a note\nSELECT ?s WHERE { ?s ?p {n} }\n```", "SELECT ?s WHERE { ?s ?p {n} }", "select"),
    ("ASK { ?s ?p {n} }", "ASK { ?s ?p {n} }", "ask"),
)


@query("extract_forms", f"select page_id, {case_sql('page_id', [b for _, b, _ in EXTRACTED])} as query, {case_sql('page_id', [c for _, _, c in EXTRACTED])} as form from pages")
def extract_forms(tables):
    found = text.extract_query(case("page_id", [a for a, _, _ in EXTRACTED]))
    return tables("pages").select("page_id", found.alias("query"), text.query_form(found).alias("form"))


#: Spellings of one query, and the form in which they are compared.
COMPARED = (
    ("select  ?s where { ?s ?p {n} } # end", "select ?s where { ?s ?p {n} }"),
    ("```sparql\nselect ?s\nwhere { ?s ?p {n} }\n```", "select ?s where { ?s ?p {n} }"),
)


@query("comparison_forms", f"select page_id, {case_sql('page_id', [b for _, b in COMPARED])} as query, 8::bigint as n_tokens from pages")
def comparison_forms(tables):
    form = text.comparison_form(case("page_id", [a for a, _ in COMPARED]))
    return tables("pages").select("page_id", form.alias("query"), F.size(text.tokens(form)).cast("long").alias("n_tokens"))


JUDGED = "(select conv_id, turn, turn % 3 as a, conv_id % 4 as b, case turn % 4 when 0 then 'Correct' when 1 then 'partly correct' when 2 then 'odd' else 'in-correct' end as said from conversations)"


@query(
    "parse_judgements",
    f"""select conv_id, turn, case when turn = 5 then 'no_json' when b > 2 then 'bad_schema_score' when said in ('odd', 'in-correct') then 'bad_verdict' end as reason, case when turn <> 5 then a + b + 3 end as overall_score,
      case when turn = 5 then null when said = 'Correct' then 'correct' when said = 'partly correct' then 'partially_correct' end as verdict from {JUDGED}""",
)
def parse_judgements(tables):
    n, said = F.col("turn"), F.element_at(F.array(*[F.lit(v) for v in ("Correct", "partly correct", "odd", "in-correct")]), (F.col("turn") % 4 + 1).cast("int"))
    body = F.to_json(F.struct((n % 3).alias("intent_score"), (F.col("conv_id") % 4).alias("schema_score"), *[F.lit(1).alias(f"{s}_score") for s in parsing.SCORES[2:]], said.alias("verdict"), F.lit("x").alias("main_issue")))
    raw = F.when(n == 5, "none of it").otherwise(F.concat(F.lit("Sure:\n"), body, F.lit(" done")))
    return tables("conversations").select("conv_id", "turn", parsing.judgement(raw).alias("j")).select("conv_id", "turn", "j.reason", F.col("j.overall_score").cast("long").alias("overall_score"), "j.verdict")


#: What models answer, and the answer in it.
ANSWERED = (('x {"final_answer": "a{n}"} y', "a{n}"), ("so \\boxed{b{n}}", None), ("The answer is: c{n}\nbye", "c{n}"), ("x\n d{n} \n\n", "d{n}"), ('{"answer": "e{n}", "z": [1', "e{n}"))


@query("final_answers", f"select page_id, case when page_id % 5 = 1 then 'b' || page_id else {case_sql('page_id', [b for _, b in ANSWERED])} end as answer from pages")
def final_answers(tables):
    return tables("pages").select("page_id", parsing.final_answer(case("page_id", [a for a, _ in ANSWERED])).alias("answer"))


@query(
    "error_heuristics",
    """select page_id, page_id % 3 = 0 or page_id % 3 = 2 as cut_off, case when page_id % 2 = 0 then 400 + page_id % 100 end as status, case when page_id % 2 = 0 then 'HTTP #: at # ms' else 'odd # of it' end as signature,
      'ab-' || lpad(page_id::varchar, 5, '0') || ' misc-00001' as bullets from pages""",
)
def error_heuristics(tables):
    n = F.col("page_id")
    q = case("page_id", ["SELECT ?x WHERE { ?x a {n}", "ASK { ?s ?p {n} }", "SELECT ?x { ?x ?p {n} } GROUP BY"])
    error = F.when(n % 2 == 0, F.concat(F.lit("HTTP "), 400 + n % 100, F.lit(":  at 12 ms"))).otherwise(F.concat(F.lit("odd "), n, F.lit(" of\n it")))
    said = F.concat(F.lit("used [ab-"), F.lpad(n.cast("string"), 5, "0"), F.lit("], [misc-00001] and [misc-00001], not [x-1]"))
    return tables("pages").select("page_id", parsing.looks_truncated(q).alias("cut_off"), F.when(n % 2 == 0, parsing.http_status(error)).alias("status"), parsing.error_signature(error).alias("signature"), F.array_join(parsing.bullet_ids(said), " ").alias("bullets"))


# --- files ------------------------------------------------------------------


@query("entries_round_trip", "select 'nation-' || n_nationkey as id, 'f' || n_regionkey as family, n_name as question, 'a b' as special_types, n_nationkey as pos from nation where n_regionkey = 1")
def entries_round_trip(tables):
    """Entries are written as one wrapped file and read again with a filter; place is that in the file."""
    rows = tables("nation").coalesce(1).orderBy("n_nationkey").select(F.concat(F.lit("nation-"), "n_nationkey").alias("id"), F.concat(F.lit(" f"), "n_regionkey").alias("family"), F.col("n_name").alias("question"), F.array(F.lit("a"), F.lit("b")).alias("special_types"), F.lit(1).alias("unknown"))
    path = io.scratch(tables.spark)
    io.write_wrapped(rows, path)
    back = io.read_entries(tables.spark, path, {"family": "f1"})
    return back.select("id", F.trim("family").alias("family"), "question", F.array_join("special_types", " ").alias("special_types"), "pos")


@query("list_round_trip", "select 'region-' || r_regionkey as id, r_name as question from region")
def list_round_trip(tables):
    """A file that is a bare list reads like a wrapped one."""
    path = io.scratch(tables.spark)
    io.write_wrapped(tables("region").select(F.concat(F.lit("region-"), "r_regionkey").alias("id"), F.col("r_name").alias("question")), path, None)
    return io.read_entries(tables.spark, path).select("id", "question")


@query("long_lists_round_trip", "select conv_id, turn, role, text, role || ' of ' || conv_id as nested from conversations")
def long_lists_round_trip(tables):
    """Turns are written as JSON lists by many tasks; each list is read by as many as it has ranges."""
    path = io.scratch(tables.spark)
    turns = tables("conversations").select("conv_id", "turn", "role", "text", F.array(F.struct(F.concat_ws(" of ", "role", "conv_id").alias("}"))).alias("items"))
    lists.write_lists(turns, path)
    return io.read_long_lists(tables.spark, path, turns.schema).select("conv_id", "turn", "role", "text", F.element_at("items", 1)["}"].alias("nested"))


@query("results_round_trip", "select n_regionkey as region, 'x' as variable, n_name as value from nation")
def results_round_trip(tables):
    """Answer files in the results format, one a region, read as cells."""
    term = F.create_map(F.lit("x"), F.struct(F.lit("literal").alias("type"), F.col("n_name").alias("value")))
    files = tables("nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.struct(F.collect_list(term).alias("bindings")).alias("results"))).alias("value"))
    path = io.scratch(tables.spark)
    files.write.partitionBy("n_regionkey").text(path)
    found = io.read_results(tables.spark, f"{path}/*/*.txt").withColumn("region", F.regexp_extract("file", r"n_regionkey=(\d+)/", 1).cast("long"))
    return io.bindings_to_cells(found, "region").select("region", "variable", "value")


@query("texts_round_trip", "select n_regionkey as region, n_nationkey as nation, n_name as name from nation")
def texts_round_trip(tables):
    """Texts are found below a folder by their suffix, and read line by line."""
    path = io.scratch(tables.spark)
    tables("nation").select("n_regionkey", F.concat_ws(" ", "n_nationkey", "n_name").alias("value")).repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    whole = io.read_texts(tables.spark, path, ["txt"]).select(F.regexp_extract("file", r"n_regionkey=(\d+)/", 1).cast("long").alias("region"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return whole.select("region", F.substring_index("line", " ", 1).cast("long").alias("nation"), F.regexp_replace("line", r"^\d+ ", "").alias("name"))


@query("renumbered", "select row_number() over (order by src, key) as id, key from (select 0 as src, n_nationkey as key from nation union all select 1, r_regionkey from region)")
def renumbered(tables):
    return io.concat_renumbered([tables("nation").select(F.col("n_nationkey").alias("key")), tables("region").select(F.col("r_regionkey").alias("key"))], ["key"]).select(F.col("id").cast("long").alias("id"), "key")


# --- streams ----------------------------------------------------------------


def streamed(tables, table, columns):
    """A table as a stream of its rows."""
    path = io.scratch(tables.spark)
    tables(table).select(*columns).write.parquet(path)
    return tables.spark.readStream.schema(tables.spark.read.parquet(path).schema).parquet(path)


def drained(stream, mode, spark):
    """What a stream gives until its input ends, by way of a folder: all batches' rows, or in complete mode the last one's."""
    sink = replay.BatchSink(io.scratch(spark))
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", io.scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    out = sink.read(spark)
    if mode == "complete":
        out = out.where(F.col("batch") == spark.read.parquet(sink.manifest).agg(F.max("batch")).first()[0])
    return out.drop("batch")


@query("stream_windows", "select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by all")
def stream_windows(tables):
    stream = streamed(tables, "events", [F.col("ts").cast("timestamp").alias("ts"), "event_type"])
    out = drained(replay.event_windows(stream, "ts", "1 day", None, "1 hour", [F.col("event_type")], [F.count(F.lit(1)).alias("n")]), "complete", tables.spark)
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "stream_sessions",
    """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 12 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
    select user_id, k as session, n from (select user_id, k, count(*) as n from s group by all)""",
)
def stream_sessions(tables):
    from pyspark.sql import Window

    stream = streamed(tables, "events", [F.col("ts").cast("timestamp").alias("ts"), "user_id"])
    out = drained(replay.sessions(stream, "ts", "12 hours", "1 hour", [F.col("user_id")], [F.count(F.lit(1)).alias("n")]), "complete", tables.spark)
    return out.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("long").alias("session"), "n")


@query("stream_rules", "select event_type as family, user_id % 7 as rule, count_if(event_id % 3 = 0) as helpful, count_if(event_id % 3 = 1) as harmful, count(*) as seen from events group by all")
def stream_rules(tables):
    """Counters of each rule, kept as state; the last of each key counts."""
    stream = streamed(tables, "events", [F.col("event_type").alias("family"), (F.col("user_id") % 7).cast("string").alias("rule"), F.when(F.col("event_id") % 3 == 0, "helpful").when(F.col("event_id") % 3 == 1, "harmful").otherwise("neutral").alias("tag")])
    out = drained(replay.rule_records(stream), "update", tables.spark)
    last = F.max_by(F.struct("helpful", "harmful", "seen"), "seen").alias("x")
    return out.groupBy("family", "rule").agg(last).select("family", F.col("rule").cast("long").alias("rule"), "x.*")
