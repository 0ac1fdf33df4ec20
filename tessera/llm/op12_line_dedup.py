"""Line deduplication with DataFrame functions only.

Lines are split at \\n. A line's key is the line without `BLANKS` at both ends,
A-Z lower-cased; keys of at least `least_chars` code points count. Keys are
hashed to 128 bits, exploded once for each document that holds them, and the
distinct documents of each hash are counted: partial counts first, so a line
that a third of all documents share costs a row for each task. A key found in
`least_docs` documents or more loses all its lines, except in the smallest
document that holds it. The places of these lines come back to their documents
as arrays, and each text is put together again from the other lines by
position. Only hashes and places are shuffled by line; texts are shuffled once,
by document. Hot lines and hot documents meet their partner in joins that
adaptive execution can split.

Defined results: a null or empty text is one empty line, which stays. Rows with
equal keys are one document, rows with a null key as well, which counts as the
largest. A key that repeats within one document alone stays. Lines that tie are
equal keys, so all of a document's go or stay together; of repeated rows each
gives its own result. Very long texts are read whole. Different lines share a
128-bit hash with a chance of about 2^-128 a pair. An empty table gives no
rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, row_name, table

LEAST_DOCS, LEAST_CHARS = 2, 10
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped and with A-Z lower-cased; lower() does the same to ASCII, at a fraction of the cost."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hash(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(12), key).alias("b"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, n_lines, n_dropped, kept) of every row; kept is the text of the lines that stay."""
    own = row_name(docs, key, text)
    document = F.struct(own["none"].alias("none"), own["id"].alias("id"))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")

    placed = docs.select(own.alias("own"), document.alias("document"), F.posexplode(lines).alias("pos", "line"))
    keyed = placed.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= least_chars).select("own", "document", "pos", line_hash(F.col("line")).alias("line"))

    found = keyed.groupBy("line", "document").agg(F.count(F.lit(1)).alias("n")).groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.min("document").alias("first"))
    # Written, so that the join has a shuffle of its own on both sides and a hot line's rows can be split.
    shared = materialize(found.where(F.col("docs") >= least_docs).select("line", "first"), "shared")
    lost = keyed.join(shared, "line").where(F.col("document") != F.col("first")).groupBy("own").agg(F.collect_set("pos").alias("lost"))

    rows = docs.select(F.col(key), own.alias("own"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(lost, "own", "left")
    split = rows.withColumn("_lines", F.split("_text", "\n")).withColumn("_n", F.size("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("lost"))
    split = split.withColumn("_stay", F.when(F.col("lost").isNotNull(), stay))
    kept = F.when(F.col("_stay").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n"))
    dropped = F.when(F.col("_stay").isNull(), F.lit(0)).otherwise(F.col("_n") - F.size("_stay"))
    return split.select(key, F.col("_n").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: line counts and a digest of what stays of every document."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = r"""
with split as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
placed as (
  select r, doc_id, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as line from split),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from placed),
shared as (
  select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
flagged as (
  select k.*, s.key is not null and k.doc_id <> s.first as lost from keyed k left join shared s on s.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from flagged group by r, doc_id
"""
