"""Reviews of candidates: executed results, buckets, strict joins, and checks of batches, types and schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets of a review, and what belongs to each family.
BUCKETS = ("green", "yellow", "red")
SOURCE_OF_FAMILY = {"nlp4re": "Hybrid_NLP4RE", "empirical_research_practice": "Hybrid_Empirical_Research"}
SCHEMA_OF_FAMILY = {"nlp4re": "nlp4re", "empirical_research_practice": "empirical-research-practice"}
TEST_RANK = {"EmpiRE_Compass": 0, "Hybrid_NLP4RE": 1, "Hybrid_Empirical_Research": 1}
VALIDATION_RANK = {"Hybrid_NLP4RE": 0, "Hybrid_Empirical_Research": 0, "EmpiRE_Compass": 1, "Generated_NLP4RE": 2, "Generated_Empirical_Research": 2}
COMPLEXITY_RANK = {"low": 0, "medium": 1, "high": 2}
GENERIC = r"orkgp:has[A-Za-z0-9_]+"


def lookup(table: Mapping[str, object], key: Column, default: object | None = None) -> Column:
    """A small fixed table as a map; `default` for what it lacks."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def complexity_rank(level: Column) -> Column:
    return lookup(COMPLEXITY_RANK, level, -1)


def source_rank(source: Column, validation: bool = False) -> Column:
    return lookup(VALIDATION_RANK if validation else TEST_RANK, source, 9)


def source_of(family: Column) -> Column:
    """The source that a family's candidates come from; another family is an error."""
    return F.coalesce(lookup(SOURCE_OF_FAMILY, family), F.raise_error(F.concat(F.lit("unknown family: "), F.coalesce(family, F.lit("null")))).cast("string"))


def schema_id(source_id: Column, family: Column) -> Column:
    """`{schema}-{nnnn}` from the digits at the end of an id; null where there are none or the family is unknown."""
    digits = F.regexp_extract(source_id, r"(\d+)$", 1).try_cast("long")
    return F.when(digits.isNotNull(), F.concat(lookup(SCHEMA_OF_FAMILY, family), F.format_string("-%04d", digits)))


def cardinality(result_type: Column, boolean: Column, bindings: Column) -> Column:
    """An ASK with an answer counts one; else the rows."""
    return F.when(result_type == "ask", F.when(boolean.isNotNull(), 1).otherwise(0)).otherwise(F.coalesce(F.size(bindings), F.lit(0)))


def preview(result_type: Column, boolean: Column, bindings: Column, most: int = 3) -> Column:
    """The first rows of a result, each `k=v; k=v`; `boolean=...` for an ASK. bindings: an array of maps."""
    row = lambda b: F.array_join(F.transform(F.map_entries(b), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), "; ")
    none = F.array().cast("array<string>")
    asked = F.when(boolean.isNotNull(), F.array(F.concat(F.lit("boolean="), F.initcap(boolean.cast("string"))))).otherwise(none)
    return F.when(result_type == "ask", asked).otherwise(F.coalesce(F.transform(F.slice(bindings, 1, most), row), none))


def bucket(status: Column, rows: Column, stored: Column | None = None) -> Column:
    """Errors are red, answers with rows green, all else yellow; a stored bucket goes first."""
    own = F.when(status == "error", "red").when((status == "ok") & (rows > 0), "green").otherwise("yellow")
    return own if stored is None else F.when(stored.isin(*BUCKETS), stored).otherwise(own)


def review_summary(reviews: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """reviews: execution_status, result_cardinality, review_bucket. One partial aggregate."""
    status, of = F.col("execution_status"), F.col("review_bucket")
    ok = status == "ok"
    counts = {"ok_count": ok, "error_count": status == "error", "skipped_count": status == "skipped", "empty_result_count": ok & (F.col("result_cardinality") == 0), **{f"{b}_count": of == b for b in BUCKETS}}
    return reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("total_items"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def problems(reviews: DataFrame, key: str, query: str) -> DataFrame:
    """(key, problem): entries without a query, that failed, or that gave no rows; the first of these."""
    status = F.col("execution_status")
    why = F.when(F.col(query).isNull() | (F.trim(query) == ""), "missing_query").when(status == "error", "execution_error").when((status == "ok") & (F.col("result_cardinality") == 0), "empty_result")
    return reviews.select(key, why.alias("problem")).where(F.col("problem").isNotNull())


def generic_predicates(items: DataFrame, key: str, query: str) -> DataFrame:
    """(key, generic_predicates): the distinct made-up predicates of each query that has some."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(query), F.lit(f"({GENERIC})"), F.lit(1))))
    return items.select(key, found.alias("generic_predicates")).where(F.size("generic_predicates") > 0)


def matching_lines(text: Column, term: Column, most: int = 5) -> Column:
    """The first lines that hold a term, trimmed."""
    return F.slice(F.transform(F.filter(F.split(text, "\n"), lambda x: x.contains(term)), lambda x: F.trim(x)), 1, most)


def batch_problems(items: DataFrame, batch: str, required: Sequence[str], allowed: Mapping[str, Sequence[str]], expected: int | None = None) -> DataFrame:
    """(batch, problem, n): blank required fields, values that aren't allowed, and batches of another size than expected."""
    checks = {f"missing_{f}": F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "") for f in required}
    checks |= {f"invalid_{f}": F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "") & ~F.trim(F.col(f).cast("string")).isin(*values) for f, values in allowed.items()}
    counted = items.groupBy(batch).agg(F.count(F.lit(1)).alias("_size"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    rows = [F.struct(F.lit(n).alias("problem"), F.col(n).alias("n")) for n in checks]
    if expected is not None:
        rows.append(F.struct(F.lit("unexpected_size").alias("problem"), F.when(F.col("_size") != expected, F.col("_size")).otherwise(F.lit(0)).alias("n")))
    return counted.select(batch, F.inline(F.array(*rows))).where(F.col("n") > 0)


def join_problems(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys of the left without a partner, and keys that repeat on either side."""
    repeated = lambda df, name: df.groupBy(key).count().where(F.col("count") > 1).select(key, F.lit(name).alias("problem"))
    missing = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(repeated(left, "repeated_left")).unionByName(repeated(right, "repeated_right"))


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that refuses to lose or to multiply rows: any problem is an error that names one key."""
    bad = join_problems(left, right, key).first()
    if bad is not None:
        raise ValueError(f"{bad['problem']}: {bad[key]}")
    return left.join(right, key)


def paired(left: DataFrame, right: DataFrame, order: str, columns: tuple[str, str]) -> DataFrame:
    """(place, left, right): two lists of files paired by place; lists of unequal length are an error. Lists are short."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    a = left.select(order, F.col(columns[0]).alias("left")).withColumn("place", place).drop(order)
    b = right.select(order, F.col(columns[1]).alias("right")).withColumn("place", place).drop(order)
    if left.count() != right.count():
        raise ValueError("the lists differ in length")
    return a.join(b, "place")


def others(files: DataFrame, path: str, own: str, done: DataFrame | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """Files other than `own`, in no excluded folder, and not among those that are done."""
    kept = files.where((F.col(path) != own) & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in excluded]).cast("array<string>")))
    return kept if done is None else kept.join(done.select(path).distinct(), path, "left_anti")


def json_type(value: Column) -> Column:
    """The JSON type of a value's text: string, integer, number, boolean, array, object or null."""
    text = F.trim(value)
    return (
        F.when(text.isNull() | (text == "null"), "null").when(text.startswith('"'), "string").when(text.isin("true", "false"), "boolean").when(text.startswith("["), "array")
        .when(text.startswith("{"), "object").when(text.rlike(r"^-?[0-9]+$"), "integer").when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").otherwise("string")
    )


def type_fits(expected: Column, actual: Column) -> Column:
    """An integer is a number too; a type that isn't known fits all."""
    known = expected.isin("string", "integer", "number", "boolean", "array", "object", "null")
    return ~known | (expected == actual) | ((expected == "number") & (actual == "integer"))


def type_enum_violations(entries: DataFrame, key: str, fields: Column, schema: Mapping[str, tuple[str | None, Sequence[str] | None]]) -> DataFrame:
    """(key, field, error, value) against a schema of types and allowed values.

    fields: a map of field names to values as JSON text. Missing, null, blank
    and empty values are another report's; a value of the wrong type isn't held
    against the allowed ones.
    """
    rows = entries.select(key, F.explode(fields).alias("field", "value")).where(F.col("field").isin(*schema))
    rows = rows.where(F.col("value").isNotNull() & ~F.trim("value").isin("null", "[]", "{}", "") & ~F.col("value").rlike(r'^\s*"\s*"\s*$'))
    expected = lookup({f: t or "any" for f, (t, _) in schema.items()}, F.col("field"))
    listed = {f: values for f, (_, values) in schema.items() if values is not None}
    wrong = ~type_fits(expected, json_type(F.col("value")))
    strange = F.lit(False)
    for f, values in listed.items():
        strange = F.when(F.col("field") == f, ~F.col("value").isin(*values)).otherwise(strange)
    error = F.when(wrong, "type_mismatch").when(strange, "enum_mismatch")
    return rows.select(key, "field", error.alias("error"), "value").where(F.col("error").isNotNull())


def schema_comparison(entries: DataFrame, names: Column, schema: Sequence[str], required: Sequence[str]) -> DataFrame:
    """(field, place): shared, schema_only, dataset_only; required fields that no entry has come once more as missing_required.

    names: an array of an entry's field names. Only distinct names are shuffled.
    """
    seen = entries.select(F.explode(names).alias("field")).distinct().withColumn("_seen", F.lit(True))
    known = entries.sparkSession.createDataFrame([(f, f in required) for f in sorted({*schema, *required})], "field string, _required boolean")
    both = seen.join(known, "field", "full")
    of_schema = F.col("field").isin(*schema) if schema else F.lit(False)
    place = F.when(F.col("_seen") & of_schema, "shared").when(of_schema, "schema_only").when(F.col("_seen"), "dataset_only")
    missing = both.where(F.col("_required") & F.col("_seen").isNull()).select("field", F.lit("missing_required").alias("place"))
    return both.select("field", place.alias("place")).where(F.col("place").isNotNull()).unionByName(missing)


def memory_problems(entries: DataFrame, prefixes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(family, canonical_uri, problem): blank required fields, repeated identifiers in a family, placeholders whose prefix isn't their kind's."""
    required = ("family", "placeholder", "canonical_uri", "kind")
    blank = entries.where(F.array_contains(F.array(*[F.coalesce(F.trim(c), F.lit("")) for c in required]), "")).select("family", "canonical_uri", F.lit("missing_field").alias("problem"))
    repeated = entries.groupBy("family", "canonical_uri").count().where(F.col("count") > 1).select("family", "canonical_uri", F.lit("repeated").alias("problem"))
    fits = F.lit(True)
    for kind, starts in prefixes.items():
        any_of = F.lit(False)
        for start in starts:
            any_of = any_of | F.col("placeholder").startswith(start)
        fits = F.when(F.col("kind") == kind, any_of).otherwise(fits)
    return blank.unionByName(repeated).unionByName(entries.where(~fits).select("family", "canonical_uri", F.lit("wrong_prefix").alias("problem")))


def slice_table(slices: DataFrame, items: str, value: str) -> DataFrame:
    """Slices in the order they are shown: most items first, then by value."""
    return slices.withColumn("place", F.row_number().over(Window.orderBy(F.desc(items), value)))
