"""What the fourth round's findings asked for, on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import reports


@pytest.mark.parametrize(("kept", "most"), [("true", 3), ("id % 7 < 6 or id % 11 < 10", 6)])
def test_f1_files_of_a_product_have_few_bytes_a_row(spark, tmp_path, kept, most):
    """Twelve templates of about 500 long lines, each below as many places of another: 3 million rows, most of whose lines would not fit a dictionary together; as wide as each other, and not."""
    k = F.col("id")
    rows = spark.range(24 * 500).where(kept).select((k % 24).alias("template"), k.alias("o"), F.substring(F.concat(*[F.sha2(F.concat(k, F.lit(x)), 512) for x in "ab"]), 1, 200).alias("property"), F.when(k % 24 < 12, k % 24 + 12).alias("target"))
    wide = {r["template"]: r["count"] for r in rows.groupBy("template").count().collect()}
    reports.class_lines(rows, "o").write.parquet(f"{tmp_path}/lines")
    n = spark.read.parquet(f"{tmp_path}/lines").count()
    assert n == sum(wide.values()) + sum(wide[t] * wide[t + 12] for t in range(12)) > 2_500_000
    assert sum(f.stat().st_size for f in (tmp_path / "lines").glob("*.parquet")) < most * n


@pytest.mark.parametrize("seed", [4, 5])
def test_f1_tiles_equal_a_plain_walk(spark, monkeypatch, seed):
    for name, size in {"LEADS": 4, "LINES": 2, "TOGETHER": 3, "SHARED": 2}.items():
        monkeypatch.setattr(reports, name, size)
    r = random.Random(seed)
    rows = [(r.randrange(6), i, f"p{i % 11}", r.choice([None, None, *range(7)])) for i in range(30)]
    r.shuffle(rows)

    def walk(template, seen):
        for _, order, name, target in sorted((x for x in rows if x[0] == template), key=lambda x: x[1]):
            yield "  " * (len(seen) - 1) + f"- {name}"
            if target is not None and target not in seen:
                yield from walk(target, [*seen, target])

    want = {(t, n, line) for t in {x[0] for x in rows} for n, line in enumerate(walk(t, [t]), 1)}
    got = reports.class_lines(spark.createDataFrame(rows, "template long, o long, property string, target long"), "o").collect()
    assert len(want) > 1000 and len(got) == len(want) and set(map(tuple, got)) == want
