"""A training-corpus pipeline over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

1. language ID: documents without a clear language go; `lang` is what was found
2. n-gram Jaccard join: one document of each group of near duplicates stays
3. benchmark decontamination: documents that hold a benchmark item go
4. PII: personal data in the texts is replaced by its kind
5. best-fit packing: token pieces and their places in the sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import drop, materialize, table
from tessera.llm.op3_language_id import keep_identified
from tessera.llm.op6_ngram_jaccard import keep_one
from tessera.llm.op8_pii import redact_stage
from tessera.llm.op9_decontamination import drop_leaks
from tessera.llm.op10_packing import pack_stage

STAGES = [
    ("language_id", keep_identified),
    ("ngram_jaccard", keep_one),
    ("decontamination", drop_leaks),
    ("pii", redact_stage),
    ("packing", pack_stage),
]

#: Models, lexers and packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)  # the table of the stage before; documents themselves are not touched
    return STAGES[-1][1](spark, docs, sf_dir)
