"""Corpus pipeline: quality filter, near-duplicate removal, benchmark decontamination, PII redaction, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import stages
from marquee.llm.arrow import written

STAGES = [
    ("quality", stages.keep_quality),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("pii", stages.redact_pii),
    ("bpe", stages.encode),
]

#: The stages score with trained models and merge byte pairs: SQL can't express them; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
