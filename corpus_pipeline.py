"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, secret scan, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsmeter.llm import stages
from tsmeter.llm.common import read_table, shared_table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_exact_copies),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("secret_scan", stages.mask_secrets),
    ("packing", stages.pack),
]

#: Learned scores, fingerprints and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; each stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
