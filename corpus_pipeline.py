"""The corpus pipeline: each stage's result is written as Parquet and read as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbordelta.llm import stages
from arbordelta.llm.common import materialize, read_table

STAGES = [
    ("language_id", stages.identify_language),
    ("minhash_near_dedup", stages.drop_near_duplicates),
    ("secret_scan", stages.redact_secrets),
    ("source_mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]
#: Language prediction and packing can't be put in SQL; the tests hold the pipeline against its stages done by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
