"""Corpus pipeline: documents through five of the training-data operators, each stage stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import stages
from touchline.session import cut_lineage

STAGES = [
    ("toxicity", stages.toxicity),
    ("n-gram Jaccard join", stages.jaccard_join),
    ("secret scans", stages.secret_scans),
    ("mixing sources to target weights", stages.mixing),
    ("byte-level BPE encoding and decoding", stages.byte_bpe),
]

#: Training, seeded permutations and merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
