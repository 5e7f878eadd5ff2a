"""The stages of the corpus pipeline: documents in, documents out (the last one: token ids)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import byte_bpe as bpe
from touchline.llm import jaccard_join as join
from touchline.llm import mixing as mix
from touchline.llm import secret_scan
from touchline.llm import toxicity as toxic
from touchline.llm.common import bounded_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from the labels of ``docs``."""
    weights = toxic.trained(docs, table(spark, sf_dir, "labels"))
    scored = toxic.score(docs.select(*COLUMNS), weights, keep=tuple(COLUMNS[1:]))
    return scored.where("score < 0.5").select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    bounded_batches(spark)
    return join.representatives(docs.select(*COLUMNS), length=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced by the name of their kind."""
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: a row for each part of a document in a drawn block of 256 words."""
    return mix.mixed_texts(docs.select(*COLUMNS), block=256).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text with the digests of ids and decoded bytes."""
    bounded_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=("source",))
