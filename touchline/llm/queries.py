"""The registered queries of this package and the DuckDB statements that check them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import ann, byte_bpe, jaccard_join, mixing, phrases, quality, repetition, secret_scan, sharding, spelling, sql, token_counts, toxicity, url_filter
from touchline.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(sql.STATEMENTS)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query
def op9_byte_bpe(spark, sf_dir):
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)


@query
def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    weights = toxicity.trained(docs, labels, held_out)
    return toxicity.score(docs, weights).select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_quality(spark, sf_dir):
    held_out = fold(F.col("doc_id"), 4) == 2
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_repetition(spark, sf_dir):
    return repetition.repetition_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


@query
def op2_secret_scan(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


@query
def op7_source_mixing(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query
def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.components(table(spark, sf_dir, "documents"), length=3, percent=90)


@query
def op1_multiprobe_search(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op5_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"))


@query
def op11_histogram_shards(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


@query
def op12_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
