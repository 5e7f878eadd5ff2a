"""What several operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents handled together inside a task: bounds the words or tokens held at a time.
CHUNK_CHARS = 1_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long, so Arrow hands them over in batches of few rows and few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, handed to Python in bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame) -> DataFrame:
    """doc_id and text alone (null text as the empty one), whatever else the table carries."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def label_rows(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label per document: repeated rows count once, with the larger value; nulls are dropped."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    )


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def chunks(frame, size=CHUNK_CHARS):
    """Row ranges (start, stop) of a pandas frame whose texts have about ``size`` characters in all."""
    total = np.cumsum(frame["text"].str.len().to_numpy(dtype=np.int64)) if len(frame) else np.zeros(0, np.int64)
    start = 0
    while start < len(frame):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
        yield start, stop
        start = stop
