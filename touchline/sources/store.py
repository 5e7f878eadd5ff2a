"""Stored tables: prepared events, processed store, upserts, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame

from touchline.session import scratch_dir


def prepared_table(valued: DataFrame, path: str | None = None) -> DataFrame:
    """Write the prepared events once, partitioned by season, and read them back.

    Files hold whole matches side by side (repartitioned on match_id within a season), so a
    match filter prunes by season directory and by the match_id statistics of the row groups.
    """
    path = path or scratch_dir(valued.sparkSession, "prepared")
    (
        valued.repartition("season", "match_id")
        .sortWithinPartitions("season", "match_id", "event_index")
        .write.mode("overwrite").partitionBy("season").parquet(path)
    )
    return valued.sparkSession.read.parquet(path)
