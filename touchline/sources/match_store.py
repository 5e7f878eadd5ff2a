"""The match store: flagged events with the tables derived from them, under one version (see ``versions.py``).

What is derived per match (index, team summaries, momentum windows) is replaced match by match, so an upsert only
computes the incoming matches; season profiles are aggregated from the stored match summaries when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import facts
from touchline.sources import versions

BY, ORDER = ["season"], ["match_id", "event_index"]
NEEDED = ["events", "match_index", "team_match_summary", "momentum_profiles"]


def match_tables(flagged: DataFrame) -> dict[str, DataFrame]:
    """The stored tables of some matches; each row belongs to one match."""
    index = flagged.groupBy("season", "nation", "tier", "match_id").agg(
        F.min("home_team").alias("home_team"), F.min("away_team").alias("away_team"), F.min("kickoff").alias("kickoff"),
        F.count("*").alias("events"), F.min("event_index").alias("first_event"), F.max("event_index").alias("last_event"))
    windows = facts.momentum_windows(flagged).join(index.select("match_id", "season"), "match_id")
    return {"events": flagged, "match_index": index, "team_match_summary": facts.team_match_summary(flagged), "momentum_profiles": windows}


def build(flagged: DataFrame, root: str, files: DataFrame | None = None) -> int:
    """All tables, and the snapshot of the source files they come from, as the next version."""
    sources = {} if files is None else {versions.SOURCES: files}
    return versions.build({**match_tables(flagged), **sources}, root, BY, ORDER)


def upsert(flagged: DataFrame, root: str) -> int:
    """Incoming matches replace the stored ones in every table at once."""
    return versions.upsert(match_tables(flagged), root, BY, ORDER)


def team_style_profiles(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return facts.team_style_profile(versions.read(spark, root, "team_match_summary", version))
