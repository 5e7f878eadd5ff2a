"""JSON documents: qualifier cells, match documents, fixture documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH_DOCUMENT = """
matchId BIGINT, startTime STRING, score STRING, venueName STRING,
home STRUCT<teamId BIGINT, name STRING, players ARRAY<STRUCT<playerId BIGINT, name STRING, shirtNo INT, position STRING,
  isFirstEleven BOOLEAN, minutesPlayed DOUBLE>>>,
away STRUCT<teamId BIGINT, name STRING, players ARRAY<STRUCT<playerId BIGINT, name STRING, shirtNo INT, position STRING,
  isFirstEleven BOOLEAN, minutesPlayed DOUBLE>>>,
events ARRAY<STRUCT<id BIGINT, eventId BIGINT, teamId BIGINT, playerId BIGINT, period STRING, minute INT, second INT,
  expandedMinute DOUBLE, type STRING, outcomeType STRING, x DOUBLE, y DOUBLE, endX DOUBLE, endY DOUBLE,
  isTouch BOOLEAN, isShot BOOLEAN, isGoal BOOLEAN, qualifiers ARRAY<STRUCT<type STRING, value STRING>>>>
"""


def parse_qualifiers(df: DataFrame, column: str = "qualifiers") -> DataFrame:
    """Text list of {type, value} -> ``qual_map`` (later duplicates win, missing value is
    "true") and ``qual_tags``.  Python-style quoting and {displayName} types are accepted."""
    form = "array<struct<type string, value string>>"
    # Only text that does not parse as it is gets its literals (None, True, False) rewritten.
    literal = F.col(column)
    for word, plain in (("None", "null"), ("True", "true"), ("False", "false")):
        literal = F.regexp_replace(literal, rf"([:,\[]\s*){word}(?=\s*[,}}\]])", f"$1{plain}")
    cell = F.coalesce(F.from_json(F.col(column), form), F.from_json(literal, form))
    items = F.expr(
        "transform(_cell, q -> named_struct('t', coalesce(get_json_object(q.type, '$.displayName'), q.type),"
        " 'v', coalesce(q.value, 'true')))"
    )
    df = df.withColumn("_cell", cell).withColumn("_items", items)
    # last duplicate wins without relying on a session-wide map policy
    df = df.withColumn("qual_tags", F.expr("array_distinct(transform(filter(_items, i -> i.t is not null), i -> i.t))"))
    df = df.withColumn(
        "qual_map",
        F.expr("map_from_arrays(qual_tags, transform(qual_tags, t -> element_at(filter(_items, i -> i.t = t), -1).v))"),
    )
    return df.drop("_cell", "_items")


def parse_match_documents(texts: DataFrame, column: str = "document") -> DataFrame:
    return texts.select(F.from_json(column, MATCH_DOCUMENT).alias("d")).select("d.*").where("matchId is not null")


def document_events(docs: DataFrame) -> DataFrame:
    """One row per event; team and player names are looked up inside the same document."""
    df = docs.select(
        F.col("matchId").alias("match_id"),
        F.expr("map_from_entries(filter(array(struct(home.teamId, home.name), struct(away.teamId, away.name)), t -> t.teamId is not null))").alias("teams"),
        F.expr("map_from_entries(transform(array_distinct(concat(coalesce(home.players, array()), coalesce(away.players, array()))),"
               " p -> struct(p.playerId, p.name)))").alias("players"),
        F.explode("events").alias("ev"),
    )
    return df.selectExpr(
        "match_id", "ev.eventId as event_id", "ev.teamId as team_id", "teams[ev.teamId] as team",
        "ev.playerId as player_id", "players[ev.playerId] as player",
        "coalesce(get_json_object(ev.type, '$.displayName'), ev.type) as type",
        "coalesce(get_json_object(ev.outcomeType, '$.displayName'), ev.outcomeType) as outcome",
        "coalesce(get_json_object(ev.period, '$.displayName'), ev.period) as period",
        "ev.minute", "ev.second", "ev.expandedMinute as expanded_minute", "ev.x", "ev.y", "ev.endX as end_x", "ev.endY as end_y",
        "coalesce(ev.isTouch, false) as is_touch", "coalesce(ev.isShot, false) as is_shot", "coalesce(ev.isGoal, false) as is_goal",
        "ev.qualifiers as qualifiers",
    )


def document_lineups(docs: DataFrame) -> DataFrame:
    sides = docs.select(
        F.col("matchId").alias("match_id"),
        F.explode(F.array(F.col("home"), F.col("away"))).alias("s"),
    ).select("match_id", F.col("s.teamId").alias("team_id"), F.col("s.name").alias("team"), F.explode("s.players").alias("p"))
    return sides.selectExpr(
        "match_id", "team_id", "team", "p.playerId as player_id", "p.name as player", "coalesce(p.isFirstEleven, false) as is_starter",
        "p.minutesPlayed as mins_played", "p.shirtNo as shirt_no", "p.position as position",
    )


FIXTURE = """id BIGINT, startTimeUtc STRING, homeTeamName STRING, awayTeamName STRING, homeTeamId BIGINT, awayTeamId BIGINT,
homeScore INT, awayScore INT, status STRING, elapsed STRING, stageId BIGINT, stageName STRING"""


def fixture_rows(texts: DataFrame, column: str = "document") -> DataFrame:
    """Fixture documents -> schedule rows, one per game id."""
    df = texts.select(F.from_json(column, FIXTURE).alias("f")).select("f.*").where("id is not null")
    df = df.selectExpr(
        "id as game_id", "startTimeUtc as date", "homeTeamName as home_team", "awayTeamName as away_team",
        "homeTeamId as home_team_id", "awayTeamId as away_team_id", "homeScore as home_score", "awayScore as away_score",
        "status", "elapsed", "stageId as stage_id", "stageName as stage_name",
        "case when lower(stageName) rlike 'play-?off|final|knockout|semi|quarter|promotion|relegation' then 'Playoffs'"
        " when stageId = 1 then 'League phase' else 'Additional stage' end as competition_phase",
        "lower(stageName) rlike 'play-?off|final|knockout|semi|quarter|promotion|relegation' as is_playoff",
    )
    return df.dropDuplicates(["game_id"])
