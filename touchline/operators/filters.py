"""Row filters that depend on match state, teams or neighbouring rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.flags import with_flags
from touchline.operators.links import PROGRESSION

STATES = {
    "all": "true",
    "first_half": "period = 1",
    "second_half": "period = 2",
    "before_first_goal": "first_goal is null or expanded_minute < first_goal",
    "after_first_goal": "first_goal is null or expanded_minute >= first_goal",
    "level_score": "home_before = away_before",
    "selected_team_leading": "own_before > other_before",
    "selected_team_trailing": "own_before < other_before",
    "after_first_red_card": "first_red is null or expanded_minute >= first_red",
    "after_first_substitution": "first_sub is null or expanded_minute >= first_sub",
}
SUBSTITUTION = "type_c rlike 'substitution|subon|suboff'"


def with_match_state(scored: DataFrame, side: str = "home") -> DataFrame:
    """Trigger minutes of the match and the score from one side's view; a missing trigger
    keeps every row."""
    w = Window.partitionBy("match_id")
    first = lambda rule: F.min(F.when(F.expr(rule), F.col("expanded_minute"))).over(w)
    other = "away" if side == "home" else "home"
    return scored.withColumns(
        {
            "first_goal": first("is_goal"), "first_red": first("is_red_card"), "first_sub": first(SUBSTITUTION),
            "own_before": F.col(f"{side}_before"), "other_before": F.col(f"{other}_before"),
        }
    )


def game_state(scored: DataFrame, state: str, side: str = "home") -> DataFrame:
    return with_match_state(scored, side).where(STATES[state])


def game_state_counts(scored: DataFrame, side: str = "home") -> DataFrame:
    """Rows kept per match for each of the ten states, in one pass."""
    df = with_match_state(scored, side)
    one = df.groupBy("match_id").agg(F.count(F.lit(1)).alias("rows_before"), *[F.count_if(F.expr(r)).alias(k) for k, r in STATES.items()])
    items = F.array(*[F.struct(F.lit(k).alias("state"), F.col(k).alias("rows_after")) for k in STATES])
    return one.select("match_id", "rows_before", F.explode(items).alias("i")).select("match_id", "rows_before", "i.*")


def team_rows(log: DataFrame, teams: DataFrame) -> DataFrame:
    """Rows whose team, or the team of their source file, is one of the given keys."""
    return log.join(teams, "team_key", "left_semi")


def in_matches(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids, "match_id", "left_semi")


def with_masks(prepared: DataFrame) -> DataFrame:
    return with_flags(
        prepared,
        progression=PROGRESSION,
        move="is_pass or is_cross or is_carry or is_take_on",
        danger="is_shot or box_entry or final_third_entry",
        stoppage="concat(type_c, outcome_c) rlike 'start|end|substitution|formation|card|foul|offside|period'",
        sequence_break="type_c rlike 'start|end|substitution|formation|card|foul|offside|clearance'"
        " or outcome_c rlike 'unsuccessful|inaccurate|lost|offside'",
        forward_escape="is_success and (is_pass or is_cross or is_carry) and x is not null and end_x is not null"
        " and (final_third_entry or box_entry or end_x - x >= 12)",
    )


def keyword_shots(shots: DataFrame, keywords: list[str]) -> DataFrame:
    pattern = "|".join(keywords)
    return shots.where(F.concat_ws("", F.col("type_c"), F.col("qual_c"), F.col("shot_family")).rlike(pattern))


def side_rows(df: DataFrame, side: str) -> DataFrame:
    """Rows of one side; distribution passes are located passes of that side."""
    df = df.where(F.col("team_side") == side) if side in ("home", "away") else df
    return with_flags(df, distribution="is_pass and x is not null and end_x is not null")
