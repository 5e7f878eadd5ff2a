"""Player value facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import shots
from touchline.operators.facts import n

WHO = ["season", "nation", "tier", "team", "player"]


def _sum(rule: str, column: str, name: str):
    return F.sum(F.when(F.expr(rule), F.col(column)).otherwise(0.0)).alias(name)


def player_xt(actions: DataFrame) -> DataFrame:
    return actions.groupBy(*WHO).agg(
        F.count(F.lit(1)).alias("actions"),
        F.sum("xt_added").alias("xt"),
        _sum("not f_set_piece", "xt_added", "open_play_xt"),
        _sum("f_set_piece", "xt_added", "set_piece_xt"),
        *[_sum(f"action_type = '{k}'", "xt_added", f"{k}_xt") for k in ("pass", "cross", "carry")],
    )


def rule_values(features: DataFrame) -> DataFrame:
    """Shots with the rule's value as ``xg``."""
    return features.withColumn("xg", shots.rule_xg_match())


def player_xg(valued_shots: DataFrame) -> DataFrame:
    """``valued_shots``: shot features with ``xg``, by rule or by model."""
    df = valued_shots
    families = ("open_play", "set_piece", "header", "direct_free_kick", "penalty")
    df = df.groupBy(*WHO, "player_id").agg(
        F.count(F.lit(1)).alias("shots"),
        n("f_goal").alias("goals"),
        F.sum("xg").alias("xg"),
        *[_sum(f"shot_family = '{k}'", "xg", f"{k}_xg") for k in families],
        _sum("shot_family <> 'penalty'", "xg", "non_penalty_xg"),
        n("f_big_chance").alias("big_chances"),
    )
    return df.withColumns({"goals_minus_xg": F.expr("goals - xg"), "xg_per_shot": F.expr("xg / shots")})


def player_xa(credits: DataFrame) -> DataFrame:
    df = credits.groupBy(*WHO, "player_id").agg(
        _sum("role = 'assist'", "xg", "xa"),
        _sum("role = 'assist' and not f_set_piece", "xg", "open_play_xa"),
        _sum("role = 'assist' and f_set_piece", "xg", "set_piece_xa"),
        _sum("role = 'secondary'", "xg", "secondary_xa"),
        _sum("role = 'carry'", "xg", "carry_to_shot_xg"),
        n("role = 'assist'").alias("shot_assists"),
        n("role = 'assist' and f_goal").alias("goal_assists"),
    )
    return df.withColumn("xa_per_shot_assist", F.expr("if(shot_assists > 0, xa / shot_assists, 0D)"))


def player_values(valued_shots: DataFrame, credits: DataFrame, actions: DataFrame) -> DataFrame:
    """Sums of shot value, assist value and ball-movement value per player of a team season."""
    parts = [
        valued_shots.select(*WHO, "xg", F.lit(0.0).alias("xa"), F.lit(0.0).alias("xt")),
        credits.where("role = 'assist'").select(*WHO, F.lit(0.0).alias("xg"), F.col("xg").alias("xa"), F.lit(0.0).alias("xt")),
        actions.select(*WHO, F.lit(0.0).alias("xg"), F.lit(0.0).alias("xa"), F.col("xt_added").alias("xt")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy(*WHO).agg(F.sum("xg").alias("xg"), F.sum("xa").alias("xa"), F.sum("xt").alias("xt"))
