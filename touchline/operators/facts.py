"""Match, team, player and season facts as one-pass conditional aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import shots
from touchline.functions.text import pct

SEASON = ["nation", "tier", "season"]


def n(rule: str) -> Column:
    return F.count_if(F.expr(rule))


def team_summary(d: DataFrame) -> DataFrame:
    """Strict team statistics per match (flag set d over prepared events)."""
    counts = {
        "passes": "d_pass", "good_passes": "d_pass and is_success", "shots": "d_shot", "shots_on_target": "d_on_target",
        "goals": "d_goal", "crosses": "d_cross", "take_ons": "d_take_on", "good_take_ons": "d_take_on and is_success",
        "carries": "d_carry", "inferred_carries": "d_inferred", "progressive_carries": "d_progressive_carry",
        "carry_final_third_entries": "d_carry_final_third", "carry_box_entries": "d_carry_box",
        "final_third_entries": "d_final_third", "box_entries": "d_box", "open_play_box_entries": "d_box and not d_set_piece",
        "set_piece_box_entries": "d_box and d_set_piece", "defensive_actions": "d_defensive",
        "attacking_third_touches": "attacking_third_touch", "high_regains": "d_regain",
        "transition_events": "d_regain or d_final_third or d_box or d_shot", "set_piece_actions": "d_set_piece",
        "set_piece_shots": "d_set_piece and d_shot", "set_piece_goals": "d_set_piece and d_goal",
        "corners_awarded": "d_corner_awarded", "corners_taken": "d_corner_taken", "free_kicks": "d_free_kick",
        "throw_ins": "d_throw_in", "penalties_taken": "d_penalty", "penalties_awarded": "d_penalty_awarded",
        "cards": "d_card", "yellow_cards": "d_yellow", "red_cards": "d_red", "second_yellows": "d_second_yellow",
        "fouls": "d_foul", "interceptions": "d_interception", "rows_checked": "true",
    }
    df = d.groupBy(*SEASON, "match_id", "team").agg(
        *[n(r).alias(k) for k, r in counts.items()],
        F.coalesce(F.avg("x"), F.lit(0.0)).alias("average_x"),
        F.sum(F.when(F.expr("d_shot and provider_xg is not null"), F.expr("least(greatest(provider_xg,0D),1D)"))).alias("_pxg"),
        F.sum(F.when(F.col("d_shot"), shots.rule_xg_strict())).alias("_rxg"),
    )
    return df.withColumns(
        {
            "pass_completion_pct": pct(F.col("good_passes"), F.col("passes")),
            "shot_accuracy_pct": pct(F.col("shots_on_target"), F.col("shots")),
            "take_on_success_pct": pct(F.col("good_take_ons"), F.col("take_ons")),
            "xg": F.coalesce("_pxg", "_rxg", F.lit(0.0)),
            "transition_proxy": F.expr(
                "high_regains + 0.8D * final_third_entries + 1.6D * box_entries + 2D * shots + 0.5D * crosses"
            ),
            "corners": F.expr("if(corners_awarded > 0, corners_awarded, corners_taken)"),
            "penalties": F.expr("if(penalties_taken > 0, penalties_taken, penalties_awarded)"),
        }
    ).drop("_pxg", "_rxg", "corners_awarded", "corners_taken", "penalties_taken", "penalties_awarded")


def team_match_summary(b: DataFrame) -> DataFrame:
    """The stored summary per match and team (flag set b)."""
    passed = "(is_pass or is_cross)"
    counts = {
        "passes": passed, "good_passes": f"{passed} and is_success", "shots": "is_shot", "goals": "is_goal",
        "box_entries": "box_entry", "final_third_entries": "final_third_entry",
        "attacking_third_touches": "attacking_third_touch", "defensive_actions": "is_defensive_action",
        "high_regains": "high_regain", "direct_attacks": f"{passed} and is_success and end_x - x >= 25",
        "transition_attacks": "high_regain or (box_entry and x < 60)",
        "long_balls": f"{passed} and concat(qual_c, type_c) like '%longball%'", "total_events": "true",
    }
    df = b.groupBy(*SEASON, "match_id", "team", "team_key", "team_side", "opponent", "home_team", "away_team", "kickoff").agg(
        *[n(r).alias(k) for k, r in counts.items()],
        F.sum(F.when(F.col("is_defensive_action"), F.coalesce("x", F.lit(0.0))).otherwise(0.0)).alias("_dx"),
    )
    return df.withColumns(
        {
            "pass_completion_pct": pct(F.col("good_passes"), F.col("passes")),
            "defensive_height": F.expr("_dx / greatest(defensive_actions, 1)"),
        }
    ).drop("_dx")


def team_style_profile(summary: DataFrame) -> DataFrame:
    """Season style scores and labels from the per-match summary."""
    df = summary.groupBy(*SEASON, "team", "team_key").agg(
        F.count_distinct("match_id").alias("match_count"),
        F.avg(F.expr("direct_attacks + long_balls")).alias("direct_score"),
        F.avg("passes").alias("possession_score"),
        F.avg("transition_attacks").alias("transition_score"),
        F.avg("defensive_height").alias("_h"),
        F.avg("high_regains").alias("_r"),
        F.avg("defensive_actions").alias("_d"),
    )
    df = df.withColumns(
        {
            "press_score": F.expr("_h + _r"),
            "low_block_score": F.expr("greatest(0D, 50 - _h) + greatest(0D, _d - _r)"),
            "confidence": F.expr("case when match_count < 2 then 'low' when match_count < 6 then 'medium' else 'high' end"),
        }
    )
    return df.withColumns(
        {
            "in_possession_tag": F.expr(
                "case when match_count < 2 then 'Low sample'"
                " when transition_score >= greatest(possession_score * 0.12D, direct_score) then 'Transition side'"
                " when possession_score >= 220 and possession_score >= direct_score * 8 then 'Possession side'"
                " when direct_score >= 18 then 'Direct side' else 'Mixed possession/direct' end"
            ),
            "out_of_possession_tag": F.expr(
                "case when match_count < 2 then 'Low sample' when press_score >= 65 then 'High press side'"
                " when low_block_score >= 55 then 'Low block side' else 'Mid block side' end"
            ),
        }
    ).drop("_h", "_r", "_d")


def momentum_windows(b: DataFrame, minutes: int = 10) -> DataFrame:
    """Tumbling windows of the match clock per match and team."""
    start = F.expr(f"cast(floor(expanded_minute / {minutes}) * {minutes} as int)")
    return (
        b.groupBy("match_id", "team", start.alias("window_start"))
        .agg(
            F.count(F.lit(1)).alias("event_count"), n("is_shot").alias("shots"), n("box_entry").alias("box_entries"),
            n("final_third_entry").alias("final_third_entries"),
        )
        .withColumns(
            {
                "window_end": F.expr(f"window_start + {minutes}"),
                "danger_events": F.expr("shots + box_entries + final_third_entries"),
            }
        )
    )


def shot_value_by_source(shot_rows: DataFrame) -> DataFrame:
    """Provider values where a team has any in the match, else the rule; never mixed."""
    df = shot_rows.groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("shots"),
        F.count("provider_xg").alias("provider_values"),
        F.sum(F.expr("if(provider_xg is null, null, least(greatest(provider_xg, 0D), 1D))")).alias("_p"),
        F.sum(shots.rule_xg_strict()).alias("_r"),
    )
    return df.withColumns(
        {
            "xg": F.expr("if(provider_values > 0, _p, _r)"),
            "xg_source": F.expr("if(provider_values > 0, 'provider', 'fallback')"),
        }
    ).drop("_p", "_r")


def ppda_and_tilt(log: DataFrame, e: DataFrame) -> DataFrame:
    """Opponent passes per defensive action, and share of passes in the final third."""
    success = "outcome_c in ('successful','success','won','complete','completed','accurate') or is_goal"
    df = e.groupBy("match_id", "team", "opponent").agg(
        n(f"e_pass and ({success}) and x * 1.2D < 72").alias("build_passes"),
        n("e_defensive and x * 1.2D >= 48").alias("press_actions"),
        n(f"e_pass and ({success}) and x * 1.2D >= 80").alias("final_third_passes"),
    )
    other = df.select("match_id", F.col("team").alias("opponent"), F.col("build_passes").alias("_ob"),
                      F.col("final_third_passes").alias("_of"))
    out = df.join(other, ["match_id", "opponent"], "left")
    return out.select(
        "match_id", "team",
        F.expr("if(press_actions > 0, coalesce(_ob, 0) / cast(press_actions as double), null)").alias("ppda"),
        F.expr("if(final_third_passes + coalesce(_of,0) > 0, 100D * final_third_passes / (final_third_passes + coalesce(_of,0)), 0D)")
        .alias("field_tilt"),
    )


def season_match_facts(e: DataFrame) -> DataFrame:
    """Counts per match and team with the season flag set."""
    counts = {
        "passes": "e_pass", "good_passes": "e_pass and e_success", "shots": "e_shot", "on_target": "e_on_target",
        "goals": "e_goal", "final_third_entries": "e_final_third", "box_entries": "e_box", "regains": "e_regain",
        "set_pieces": "e_set_piece", "corners": "e_corner", "free_kicks": "e_free_kick", "throw_ins": "e_throw_in",
        "crosses": "e_cross", "defensive_actions": "e_defensive", "carries": "e_carry", "events": "true",
    }
    return e.groupBy(*SEASON, "match_id", "team", "opponent", "team_side", "kickoff").agg(
        *[n(r).alias(k) for k, r in counts.items()],
        F.sum(F.when(F.col("e_shot"), shots.rule_xg_season()).otherwise(0.0)).alias("xg"),
    )


def season_team_facts(matches: DataFrame) -> DataFrame:
    names = [c for c in matches.columns if c not in (*SEASON, "match_id", "team", "opponent", "team_side", "kickoff")]
    return matches.groupBy(*SEASON, "team").agg(
        F.count_distinct("match_id").alias("matches"), *[F.sum(c).alias(c) for c in names]
    )


def player_mean_locations(e: DataFrame) -> DataFrame:
    return e.groupBy(*SEASON, "team", "player").agg(
        F.count(F.lit(1)).alias("events"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")
    )


def player_involvement(e: DataFrame, values: DataFrame) -> DataFrame:
    """Weighted involvement per player and season, ranked inside the team.

    ``values`` holds xg, xa and xt per season, league, team and player (see ``players.player_values``)."""
    df = e.groupBy(*SEASON, "team", "player").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("match_id").alias("matches"), n("e_pass").alias("passes"),
        n("e_pass and e_success").alias("good_passes"), n("e_final_third").alias("final_third_entries"),
        n("e_box").alias("box_entries"), n("e_shot").alias("shots"), n("e_goal").alias("goals"),
        n("e_defensive").alias("defensive_actions"), n("e_regain").alias("regains"), n("e_set_piece").alias("set_pieces"),
        n("e_cross").alias("crosses"), n("e_carry").alias("carries"),
        F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
    )
    df = df.join(values, [*SEASON, "team", "player"], "left").na.fill(0.0, ["xg", "xa", "xt"])
    df = df.withColumn(
        "score",
        F.expr("0.08D*events + 1.15D*final_third_entries + 1.65D*box_entries + 2.05D*shots + 4D*goals"
               " + 0.55D*defensive_actions + 1.35D*regains + 0.35D*set_pieces + 1.6D*xg + 1.6D*xa + 1.25D*xt"),
    )
    w = Window.partitionBy(*SEASON, "team").orderBy(F.round("score", 6).desc(), "player")
    return df.withColumn("rank", F.row_number().over(w))
