"""Ball-movement values on a 16 x 12 grid, shot values, and links between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import flags, geometry, shots

#: A grid is trained for each league season, so that one league's values do not move with another's.
LEAGUE = ["nation", "tier", "season"]
#: A grid of its own for each match, for the value of play within it.
MATCH = ["match_id"]
_MOVE = "(f_pass or f_carry) and f_success and end_x is not null and end_y is not null and zone_start >= 0 and zone_end >= 0"


def with_zones(f: DataFrame) -> DataFrame:
    return f.withColumns(
        {
            "zone_start": geometry.value_zone("x", "y"),
            "zone_end": geometry.value_zone("end_x", "end_y"),
            "action_type": F.expr(
                "case when f_carry then 'carry' when f_cross then 'cross' when f_pass then 'pass' else 'other' end"
            ),
        }
    )


def zone_cells(f: DataFrame, scope: list[str] | None = None, include_set_pieces: bool = False) -> DataFrame:
    """Counts per (start zone, end zone): one partial aggregation over the events, at most
    192 x 193 rows per scope."""
    # No filter here: Spark would push it through every projection of the log and repeat their
    # expressions inside it.  Rows outside the model fall into zone -1, dropped after counting.
    out = "zone_start < 0" if include_set_pieces else "zone_start < 0 or f_set_piece"
    df = with_zones(f).withColumn("_move", F.expr(f"coalesce({_MOVE}, false)"))
    df = df.withColumns({"zone_start": F.expr(f"if({out}, -1, zone_start)"), "zone_end": F.expr("if(_move, zone_end, -1)")})
    cells = df.groupBy(*(scope or []), "zone_start", "zone_end").agg(
        F.count(F.lit(1)).alias("actions"),
        F.count_if("_move").alias("moves"),
        F.count_if("f_shot").alias("shots"),
        F.count_if("f_goal").alias("goals"),
        F.max("zone_start").alias("_zone"),
    )
    return cells.where("_zone >= 0").drop("_zone")


def zone_model(cells: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per start zone: move, shot and goal probabilities with zero-safe division."""
    zone = cells.groupBy(*(scope or []), "zone_start").agg(
        *[F.sum(c).alias(c) for c in ("actions", "moves", "shots", "goals")]
    )
    return zone.withColumns(
        {
            "move_p": F.expr("moves / cast(actions as double)"),
            "shot_p": F.expr("shots / cast(actions as double)"),
            "goal_p": F.expr("if(shots > 0, goals / cast(shots as double), 0D)"),
        }
    )


def _solve(frame: pd.DataFrame) -> np.ndarray:
    """The values of one grid: the least solution of x = payoff + moves x that is nowhere negative, by elimination.

    Zones from which play never reaches a payoff are worth 0; among the others every zone leads to one that play
    leaves, so the system has one solution.
    """
    start, end = frame["zone_start"].to_numpy(), frame["zone_end"].to_numpy()
    counts = {c: np.bincount(start, frame[c].to_numpy(float), geometry.ZONES) for c in ("actions", "shots", "goals")}
    actions, shots_ = np.maximum(counts["actions"], 1), np.maximum(counts["shots"], 1)
    payoff = counts["shots"] / actions * (counts["goals"] / shots_)
    move = np.zeros((geometry.ZONES, geometry.ZONES))
    at = end >= 0
    np.add.at(move, (start[at], end[at]), frame["moves"].to_numpy(float)[at])
    worth, leads = payoff > 0, move > 0
    while (more := worth | (leads[:, worth].any(1))).sum() > worth.sum():
        worth = more
    x, own = np.zeros(geometry.ZONES), np.flatnonzero(worth)
    x[own] = np.linalg.solve(np.eye(len(own)) - move[np.ix_(own, own)] / actions[own, None], payoff[own])
    return np.clip(x, 0.0, 1.0)


def solve_grids(cells: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The 192 zone values of every scope as one array ``grid``: x = shot * goal + move * T x, solved exactly.

    The grid is a constant (192 zones, at most 36,864 transitions per scope), so a group is bounded whatever the number
    of events behind it; leagues, or single matches, are solved side by side.
    """
    scope = scope or []
    kinds = "".join(f"{c} {cells.schema[c].dataType.simpleString()}, " for c in scope)

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key[: len(scope)], _solve(frame))], columns=[*scope, "grid"])

    by = scope or [F.lit(0).alias("_all")]
    return cells.groupBy(*by).applyInPandas(solve, f"{kinds}grid array<double>")


def solve_zones(cells: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The same, one row per zone."""
    return solve_grids(cells, scope).select(*(scope or []), F.posexplode("grid").alias("zone", "xt"))


def _with_grid(df: DataFrame, grid: DataFrame, scope: list[str]) -> DataFrame:
    """``df`` with the array ``grid`` of its scope, by one join; rows per zone are packed first."""
    if "grid" not in grid.columns:
        packed = F.transform(F.array_sort(F.collect_list(F.struct("zone", "xt"))), lambda z: z["xt"])
        grid = grid.groupBy(*scope).agg(packed.alias("grid"))
    return df.join(grid, scope, "left") if scope else df.crossJoin(grid)  # without scope there is one grid


def value_actions(f: DataFrame, grid: DataFrame, scope: list[str] | None = LEAGUE) -> DataFrame:
    """xt_added = value at the end minus value at the start, for successful moves (set pieces included)."""
    df = _with_grid(with_zones(f).where(_MOVE), grid, scope or []).where("grid is not null")
    df = df.withColumns({"xt_start": F.expr("element_at(grid, zone_start + 1)"), "xt_end": F.expr("element_at(grid, zone_end + 1)")})
    return df.withColumn("xt_added", F.expr("xt_end - xt_start")).drop("grid")


def attach_values(prepared: DataFrame, grid: DataFrame, scope: list[str] | None = LEAGUE) -> DataFrame:
    """Every prepared row with its ball-movement value and, on shots, xg.

    ``xt_added`` and ``positive_xt`` are values in the scope of a match, where set pieces count nothing;
    ``league_xt_added`` and ``positive_league_xt`` are those of the league scope, with set pieces. All are 0
    where the row is not a successful move.

    ``grid`` comes from ``solve_grids`` (or ``solve_zones``) over the log: training reads plain event rows, so it is
    a projection and one partial aggregation, without the windows behind ``prepared``. It has one row
    per league season (or match); whether that is sent to every task is left to its measured size."""
    df = with_zones(flags.flags_f(prepared)).withColumn("_move", F.expr(f"coalesce({_MOVE}, false)"))
    df = _with_grid(df, grid, scope or [])
    df = df.withColumn("league_xt_added", F.expr("if(_move, element_at(grid, zone_end + 1) - element_at(grid, zone_start + 1), 0D)")).drop("grid")
    return df.withColumns(
        {
            "positive_league_xt": F.expr("greatest(league_xt_added, 0D)"),
            "xt_added": F.expr("if(f_set_piece, 0D, league_xt_added)"),
            "positive_xt": F.expr("if(f_set_piece, 0D, greatest(league_xt_added, 0D))"),
            "xg": F.when(F.col("is_shot"), shots.rule_xg_match()).otherwise(F.lit(0.0)),
        }
    )


def shot_features(possessions: DataFrame) -> DataFrame:
    """The 21 model features of every shot; missing values are 0."""
    df = shots.shot_geometry(possessions.where("f_shot"))
    as_int = {
        "big_chance": "f_big_chance", "header": "f_header", "first_time": "f_first_time", "rebound": "f_rebound",
        "fast_break": "f_fast_break", "through_ball_assist": "prev_through", "cross_assist": "prev_cross",
        "cutback_assist": "prev_cutback", "carry_before_shot": "prev_carry and prev_player = player",
        "prev_pass": "prev_pass", "prev_carry_i": "prev_carry", "prev_cross_i": "prev_cross", "goal": "f_goal",
    }
    df = df.withColumns({n: F.expr(f"cast(coalesce({r}, false) as int)") for n, r in as_int.items()})
    return df.withColumns(
        {
            "inside_box": F.expr("cast(coalesce(x_105 >= 88 and y_68 between 13.84 and 54.16, false) as int)"),
            "central_lane": F.expr("cast(coalesce(y_68 between 24 and 44, false) as int)"),
            "distance": F.expr("coalesce(goal_distance, 0D)"),
            "distance_sq": F.expr("coalesce(goal_distance * goal_distance, 0D)"),
            "angle": F.expr("coalesce(goal_angle, 0D)"),
            "y_from_centre": F.expr("coalesce(abs(y_68 - 34), 0D)"),
            "shot_x": F.expr("coalesce(x_105, 0D)"),
            "shot_y": F.expr("coalesce(y_68, 0D)"),
            "prev_seconds": F.expr(
                "least(greatest(coalesce(expanded_minute - prev_minute, 99D) * 60, 0D), 99D)"
            ),
            "action_number": F.col("possession_action").cast("double"),
            "shot_family": F.expr(
                "case when f_penalty then 'penalty' when f_direct_fk then 'direct_free_kick' when f_header then 'header'"
                " when f_set_piece then 'set_piece' else 'open_play' end"
            ),
        }
    )


FEATURES = [
    "shot_x", "shot_y", "y_from_centre", "distance", "distance_sq", "angle", "inside_box", "central_lane", "big_chance",
    "header", "first_time", "rebound", "fast_break", "through_ball_assist", "cross_assist", "cutback_assist",
    "carry_before_shot", "prev_pass", "prev_carry_i", "prev_seconds", "action_number",
]


def shot_assists(possessions: DataFrame) -> DataFrame:
    """Per shot inside its possession: last and second-last successful pass and last
    successful carry before it; one row per credited player and role."""
    run = Window.partitionBy("match_id", "possession_id").orderBy("period", "expanded_minute", "event_index")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    who = F.struct("player", "player_id", "team")
    df = possessions.withColumns(
        {
            "_pass": F.when(F.expr("f_success and f_pass"), who),
            "_carry": F.when(F.expr("f_success and f_carry"), who),
        }
    )
    # the pass before the last one: at each pass remember the pass before it
    df = df.withColumn("_older", F.when(F.col("_pass").isNotNull(), F.last("_pass", True).over(before)))
    df = df.withColumns(
        {
            "_p1": F.last("_pass", True).over(before),
            "_p2": F.last(F.when(F.col("_pass").isNotNull(), F.struct(F.col("_older").alias("o"))), True).over(before)["o"],
            "_c1": F.last("_carry", True).over(before),
            "xg": shots.rule_xg_match(),
        }
    ).where("f_shot")
    roles = F.array(
        F.struct(F.lit("assist").alias("role"), F.col("_p1").alias("who")),
        F.struct(F.lit("secondary").alias("role"), F.col("_p2").alias("who")),
        F.struct(F.lit("carry").alias("role"), F.col("_c1").alias("who")),
    )
    return (
        df.select("season", "nation", "tier", "match_id", "event_index", "xg", "f_set_piece", "f_goal", F.explode(roles).alias("r"))
        .where("r.who is not null")
        .select(
            "season", "nation", "tier", "match_id", F.col("event_index").alias("shot_index"), "xg", "f_set_piece", "f_goal",
            "r.role", "r.who.player", "r.who.player_id", "r.who.team",
        )
    )
