"""Playing style per match and team, in and out of possession."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import sequences
from touchline.operators.facts import n
from touchline.operators.maps import MT


def _ip_base(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key that the in-possession label needs (chains first, then events)."""
    chains = sequences.team_action_chains(prepared).groupBy(*dict.fromkeys([*keys, *MT]), "chain_id").agg(
        F.count(F.lit(1)).alias("actions"), (F.max("clock_s") - F.min("clock_s")).alias("duration"),
        F.min_by("x", F.struct("period", "expanded_minute", "event_index")).alias("x0"),
        F.max_by(F.expr("coalesce(end_x, x)"), F.struct("period", "expanded_minute", "event_index")).alias("x1"),
        F.max("is_shot").alias("shot"), F.max("box_entry").alias("box"),
    )
    c = chains.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chains"), F.avg("actions").alias("chain_actions"), F.avg("duration").alias("chain_duration"),
        n("actions >= 7 or duration >= 25").alias("long_chains"), n("duration <= 15 and x1 - x0 >= 25").alias("direct_chains"),
        n("shot").alias("shot_chains"), n("box").alias("box_chains"),
    )
    p = "(is_pass or is_cross)"
    e = prepared.groupBy(*keys).agg(
        n(p).alias("passes"), n(f"{p} and is_success").alias("good_passes"), n(f"{p} or is_carry or is_take_on").alias("moves"),
        n(f"{p} and is_success and end_x - x >= 8").alias("forward_passes"), n(f"{p} and contains(concat(qual_c, type_c), 'longball')").alias("long_balls"),
        n("high_regain or final_third_entry or box_entry or is_shot").alias("transition_events"),
    )
    df = e.join(c, keys, "left").na.fill(0)
    rate = lambda a, b: F.expr(f"if({b} > 0, 100D * {a} / {b}, 0D)")
    return df.withColumns(
        {
            "long_share": rate("long_chains", "chains"), "direct_share": rate("direct_chains", "chains"), "shot_share": rate("shot_chains", "chains"),
            "box_share": rate("box_chains", "chains"), "forward_share": rate("forward_passes", "good_passes"), "long_ball_share": rate("long_balls", "passes"),
            "transition_rate": F.expr("100D * transition_events / greatest(moves, 1)"),
        }
    )


IP_LABEL = """case when chains < 5 and moves < 25 then 'Low control attack'
 when transition_rate >= 8 and direct_share >= 12 then 'Transition side'
 when chain_actions >= 5.5 and long_share >= 18 then 'Possession side'
 when direct_share >= 20 or long_ball_share >= 18 or (forward_share >= 45 and chain_actions < 4.8) then 'Direct side'
 when chain_actions >= 4.5 or long_share >= 12 then 'Mixed possession/direct' when transition_rate >= 7 then 'Transition side'
 when forward_share >= 40 then 'Direct side' else 'Low control attack' end"""


def in_possession(prepared: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _ip_base(prepared, keys or MT).withColumn("label", F.expr(IP_LABEL)).drop(
        "long_chains", "direct_chains", "shot_chains", "box_chains", "long_balls", "forward_passes", "transition_events"
    )


OOP_LABEL = """case when actions < 8 then 'Low event sample' when high_regain_share >= 18 and high_share >= 28 then 'Counter press side'
 when high_share >= 36 or mean_x >= 58 or ppda_proxy <= 5 then 'High press side' when low_share >= 46 or mean_x <= 42 then 'Low block side'
 when high_share >= 22 and mean_x >= 50 then 'Mid/high press side' else 'Mid block side' end"""


def out_of_possession(prepared: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Height shares of defensive actions and passes allowed per press."""
    keys = keys or MT
    d = "is_defensive_action"
    own = prepared.groupBy(*keys).agg(
        n(d).alias("actions"), n(f"{d} and x >= 60").alias("high"), n(f"{d} and x >= 40 and x < 60").alias("middle"), n(f"{d} and x < 40").alias("low"),
        F.coalesce(F.avg(F.expr(f"if({d}, x, null)")), F.lit(0.0)).alias("mean_x"), n("high_regain").alias("regains"), n(f"{d} and x >= 50").alias("press"),
    )
    okeys = [F.col("opponent").alias("team") if k == "team" else F.col(k) for k in keys]
    opp = prepared.groupBy(*okeys).agg(
        n("(is_pass or is_cross) and is_success and x < 60").alias("build"), n("box_entry").alias("box_allowed"), n("final_third_entry").alias("final_third_allowed")
    )
    df = own.join(opp, keys, "left").na.fill(0, ["build", "box_allowed", "final_third_allowed"])
    rate = lambda a: F.expr(f"if(actions > 0, 100D * {a} / actions, 0D)")
    df = df.withColumns(
        {
            "high_share": rate("high"), "middle_share": rate("middle"), "low_share": rate("low"), "high_regain_share": rate("regains"),
            "ppda_proxy": F.expr("if(build > 0, build / cast(greatest(press, 1) as double), 0D)"),
        }
    )
    return df.withColumn("label", F.expr(OOP_LABEL)).drop("high", "middle", "low", "press", "build")


def style_shift(prepared: DataFrame) -> DataFrame:
    """Match label against the team's season label."""
    keys = ["nation", "tier", "season", "team"]
    m_ip = in_possession(prepared, [*keys, "match_id"]).select(*keys, "match_id", F.col("label").alias("match_ip"))
    m_op = out_of_possession(prepared, [*keys, "match_id"]).select(*keys, "match_id", F.col("label").alias("match_oop"))
    s_ip = in_possession(prepared, keys).select(*keys, F.col("label").alias("season_ip"))
    s_op = out_of_possession(prepared, keys).select(*keys, F.col("label").alias("season_oop"))
    df = m_ip.join(m_op, [*keys, "match_id"]).join(s_ip, keys).join(s_op, keys)
    return df.withColumns({"ip_shift": F.expr("match_ip <> season_ip"), "oop_shift": F.expr("match_oop <> season_oop")})


def phases(prepared: DataFrame) -> DataFrame:
    """Four phase rows per match and team."""
    df = prepared.groupBy(*MT).agg(
        n("is_pass and x < 50").alias("build_up"), n("final_third_entry").alias("progression"), n("is_shot").alias("finishing"), n("is_defensive_action").alias("defending"),
        F.avg(F.expr("if(is_shot, x, null)")).alias("shot_x"), F.avg(F.expr("if(is_defensive_action, x, null)")).alias("def_x"),
    )
    rows = F.array(
        F.expr("struct('build up' as phase, build_up as count, cast(null as double) as mean_x)"), F.expr("struct('progression' as phase, progression as count, cast(null as double) as mean_x)"),
        F.expr("struct('finishing' as phase, finishing as count, shot_x as mean_x)"), F.expr("struct('defending' as phase, defending as count, def_x as mean_x)"),
    )
    return df.select(*MT, F.explode(rows).alias("r")).select(*MT, "r.*")


def season_style_tags(e: DataFrame) -> DataFrame:
    """Threshold tags on season shares."""
    keys = ["nation", "tier", "season", "team"]
    df = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), n("e_pass").alias("passes"), n("e_final_third").alias("ft"), n("e_box").alias("bx"), n("e_move").alias("moves"),
        n("e_wide").alias("wide"), n("e_central").alias("central"), n("e_regain").alias("reg"), n("e_set_piece and e_shot").alias("sps"),
        F.avg(F.expr("if(e_defensive, ex, null)")).alias("depth"), F.count_distinct("match_id").alias("matches"),
    )
    rules = [
        ("Possession heavy", "100D * passes / rows >= 48"), ("Direct", "ft > 0 and bx / cast(ft as double) >= 0.42"),
        ("Wing focused", "100D * wide / greatest(moves, 1) >= 52"), ("Central progression", "100D * central / greatest(moves, 1) >= 38"),
        ("High pressing", "reg >= greatest(6, matches * 2)"), ("Transition threat", "reg >= greatest(4, matches) and bx >= greatest(3, matches)"),
        ("Set piece threat", "sps >= greatest(2, matches)"), ("Deep defending", "depth > 0 and depth < 45 and reg < greatest(4, matches)"),
    ]
    tags = F.array_compact(F.array(*[F.when(F.expr(r), F.lit(t)) for t, r in rules]))
    return df.select(*keys, F.array_join(tags, "; ").alias("tags"))


def chain_families(valued: DataFrame) -> DataFrame:
    """Dangerous season chains with the lanes they connect and their route as ``family``."""
    from touchline.functions import geometry

    keys = ["nation", "tier", "season", "team"]
    order = F.struct("period", "expanded_minute", "event_index")
    c = sequences.season_chains(valued).groupBy(*keys, "match_id", "chain_id").agg(
        F.count(F.lit(1)).alias("actions"), F.min_by("y", order).alias("y0"), F.max_by(F.expr("coalesce(end_y, y)"), order).alias("y1"),
        n("is_carry").alias("carries"), F.max("is_cross").alias("cross"), F.max("box_entry").alias("box"), F.max("final_third_entry").alias("ft"),
        F.max("is_shot").alias("shot"), F.max("is_goal").alias("goal"), F.sum("xg").alias("xg"), F.sum("positive_league_xt").alias("xt"),
    ).where("actions >= 2 and (shot or box or round(xt, 9) >= 0.12)")
    route = F.expr("case when cross then 'cross' when carries >= 2 then 'carry progression' when box then 'box entry' else 'final third progression' end")
    c = c.withColumns({"_a": geometry.lane3("y0"), "_b": geometry.lane3("y1")})
    return c.withColumn("family", F.concat_ws(" ", "_a", F.lit("to"), "_b", route)).drop("_a", "_b")


def repeated_chains(valued: DataFrame, k: int | None = None) -> DataFrame:
    """Dangerous season chains grouped by the lanes they connect and their route."""
    from touchline.operators.topk import top_per_group

    keys = ["nation", "tier", "season", "team"]
    c = chain_families(valued)
    g = c.groupBy(*keys, "family").agg(
        F.count(F.lit(1)).alias("chains"), n("shot").alias("shots"), n("goal").alias("goals"), F.sum("xg").alias("xg"), F.sum("xt").alias("xt"), F.avg("actions").alias("mean_actions")
    )
    return top_per_group(g, keys, [F.desc("chains"), F.round("xg", 8).desc(), F.col("family")], k)


def sequence_browser(valued: DataFrame, k: int | None = None) -> DataFrame:
    """Goal, big-chance, highest-xG and highest-value chains of a team's season."""
    from touchline.operators.topk import top_per_group

    keys = ["nation", "tier", "season", "team"]
    df = sequences.season_chains(valued).groupBy(*keys, "match_id", "chain_id").agg(
        F.count(F.lit(1)).alias("actions"), F.max("is_goal").alias("goal"), F.max("is_shot").alias("shot"), F.max("box_entry").alias("box"),
        F.sum("xg").alias("xg"), F.max("xg").alias("best_xg"), F.sum("positive_league_xt").alias("xt"),
    )
    lists = {"goal": "goal", "big_chance": "best_xg >= 0.20 or (shot and box)", "highest_xg": "shot", "highest_xt": "round(xt, 9) > 0"}
    df = df.withColumn("list", F.explode(F.array_compact(F.array(*[F.when(F.expr(r), F.lit(m)) for m, r in lists.items()]))))
    score = F.round(F.when(F.col("list") == "highest_xt", F.col("xt")).otherwise(F.col("xg")), 8)
    return top_per_group(df, [*keys, "list"], [score.desc(), F.col("match_id"), F.col("chain_id")], k)
