"""Season profiles that combine facts for and against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import geometry
from touchline.functions.flags import flags_e
from touchline.operators import defence, links
from touchline.operators.facts import SEASON, n
from touchline.operators.maps import MT

TEAM = [*SEASON, "team"]
FAMILIES = ["corner", "free_kick", "throw_in"]


def set_piece_profile(valued: DataFrame) -> DataFrame:
    """Corner, free-kick and throw-in profile of every team, for and against, in one pass: each
    row is sent once per family and direction it counts for."""
    df = flags_e(valued.where("not is_inferred_carry"))
    threat = (
        "greatest(0.08D, positive_league_xt, xg) + if(e_end_box, 0.22D, 0D) + if(e_final_third, 0.16D, 0D) + if(e_box, 0.24D, 0D) + if(e_shot, 0.35D, 0D)"
    )
    df = df.withColumns({"_threat": F.expr(f"least({threat}, 1.4D)"), "_lane": geometry.lane_120("ey"), "_delivery": F.expr("e_pass or e_cross")})
    fam = F.array_compact(F.array(*[F.when(F.col(f"e_{f}"), F.lit(f)) for f in FAMILIES]))
    part = df.withColumn("family", F.explode(fam)).groupBy(*SEASON, "team", "opponent", "family").agg(
        F.count(F.lit(1)).alias("events"), n("_delivery").alias("deliveries"), n("_delivery and round(_threat, 9) >= 0.35").alias("high_threat"),
        n("e_shot").alias("shots"), n("e_goal").alias("goals"), F.sum("xg").alias("xg"),
        *[n(f"_delivery and _lane = '{lane}'").alias(f"{lane}_deliveries") for lane in ("left", "central", "right")],
    )
    sums = [F.sum(c).alias(c) for c in part.columns if c not in (*SEASON, "team", "opponent", "family")]
    own = part.groupBy(*TEAM, "family").agg(*sums).withColumn("direction", F.lit("for"))
    against = part.groupBy(*SEASON, F.col("opponent").alias("team"), "family").agg(*sums).withColumn("direction", F.lit("against"))
    return own.unionByName(against)


def dashboard(e: DataFrame, valued: DataFrame) -> DataFrame:
    """Overview totals of a team's season beside what it conceded."""
    counts = {
        "passes": "e_pass", "good_passes": "e_pass and e_success", "shots": "e_shot", "on_target": "e_on_target", "goals": "e_goal",
        "final_third_entries": "e_final_third", "box_entries": "e_box", "crosses": "e_cross", "good_crosses": "e_cross and e_success", "high_regains": "e_regain",
        "defensive_actions": "e_defensive", "set_piece_shots": "e_set_piece and e_shot", "central_entries": "e_box and e_central", "wide_entries": "e_box and e_wide",
    }
    part = e.groupBy(*SEASON, "team", "opponent", "match_id").agg(F.count(F.lit(1)).alias("events"), *[n(r).alias(k) for k, r in counts.items()])
    names = ["events", *counts]
    own = part.groupBy(*TEAM).agg(F.count_distinct("match_id").alias("matches"), *[F.sum(c).alias(c) for c in names])
    agn = part.groupBy(*SEASON, F.col("opponent").alias("team")).agg(*[F.sum(c).alias(f"{c}_against") for c in names])
    val = valued.groupBy(*SEASON, "team", "opponent").agg(
        F.sum("xg").alias("xg"), F.sum(F.expr("if(is_penalty, 0D, xg)")).alias("np_xg"), F.sum("positive_league_xt").alias("xt"),
        F.sum(F.expr("if(is_set_piece, positive_league_xt, 0D)")).alias("set_piece_xt"),
    )
    vs = ["xg", "np_xg", "xt", "set_piece_xt"]
    vo = val.groupBy(*TEAM).agg(*[F.sum(c).alias(c) for c in vs])
    va = val.groupBy(*SEASON, F.col("opponent").alias("team")).agg(*[F.sum(c).alias(f"{c}_against") for c in ("xg", "np_xg", "xt")])
    df = own.join(agn, TEAM, "left").join(vo, TEAM, "left").join(va, TEAM, "left")
    rate = lambda a, b: F.expr(f"if({b} > 0, 100D * {a} / {b}, 0D)")
    return df.withColumns(
        {
            "pass_pct": rate("good_passes", "passes"), "cross_pct": rate("good_crosses", "crosses"), "central_protection": F.expr("if(box_entries_against > 0, 100D - 100D * central_entries_against / box_entries_against, 100D)"),
            "event_share": rate("events", "(events + events_against)"), "xg_per_shot": F.expr("xg / greatest(shots, 1)"), "xg_difference": F.expr("xg - xg_against"),
        }
    )


# Labels by score.
STRENGTH = "case when score >= 72 then 'Strong' when score >= 48 then 'Competitive' else 'Needs work' end"


def phase_percentiles(radar: DataFrame, dash: DataFrame, transitions: DataFrame, set_pieces: DataFrame, players: DataFrame) -> DataFrame:
    """Seven phases of five items each: league percentiles or scaled counts, capped at 100."""
    wanted = ["field_tilt", "final_third_for", "xt", "shots_for", "xg_for", "xa", "box_for", "shots_against", "xg_against", "regains", "defensive_actions", "box_against"]
    p = radar.groupBy(*TEAM).pivot("metric", wanted).agg(F.first("percentile"))
    p = p.select(*TEAM, *[F.col(c).alias(f"p_{c}") for c in wanted])
    tr = transitions.groupBy(*TEAM).agg(*[F.sum(c).alias(c) for c in ("counter_attacks", "regains_to_shot", "fast_attacks", "losses_to_shot")])
    sp = set_pieces.groupBy(*TEAM).agg(
        *[F.sum(F.expr(f"if(direction = 'for' and family = '{f}', events, 0)")).alias(f"sp_{f}") for f in FAMILIES],
        F.sum(F.expr("if(direction = 'for', xg, 0D)")).alias("sp_xg"), F.sum(F.expr("if(direction = 'against', xg, 0D)")).alias("sp_xg_against"),
    )
    pl = players.groupBy(*TEAM).agg(
        n("score > 0").alias("depth"), n("shots > 0").alias("shooters"), n("final_third_entries > 0").alias("progressors"),
        n("defensive_actions > 0").alias("defenders"), n("set_pieces > 0").alias("specialists"),
    )
    df = p.join(dash.select(*TEAM, "event_share"), TEAM).join(tr, TEAM, "left").join(sp, TEAM, "left").join(pl, TEAM, "left").na.fill(0)
    cap = lambda c, k: f"least(100D, {c} * {k}D)"
    phases = {
        "in_possession": ["greatest(p_field_tilt, event_share)", "p_final_third_for", "p_final_third_for", "event_share", "p_xt"],
        "chance_creation": ["p_shots_for", "p_xg_for", "p_xa", "p_xa", "p_box_for"],
        "box_threat": ["p_final_third_for", "p_box_for", "p_xg_for", "p_xg_for", "p_xt"],
        "defensive_control": ["p_shots_against", "p_xg_against", "p_regains", "p_defensive_actions", "p_box_against"],
        "transitions": ["p_regains", cap("counter_attacks", 8), cap("regains_to_shot", 10), cap("fast_attacks", 8), f"100D - {cap('losses_to_shot', 3)}"],
        "set_pieces": [cap("sp_corner", 3), cap("sp_free_kick", 2), cap("sp_throw_in", 1.2), cap("sp_xg", 25), f"100D - {cap('sp_xg_against', 25)}"],
        "player_influence": [cap("depth", 6), cap("shooters", 15), cap("progressors", 12), cap("defenders", 8), cap("specialists", 16)],
    }
    rows = F.array(*[F.struct(F.lit(k).alias("phase"), F.expr(f"({' + '.join(items)}) / 5").alias("score")) for k, items in phases.items()])
    return df.select(*TEAM, F.explode(rows).alias("r")).select(*TEAM, "r.*").withColumn("strength", F.expr(STRENGTH))


def defensive_bundle(valued: DataFrame) -> DataFrame:
    """The defensive sections of every match and team side by side."""
    funnel = defence.chain_funnel(valued)
    opp = defence.other_side(funnel, ["attacks", "reached_final", "entered_box", "chains_with_shots"]).select(
        *MT, "opp_attacks", "opp_reached_final", "opp_entered_box", "opp_chains_with_shots"
    )
    press = links.pressing_effect(valued).select(*MT, "presses", "forced_total", "escapes")
    height = defence.height_profile(valued).select(*MT, "mean_x", "block_label")
    duel = defence.duel_control(valued, []).select(*MT, "duels", F.col("won").alias("duels_won"))
    back = defence.disruption(valued).select(*MT, "high", "middle", "low", "forced_back", "regains_after_loss")
    lead = defence.leaders(valued).where("pos = 1").select(*MT, F.col("player").alias("leader"), F.col("score").alias("leader_score"))
    out = opp
    for part in (press, height, duel, back, lead):
        out = out.join(part, MT, "left")
    return out
