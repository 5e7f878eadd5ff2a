"""Defensive control: funnels, lanes, duels, block shape, leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry
from touchline.functions.flags import with_flags
from touchline.operators import links, sequences
from touchline.operators.maps import MT, share

CATEGORY = (
    "case when type_c like '%interception%' then 'Interceptions' when type_c rlike 'tackle|challenge' then 'Tackles and challenges'"
    " when type_c like '%clearance%' then 'Clearances' when type_c like '%block%' then 'Blocks' when type_c like '%recovery%' then 'Recoveries'"
    " when type_c rlike 'aerial|duel' then 'Duels' when type_c like '%foul%' then 'Fouls' else 'Other defensive actions' end"
)
_TXT = "concat(type_c, outcome_c, qual_c)"


def n(rule: str):
    return F.count_if(F.expr(rule))


def other_side(df: DataFrame, names: list[str], prefix: str = "opp_") -> DataFrame:
    """Per-match team rows with the other team's columns beside them (two rows per match)."""
    o = df.select("match_id", F.col("team").alias("_t"), *[F.col(c).alias(prefix + c) for c in names])
    pair = df.join(o, "match_id").where("team <> _t")
    return pair.drop("_t")


def chain_funnel(prepared: DataFrame) -> DataFrame:
    """How far the attacks of each team got, by chain."""
    df = sequences.attack_chains(prepared, per_team=True)
    box_end = "(end_x >= 83 and end_y between 21.1 and 78.9)"
    chains = df.groupBy(*MT, "attack_chain_id").agg(
        F.coalesce(F.expr("max(greatest(coalesce(x, 0D), coalesce(end_x, 0D))) >= 33.33"), F.lit(False)).alias("middle"),
        F.expr("max(final_third_entry or coalesce(x >= 66.67, false) or coalesce(end_x >= 66.67, false))").alias("final"),
        F.expr(f"max(box_entry or start_in_box or coalesce({box_end}, false))").alias("box"),
        F.max("is_shot").alias("shot"), F.max("is_goal").alias("goal"), n("is_shot").alias("shots"), n("is_goal").alias("goals"),
    )
    out = chains.groupBy(*MT).agg(
        F.count(F.lit(1)).alias("attacks"), n("middle").alias("reached_middle"), n("final").alias("reached_final"), n("box").alias("entered_box"),
        n("shot").alias("chains_with_shots"), n("goal").alias("chains_with_goals"), F.sum("shots").alias("shots"), F.sum("goals").alias("goals"),
    )
    return out.withColumns(
        {
            "final_third_rate": F.expr("100D * reached_final / attacks"), "box_rate": F.expr("100D * entered_box / attacks"),
            "shot_from_box_rate": F.expr("if(entered_box > 0, 100D * chains_with_shots / entered_box, 0D)"),
            "goal_from_shot_rate": F.expr("if(chains_with_shots > 0, 100D * chains_with_goals / chains_with_shots, 0D)"),
            "early_stop_rate": F.expr("100D * (attacks - reached_final) / attacks"),
        }
    )


def event_funnel(e: DataFrame) -> DataFrame:
    """Season funnel by events of the opponent."""
    df = e.groupBy("nation", "tier", "season", F.col("opponent").alias("team")).agg(
        n("e_move").alias("attacks"), n("e_final_third").alias("final_third"), n("e_box").alias("box"), n("e_shot").alias("shots"), n("e_goal").alias("goals")
    )
    return df.withColumns(
        {
            "stopped_before_final_third": F.expr("greatest(attacks - final_third, 0)"), "stopped_before_box": F.expr("greatest(final_third - box, 0)"),
            "stopped_before_shot": F.expr("greatest(box - shots, 0)"), "stopped_before_goal": F.expr("greatest(shots - goals, 0)"),
        }
    )


def lane_protection(prepared: DataFrame, family: bool = False) -> DataFrame:
    """What each team allowed per lane (or lane family): entries, box entries, shots, goals."""
    df = prepared.withColumns(
        {"_pl": geometry.lane5("end_y"), "_sl": geometry.lane5("y")}
    )
    items = F.array_compact(
        F.array(
            F.when(F.expr(f"{links.PROGRESSION} and (final_third_entry or box_entry)"),
                   F.expr("struct(_pl as lane, int(final_third_entry) as ft, int(box_entry) as bx, 0 as sh, 0 as gl)")),
            F.when(F.col("is_shot"), F.expr("struct(_sl as lane, 0 as ft, 0 as bx, 1 as sh, int(is_goal) as gl)")),
        )
    )
    df = df.select("match_id", F.col("opponent").alias("team"), F.explode(items).alias("i")).select(*MT, "i.*").where("lane <> 'unknown'")
    if family:
        df = df.withColumn("lane", geometry.lane_family("lane"))
    out = df.groupBy(*MT, "lane").agg(
        F.sum("ft").alias("final_third_entries"), F.sum("bx").alias("box_entries"), F.sum("sh").alias("shots"), F.sum("gl").alias("goals")
    )
    return out.withColumns({f"{c}_share": share(c, MT) for c in ("final_third_entries", "box_entries", "shots")})


def duels(prepared: DataFrame) -> DataFrame:
    """Duel rows with kind, lane and result (exact outcome words)."""
    df = with_flags(
        prepared.where("is_defensive_action"),
        duel=f"{_TXT} rlike 'duel|aerial|challenge|tackle'",
        aerial=f"{_TXT} rlike 'aerial|headed|header'",
        won="is_success",
    )
    return df.where("duel").withColumn("lane", geometry.lane5("y"))


def duel_control(prepared: DataFrame, by: list[str]) -> DataFrame:
    df = duels(prepared).groupBy(*MT, *by).agg(
        F.count(F.lit(1)).alias("duels"), n("won").alias("won"), n("aerial").alias("aerial"), n("aerial and won").alias("aerial_won"),
        n("not aerial").alias("ground"), n("not aerial and won").alias("ground_won"),
    )
    return df.withColumns({"lost": F.expr("duels - won"), "win_rate": F.expr("100D * won / duels")})


def disruption(prepared: DataFrame) -> DataFrame:
    d = "is_defensive_action"
    own = prepared.groupBy(*MT).agg(
        n(f"{d} and x >= 66.67").alias("high"), n(f"{d} and x >= 33.33 and x < 66.67").alias("middle"), n(f"{d} and x < 33.33").alias("low"),
        F.avg(F.expr(f"if({d}, x, null)")).alias("mean_height"), n("high_regain").alias("high_regains"),
        n(links.PROGRESSION).alias("progressions"), n(f"{links.PROGRESSION} and end_x < x").alias("went_back"),
        n(f"{links.PROGRESSION} and end_x <= x + 3").alias("recycled"),
    )
    out = other_side(own, ["progressions", "went_back", "recycled"])
    return out.select(
        *MT, "high", "middle", "low", "mean_height", "high_regains", F.col("opp_went_back").alias("forced_back"), F.col("opp_recycled").alias("recycled"),
        F.expr("if(opp_progressions > 0, 100D * opp_went_back / opp_progressions, 0D)").alias("forced_back_share"),
    ).join(links.regains_after_loss(prepared), MT, "left")


def height_profile(valued: DataFrame) -> DataFrame:
    """Block label from action height, value allowed and how often box entries became shots."""
    d = "(is_defensive_action and x is not null and y is not null)"
    own = valued.groupBy(*MT).agg(
        n(d).alias("actions"), F.avg(F.expr(f"if({d}, x, null)")).alias("mean_x"), n(f"{d} and x < 33.33").alias("deep"), n(f"{d} and x >= 66.67").alias("high"),
        F.sum(F.expr(f"if({links.PROGRESSION}, positive_xt, 0D)")).alias("xt"),
        F.sum(F.expr(f"if({links.PROGRESSION} and end_y >= 18 and end_y <= 82, positive_xt, 0D)")).alias("central_xt"),
        n("is_shot").alias("shots"),
    )
    entries = links.box_entry_arrows(valued).groupBy(*MT).agg(F.count(F.lit(1)).alias("entries"), n("led_to_shot").alias("entry_shots"))
    own = own.join(entries, MT, "left").na.fill(0, ["entries", "entry_shots"])
    df = other_side(own, ["xt", "central_xt", "shots", "entries", "entry_shots"])
    df = df.withColumns(
        {
            "deep_share": F.expr("if(actions > 0, 100D * deep / actions, 0D)"), "high_share": F.expr("if(actions > 0, 100D * high / actions, 0D)"),
            "central_share": F.expr("if(opp_xt > 0, 100D * opp_central_xt / opp_xt, 0D)"),
            "entry_shot_rate": F.expr("if(opp_entries > 0, 100D * opp_entry_shots / opp_entries, 0D)"),
        }
    )
    return df.select(
        *MT, "actions", "mean_x", "deep_share", "high_share", "central_share", "entry_shot_rate", F.col("opp_xt").alias("xt_allowed"), F.col("opp_entries").alias("entries_allowed"),
        F.expr(
            """case when actions = 0 then 'No clear block profile' when mean_x < 38 and entry_shot_rate <= 32 and central_share <= 42 then 'Deep compact block'
            when mean_x < 38 then 'Deep pressure survival' when mean_x < 58 and entry_shot_rate <= 38 and central_share <= 45 then 'Mid block control'
            when mean_x < 58 then 'Mid block exposed' when high_share >= 35 and opp_entries <= greatest(4, opp_shots * 2) then 'High disruption profile'
            when high_share >= 35 then 'High press exposed behind' else 'Unclear mixed profile' end"""
        ).alias("block_label"),
    )


def block_map(prepared: DataFrame, by_player: bool = False) -> DataFrame:
    """Mean place and spread (linear quartiles) of defensive actions."""
    df = prepared.where("is_defensive_action and x is not null and y is not null")
    keys = [*MT, "player"] if by_player else MT
    iqr = lambda c: (F.percentile(c, 0.75) - F.percentile(c, 0.25)).alias(f"spread_{c}")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("actions"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), iqr("x"), iqr("y"),
        n("x < 33.33").alias("low"), n("x >= 33.33 and x < 66.67").alias("middle"), n("x >= 66.67").alias("high"),
        F.min("expanded_minute").alias("first_minute"), F.max("expanded_minute").alias("last_minute"),
    )


def category_audit(prepared: DataFrame) -> DataFrame:
    df = prepared.where("is_defensive_action").withColumn("category", F.expr(CATEGORY))
    out = df.groupBy(*MT, "category").agg(F.count(F.lit(1)).alias("count"), n("is_success").alias("good"))
    return out.withColumn("share", share("count", MT))


def leaders(prepared: DataFrame) -> DataFrame:
    """Defensive score per player."""
    df = prepared.where("is_defensive_action").withColumn("category", F.expr(CATEGORY))
    out = df.groupBy(*MT, "player").agg(
        F.count(F.lit(1)).alias("actions"), n("category in ('Interceptions','Recoveries')").alias("interceptions_recoveries"),
        n("category = 'Tackles and challenges' and is_success").alias("tackles_won"), n("high_regain").alias("high_regains"),
        n("category = 'Blocks'").alias("blocks"), n("category = 'Clearances' and start_in_box").alias("box_clearances"),
    )
    out = out.withColumn(
        "score", F.expr("0.4D*actions + 1.4D*interceptions_recoveries + 1.5D*tackles_won + 2D*high_regains + 2.2D*blocks + 1.5D*box_clearances")
    )
    w = Window.partitionBy(*MT).orderBy(F.round("score", 6).desc(), "player")
    return out.withColumn("pos", F.row_number().over(w))
