"""Line-ups, keepers, discipline and player lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.flags import with_flags
from touchline.operators import defence, setpieces
from touchline.operators.facts import n
from touchline.operators.filters import SUBSTITUTION
from touchline.operators.maps import MT
from touchline.operators.topk import top_per_group

TEAM = ["nation", "tier", "season", "team"]


def discipline(c: DataFrame) -> DataFrame:
    """Cards, goals and first substitution minute per player."""
    df = c.groupBy("match_id", "team_side", "player").agg(
        n("is_yellow_card").alias("yellow"), n("is_red_card").alias("red"), n("is_goal").alias("goals"),
        F.min(F.expr(f"if({SUBSTITUTION}, expanded_minute, null)")).alias("substitution_minute"),
    )
    return df.where("yellow > 0 or red > 0 or goals > 0 or substitution_minute is not null")


def lineup_candidates(c: DataFrame, positions: DataFrame) -> DataFrame:
    """Saved positions first, else the first event row of a player; the first eleven to appear
    start where nothing is saved."""
    order = F.struct("period", "expanded_minute", "event_index")
    seen = c.groupBy("match_id", "team", "team_side", "player").agg(
        F.min(order).alias("first"), F.min("shirt_no").alias("shirt_no")
    )
    w = Window.partitionBy("match_id", "team").orderBy("first", "player")
    seen = seen.withColumn("appearance", F.row_number().over(w)).drop("first")
    saved = positions.select("match_id", "team", "player", "position", "is_starter")
    df = seen.join(saved, ["match_id", "team", "player"], "full_outer")
    has = F.max(F.when(F.col("position").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("match_id", "team"))
    return df.withColumn("_has", has).withColumn(
        "starter", F.expr("coalesce(is_starter, _has = 0 and appearance <= 11, false)")
    ).drop("_has", "is_starter")


def best_lineup_row(rows: DataFrame) -> DataFrame:
    """One row per (match, team, player) out of several: a start position wins, then not a
    substitute, then the longer position text; starter if any row says so."""
    w = Window.partitionBy("match_id", "team", "player").orderBy(
        F.expr("position is not null and position not in ('', 'Unknown', 'Sub')").desc(), F.expr("coalesce(position, '') = 'Sub'"),
        F.length(F.coalesce("position", F.lit(""))).desc(), F.col("position"), F.col("row_no"),
    )
    any_true = F.max("is_starter").over(Window.partitionBy("match_id", "team", "player"))
    df = rows.withColumns({"_k": F.row_number().over(w), "starter": any_true})
    df = df.withColumn("starter", F.expr("coalesce(starter, position is not null and position not in ('', 'Unknown', 'Sub'))"))
    return df.where("_k = 1").drop("_k", "is_starter")


def match_setup(c: DataFrame, positions: DataFrame) -> DataFrame:
    """Line-up with starters, bench, cards, goals and substitution minute."""
    df = lineup_candidates(c, positions).join(discipline(c).drop("team_side"), ["match_id", "player"], "left")
    return df.na.fill(0, ["yellow", "red", "goals"]).withColumn(
        "role", F.expr("case when not starter or (substitution_minute is not null and coalesce(position, 'Sub') = 'Sub') then 'bench' else 'starter' end")
    )


def enrich_shirts(events: DataFrame, lineup: DataFrame) -> DataFrame:
    shirts = lineup.groupBy("match_id", "team_side", "player").agg(F.min("shirt_no").alias("lineup_shirt"))
    return events.join(shirts, ["match_id", "team_side", "player"], "left").withColumn("shirt_no", F.coalesce("shirt_no", "lineup_shirt"))


def keepers(e: DataFrame) -> DataFrame:
    """Keeper per team: keeper rows by event kind, position or shirt, else the deepest passer."""
    df = with_flags(e, _gk="type_c rlike 'keeper|save$|claim|punch' or position = 'GK' or shirt_no = 1")
    g = df.groupBy(*TEAM, "player").agg(n("_gk").alias("keeper_rows"), n("e_pass").alias("passes"), F.avg(F.expr("if(e_pass, x, null)")).alias("pass_x"))
    w = Window.partitionBy(*TEAM).orderBy(F.desc("keeper_rows"), F.round("pass_x", 6).asc_nulls_last(), "player")
    return g.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def keeper_distribution(e: DataFrame) -> DataFrame:
    """Pass length bands of the keeper with completion, progress and target lanes."""
    k = keepers(e).select(*TEAM, "player")
    df = e.where("e_pass and end_x is not null and x is not null").join(k, [*TEAM, "player"], "left_semi")
    df = df.withColumns(
        {
            "length": F.expr("sqrt(power(eex - ex, 2) + power(eey - ey, 2))"),
            "target_lane": F.expr("case when eey < 80/3.0D then 'left' when eey <= 160/3.0D then 'central' else 'right' end"),
        }
    ).withColumn("band", F.expr("case when length < 20 then 'short' when length < 45 then 'medium' when length < 55 then 'long' else 'launched' end"))
    out = df.groupBy(*TEAM, "player", "band", "target_lane").agg(
        F.count(F.lit(1)).alias("passes"), n("e_success").alias("good"), n("eex - ex >= 10").alias("progressive"), F.avg("length").alias("mean_length")
    )
    return out.withColumn("completion", F.expr("100D * good / passes"))


def common_lineup(e: DataFrame) -> DataFrame:
    """Most used eleven with role by mean place."""
    g = e.groupBy(*TEAM, "player").agg(
        F.count_distinct("match_id").alias("matches"), F.count(F.lit(1)).alias("events"), F.avg(F.expr("ex / 1.2D")).alias("mean_x"), F.avg(F.expr("ey / 0.8D")).alias("mean_y")
    )
    df = top_per_group(g, TEAM, [F.desc("matches"), F.desc("events"), F.col("player")], 11)
    return df.withColumn("role", F.expr("case when mean_x < 26 then 'DF' when mean_x < 55 then 'MF' when mean_x < 75 then 'AM' else 'FW' end"))


def formation(lineup: DataFrame) -> DataFrame:
    df = lineup.groupBy(*TEAM).agg(*[n(f"role = '{r}'").alias(r) for r in ("DF", "MF", "AM", "FW")])
    return df.withColumn("formation", F.expr("concat_ws('-', cast(DF as string), cast(MF as string), cast(AM as string), cast(FW as string))"))


def best_players(valued: DataFrame) -> DataFrame:
    """Attack, defence, transition, set-piece and overall score per match player."""
    p = valued.groupBy(*MT, "player").agg(
        n("is_goal").alias("g"), n("is_shot").alias("s"), n("box_entry").alias("b"), n("final_third_entry").alias("f"), n("is_cross").alias("c"),
        n("is_carry").alias("ca"), n("is_take_on").alias("t"), n("high_regain").alias("r"), n("is_defensive_action").alias("d"), F.sum("positive_xt").alias("xt"),
    )
    lead = defence.leaders(valued).select(*MT, "player", F.col("score").alias("dl"))
    weight = "case role when 'taker' then 0.75D when 'first_contact' then 1D when 'shot' then 1.4D when 'clearer' then 1D else 1.3D end"
    sp = setpieces.involvement(setpieces.sequences_(valued)).groupBy(*MT, "player").agg(F.sum(F.expr(f"count * {weight}")).alias("set_piece_score"))
    df = p.join(lead, [*MT, "player"], "left").join(sp, [*MT, "player"], "left").na.fill(0.0, ["dl", "set_piece_score"])
    df = df.withColumns(
        {
            "attacking_score": F.expr("5D*g + 1.25D*s + 1.15D*b + 0.55D*f + 0.35D*c + 0.35D*(ca + t) + 14D*xt"),
            "defensive_score": F.expr("2.2D*r + 0.45D*d + dl"),
            "transition_score": F.expr("2D*r + 0.8D*b + 0.35D*f + 0.35D*(ca + t) + 7D*xt"),
        }
    )
    df = df.withColumn("overall_score", F.expr("attacking_score + defensive_score + transition_score + set_piece_score"))
    return df.select(*MT, "player", "attacking_score", "defensive_score", "transition_score", "set_piece_score", "overall_score")


def best_lists(scores: DataFrame, k: int | None = None) -> DataFrame:
    names = ["attacking", "defensive", "transition", "set_piece", "overall"]
    items = F.array(*[F.struct(F.lit(c).alias("list"), F.round(f"{c}_score", 8).alias("score")) for c in names])
    df = scores.select(*MT, "player", F.explode(items).alias("i")).select(*MT, "player", "i.*").where("score > 0")
    return top_per_group(df, [*MT, "list"], [F.desc("score"), F.col("player")], k)


def metric_merge(players: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics joined by player id, else by lower-case name."""
    by_id = metrics.where("player_id is not null").groupBy("team", "player_id").agg(F.sum("xg").alias("_a"))
    by_name = metrics.groupBy("team", F.lower("player").alias("_name")).agg(F.sum("xg").alias("_b"))
    df = players.withColumn("_name", F.lower("player")).join(by_id, ["team", "player_id"], "left").join(by_name, ["team", "_name"], "left")
    return df.withColumn("xg", F.coalesce("_a", "_b", F.lit(0.0))).drop("_a", "_b", "_name")
