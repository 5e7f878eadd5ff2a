"""Set-piece sequences and what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry
from touchline.functions.flags import with_flags
from touchline.operators.ordering import ORDER, match_window
from touchline.operators.sequences import STOPPAGE
from touchline.operators.topk import top_per_group

_TEXT = "concat(type_c, outcome_c, qual_c)"
_DELIVERY = "(is_pass or is_cross or is_carry)"
RESTART = (
    "case when is_penalty then true"
    f" when is_corner then not is_shot and ({_DELIVERY} or contains({_TEXT},'corner'))"
    " when is_free_kick then true"
    f" when is_throw_in then not is_shot and ({_DELIVERY} or contains({_TEXT},'throw')) else false end"
)
KIND = (
    "case when is_penalty then 'Penalty' when is_corner then 'Corner'"
    f" when is_free_kick then case when is_shot or contains({_TEXT},'direct') or contains({_TEXT},'shot') then 'Direct free kick'"
    " when x >= 55 then 'Wide free kick' else 'Free kick' end"
    " when is_throw_in then case when x >= 66.67 then 'Final third throw in' else 'Throw in' end else 'Set piece' end"
)


def with_restarts(prepared: DataFrame) -> DataFrame:
    return with_flags(prepared, is_restart=RESTART).withColumn("restart_type", F.expr(KIND))


def zone_label(x: str, y: str) -> Column:
    lane = geometry.lane5(y)
    family = F.expr(
        f"case when {y} < 18 or {y} > 82 then 'Wide box' when {y} < 38 or {y} > 62 then 'Half space box' else 'Central box' end"
    )
    words = F.regexp_replace(lane, "_", " ")
    return (
        F.when(F.expr(f"{x} is null or {y} is null"), "Unknown zone")
        .when(geometry.in_box(x, y), family)
        .when(F.expr(f"{x} >= 66.67"), F.concat(F.lit("Final third "), words))
        .when(F.expr(f"{x} >= 33.33"), F.concat(F.lit("Middle third "), words))
        .otherwise(F.concat(F.lit("Deep "), words))
    )


def sequence_rows(prepared: DataFrame) -> DataFrame:
    """Rows that belong to a restart: same period, at most 20 s and 14 actions, up to the next
    restart, up to and with the first stoppage that is no set piece."""
    df = with_restarts(prepared)
    w = match_window("period")
    df = df.withColumn("restart_no", F.sum(F.col("is_restart").cast("int")).over(w)).where("restart_no > 0")
    ws = Window.partitionBy("match_id", "period", "restart_no").orderBy(*ORDER)
    df = df.withColumns({"step": F.row_number().over(ws), "_t0": F.first("clock_s").over(ws), "restart_team": F.first("team").over(ws)})
    df = with_flags(df, _halt=f"step > 1 and concat(type_c, outcome_c) rlike '{STOPPAGE}' and not is_set_piece")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_halted", F.coalesce(F.max(F.col("_halt").cast("int")).over(before), F.lit(0)))
    return df.where("_halted = 0 and clock_s - _t0 <= 20 and step <= 14").drop("_halt", "_halted", "_t0")


def sequences_(prepared: DataFrame) -> DataFrame:
    """One row per restart."""
    df = with_flags(
        sequence_rows(prepared),
        _meant="step > 1 and (is_touch or is_pass or is_cross or is_carry or is_shot or is_defensive_action)",
        _own="team = restart_team",
    )
    ws = Window.partitionBy("match_id", "period", "restart_no").orderBy(*ORDER)
    df = df.withColumn("_m", F.sum(F.col("_meant").cast("int")).over(ws))
    who = F.struct("team", "player", "event_index")
    out = df.groupBy("match_id", "period", "restart_no", F.col("restart_team").alias("team")).agg(
        F.min_by(
            F.struct("event_index", "player", "opponent", "restart_type", "x", "y", "end_x", "end_y", "expanded_minute", "is_success"),
            F.struct("step"),
        ).alias("r"),
        F.max(F.when(F.expr("_meant and _m = 1"), who)).alias("first_contact"),
        F.max(F.when(F.expr("_meant and _m = 2"), who)).alias("second_ball"),
        F.min(F.when(F.expr("_own and is_shot"), F.struct("event_index", "player", "x", "y"))).alias("shot"),
        F.max(F.expr("_own and is_goal")).alias("led_to_goal"),
        F.max(F.expr(f"not _own and (is_defensive_action or {_TEXT} rlike 'clearance|block')")).alias("cleared_or_blocked"),
        F.count(F.lit(1)).alias("action_count"),
        F.max_by("type", F.struct("step")).alias("final_type"),
        F.min(F.when(F.expr("not _own and type_c like '%clearance%'"), F.struct("event_index", "player"))).alias("clearance"),
        F.min(F.when(F.expr("not _own and type_c like '%block%'"), F.struct("event_index", "player"))).alias("block"),
    )
    return out.selectExpr(
        "match_id", "period", "team", "r.opponent as opponent", "r.event_index as event_index", "r.player as taker",
        "r.restart_type as restart_type", "r.x as start_x", "r.y as start_y", "r.end_x as end_x", "r.end_y as end_y",
        "r.expanded_minute as minute", "first_contact", "second_ball", "shot", "clearance", "block",
        "coalesce(first_contact.team = team, false) as first_contact_won", "coalesce(second_ball.team = team, false) as second_ball_retained",
        "shot is not null as led_to_shot", "led_to_goal", "cleared_or_blocked", "action_count", "final_type",
    )


def routines(seqs: DataFrame) -> DataFrame:
    """Delivery distance, target, routine label, delivery pattern, tag and outcome text."""
    df = with_flags(seqs, _box="end_x >= 83 and end_y between 21.1 and 78.9")
    df = df.withColumns(
        {
            "distance": F.expr("if(start_x is null or start_y is null, 0D, hypot(coalesce(end_x, start_x) - start_x, coalesce(end_y, start_y) - start_y))"),
            "post_target": F.expr(
                "case when start_y is null or end_x is null or end_y is null then 'unknown' when not _box then 'outside box'"
                " when end_y between 39 and 61 then 'central box' when start_y <= 50 then if(end_y <= 39, 'near post', 'far post')"
                " else if(end_y >= 61, 'near post', 'far post') end"
            ),
            "target_zone": zone_label("end_x", "end_y"),
        }
    )
    return df.withColumns(
        {
            "routine": F.expr(
                """case restart_type when 'Penalty' then 'Penalty' when 'Direct free kick' then 'Direct free kick shot'
                when 'Corner' then case when distance <= 12 then 'Short corner' when _box then concat('Corner to ', post_target) else 'Corner recycled outside box' end
                when 'Wide free kick' then case when _box then concat('Wide free kick to ', post_target) when distance <= 10 then 'Short wide free kick' else 'Wide free kick recycled outside box' end
                when 'Final third throw in' then case when _box and distance >= 16 then 'Long throw into box' when distance <= 8 then 'Short throw routine' else 'Final third throw continuation' end
                when 'Throw in' then 'Throw in continuation' when 'Free kick' then 'Free kick continuation' else 'Set piece continuation' end"""
            ),
            "tag": F.expr(
                """case restart_type when 'Penalty' then 'Penalty' when 'Direct free kick' then 'Direct free kick'
                when 'Corner' then case when distance <= 12 then 'Short corner' when not first_contact_won and not led_to_shot then 'Cleared first contact'
                  when second_ball_retained and led_to_shot then 'Second ball' when _box and end_y between 38 and 62 then 'Central crowd'
                  when coalesce(end_y, start_y, 0) <= 33 or coalesce(end_y, start_y, 0) >= 67 then 'Near or far post delivery' else 'Central delivery' end
                when 'Final third throw in' then if(led_to_shot, 'Long throw', 'Final third throw')
                when 'Throw in' then 'Set piece sequence' when 'Set piece' then 'Set piece sequence'
                else case when first_contact is null and not led_to_shot then 'Poor delivery' when second_ball_retained then 'Second ball'
                  when restart_type = 'Wide free kick' then 'Wide free kick delivery' else 'Free kick delivery' end end"""
            ),
            "outcome": F.expr(
                "coalesce(nullif(concat_ws(', ', case when led_to_goal then 'goal' when led_to_shot then 'shot' end,"
                " if(first_contact_won, 'first contact won', null), if(second_ball_retained, 'second ball retained', null)), ''), 'no shot')"
            ),
        }
    ).drop("_box")


def summary(seqs: DataFrame) -> DataFrame:
    """Counts for and against per match and team."""
    n = lambda r: F.count_if(F.expr(r))
    own = seqs.groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("set_pieces"), n("restart_type = 'Corner'").alias("corners"), n("restart_type like '%ree kick'").alias("free_kicks"),
        n("restart_type like '%hrow in'").alias("throw_ins"), n("restart_type = 'Penalty'").alias("penalties"),
        n("led_to_shot").alias("shots"), n("led_to_goal").alias("goals"), n("first_contact_won").alias("first_contacts"), n("second_ball_retained").alias("second_balls"),
    )
    against = seqs.groupBy("match_id", F.col("opponent").alias("team")).agg(
        F.count(F.lit(1)).alias("set_pieces_against"), n("led_to_shot").alias("shots_against"), n("led_to_goal").alias("goals_against")
    )
    out = own.join(against, ["match_id", "team"], "full_outer").na.fill(0)
    return out.withColumns(
        {
            "first_contact_rate": F.expr("if(set_pieces > 0, 100D * first_contacts / set_pieces, 0D)"),
            "second_ball_rate": F.expr("if(set_pieces > 0, 100D * second_balls / set_pieces, 0D)"),
        }
    )


def involvement(seqs: DataFrame) -> DataFrame:
    """Who took, met, shot, cleared and blocked."""
    role = lambda n, team, p: F.struct(F.lit(n).alias("role"), F.expr(team).alias("t"), F.expr(p).alias("player"))
    roles = F.array(
        role("taker", "team", "taker"),
        role("first_contact", "team", "if(first_contact_won, first_contact.player, null)"),
        role("shot", "team", "shot.player"),
        role("clearer", "opponent", "clearance.player"),
        role("blocker", "opponent", "block.player"),
    )
    df = seqs.select("match_id", F.explode(roles).alias("r")).where("r.player is not null")
    return df.groupBy("match_id", F.col("r.t").alias("team"), "r.role", "r.player").agg(F.count(F.lit(1)).alias("count"))


def routine_groups(seqs: DataFrame) -> DataFrame:
    df = routines(seqs)
    n = lambda r: F.count_if(F.expr(r))
    out = df.groupBy("team", "routine").agg(
        F.count(F.lit(1)).alias("count"), n("led_to_shot").alias("shots"), n("led_to_goal").alias("goals"),
        n("first_contact_won").alias("first_contacts"), F.avg("distance").alias("mean_distance"),
    )
    return out.withColumn("shot_rate", F.expr("100D * shots / count"))


def routine_zones(seqs: DataFrame, k: int | None = None) -> DataFrame:
    df = routines(seqs).groupBy("team", "routine", "target_zone").agg(F.count(F.lit(1)).alias("count"))
    return top_per_group(df, ["team", "routine"], [F.desc("count"), F.col("target_zone")], k)
