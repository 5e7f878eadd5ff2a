"""Pitch maps per match and team: networks, grids, lanes, threat boxes, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry
from touchline.functions.flags import with_flags
from touchline.operators import links, sequences
from touchline.operators.topk import top_per_group

MT = ["match_id", "team"]


def share(column: str, keys: list[str]) -> Column:
    total = F.sum(column).over(Window.partitionBy(*keys))
    return F.when(total > 0, F.col(column) * 100.0 / total).otherwise(F.lit(0.0))


def pass_edges(valued: DataFrame, keep: int | None = None) -> DataFrame:
    """Passer -> receiver edges of successful open-play passes."""
    df = links.receivers(valued).where("is_success and not is_set_piece and x is not null and y is not null")
    edges = df.groupBy(*MT, "player", "receiver").agg(
        F.count(F.lit(1)).alias("passes"),
        F.avg("x").alias("start_x"), F.avg("y").alias("start_y"), F.avg("end_x").alias("receive_x"), F.avg("end_y").alias("receive_y"),
        F.sum("positive_xt").alias("xt"),
        F.count_if(F.expr("end_x - x >= 10")).alias("progressive"),
        F.count_if("final_third_entry").alias("final_third_entries"),
        F.count_if("box_entry").alias("box_entries"),
        F.count_if("is_cross").alias("crosses"),
    )
    return top_per_group(edges, MT, [F.desc("passes"), F.col("player"), F.col("receiver")], keep)


def pass_nodes(valued: DataFrame, keep: int | None = None) -> DataFrame:
    """Both roles of every player: passes made and received, weighted mean location, value."""
    edges = pass_edges(valued)
    made = edges.selectExpr(*MT, "player", "passes as made", "0L as received", "start_x * passes as sx", "start_y * passes as sy", "xt")
    got = edges.selectExpr(*MT, "receiver as player", "0L as made", "passes as received", "receive_x * passes as sx", "receive_y * passes as sy", "0D as xt")
    nodes = made.union(got).groupBy(*MT, "player").agg(
        F.sum("made").alias("made"), F.sum("received").alias("received"), F.sum("xt").alias("xt"),
        (F.sum("sx") / F.sum(F.expr("made + received"))).alias("x"), (F.sum("sy") / F.sum(F.expr("made + received"))).alias("y"),
    ).withColumn("involvement", F.expr("made + received"))
    return top_per_group(nodes, MT, [F.desc("involvement"), F.col("player")], keep)


def data_grid(df: DataFrame, keys: list[str], x: str, y: str, x_bins: int = 6, y_bins: int = 5, weight: str | None = None) -> DataFrame:
    """Counts (and weights) on a grid that spans the group's own range, clipped to 0-100."""
    df = df.where(f"{x} is not null and {y} is not null").withColumns(
        {"_x": F.expr(f"least(greatest({x}, 0D), 99.999D)"), "_y": F.expr(f"least(greatest({y}, 0D), 99.999D)")}
    )
    w = Window.partitionBy(*keys)
    df = df.withColumns({f"_{f}{a}": getattr(F, f)(f"_{a}").over(w) for a in "xy" for f in ("min", "max")})

    def cell(a: str, bins: int) -> Column:
        return F.expr(
            f"if(_max{a} > _min{a}, cast(least(floor((_{a} - _min{a}) * {bins} / (_max{a} - _min{a})), {bins} - 1) as int), 0)"
        )

    df = df.withColumns({"x_bin": cell("x", x_bins), "y_bin": cell("y", y_bins)})
    value = F.sum(F.expr(f"greatest(coalesce({weight}, 0D), 0D)")) if weight else F.count(F.lit(1)).cast("double")
    return df.groupBy(*keys, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"), value.alias("value"))


def fixed_grid(df: DataFrame, keys: list[str], x_bins: int = 12, y_bins: int = 8) -> DataFrame:
    df = df.where("x is not null and y is not null")
    return df.groupBy(
        *keys, geometry.grid_cell("x", x_bins).alias("x_bin"), geometry.grid_cell("y", y_bins).alias("y_bin")
    ).agg(F.count(F.lit(1)).alias("count"))


def attack_direction(c: DataFrame) -> DataFrame:
    """Weighted share of attacks per lane."""
    df = with_flags(c, _prog="(is_pass or is_cross or is_carry) and is_success")
    df = df.where(
        "(_prog and (x >= 45 or end_x >= 45 or final_third_entry or box_entry or attacking_third_touch)) or is_shot"
    ).withColumns(
        {
            "lane_x": F.expr("if(_prog and end_x is not null, end_x, x)"),
            "lane_y": F.expr("if(_prog and end_y is not null, end_y, y)"),
            "weight": F.expr(
                "1D + if(final_third_entry, 1.2D, 0D) + if(box_entry, 2.2D, 0D) + if(is_shot, 2.8D, 0D) + if(is_goal, 4D, 0D)"
            ),
        }
    ).where("lane_y is not null").withColumn("lane", geometry.lane3("lane_y"))
    out = df.groupBy(*MT, "lane").agg(
        F.count(F.lit(1)).alias("count"), F.sum("weight").alias("weight"), F.avg("lane_x").alias("mean_x"), F.avg("lane_y").alias("mean_y")
    )
    rank = Window.partitionBy(*MT).orderBy(F.round("weight", 6).desc(), "lane")
    return out.withColumns({"share": share("weight", MT), "rank": F.row_number().over(rank)})


LANES = ["left", "central", "right"]


def threat_lanes(valued: DataFrame) -> DataFrame:
    """Shot value plus positive ball-movement value per lane, all three lanes present."""
    df = valued.withColumn(
        "lane", F.when(F.col("is_shot"), geometry.lane3("y")).otherwise(geometry.lane3("coalesce(end_y, y)"))
    )
    cols = [F.sum(F.when(F.col("lane") == n, F.expr("xg + positive_xt")).otherwise(0.0)).alias(n) for n in LANES]
    out = df.groupBy(*MT).agg(*cols)
    out = out.select(*MT, F.explode(F.array(*[F.struct(F.lit(n).alias("lane"), F.col(n).alias("threat")) for n in LANES])).alias("s")).select(*MT, "s.*")
    rank = Window.partitionBy(*MT).orderBy(F.round("threat", 9).desc(), "lane")
    return out.withColumns({"share": share("threat", MT), "rank": F.row_number().over(rank)})


def lane_kpis(e: DataFrame) -> DataFrame:
    """Moves per lane and season with their entries, shots and shares."""
    df = e.where("e_move or e_shot").withColumn("lane", geometry.lane_120("ey"))
    keys = ["nation", "tier", "season", "team"]
    out = df.groupBy(*keys, "lane").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("e_final_third").alias("final_third_entries"),
        F.count_if("e_box").alias("box_entries"), F.count_if("e_shot").alias("shots"), F.count_if("e_goal").alias("goals"),
        F.count_if("e_cross").alias("crosses"), F.count_if(F.expr("e_pass and e_success")).alias("good_passes"),
    )
    return out.withColumn("share", share("count", keys))


def threat_boxes(valued: DataFrame) -> DataFrame:
    """7 x 3 cells: value of successful progressions at their end, shot value at its origin;
    every cell of the grid is present."""
    prog = valued.where(links.PROGRESSION).select(*MT, F.col("end_x").alias("px"), F.col("end_y").alias("py"), "positive_xt", F.lit(0.0).alias("xg"))
    shot = links.shot_origins(valued).selectExpr(
        *MT, "coalesce(origin.end_x, origin.x, x) as px", "coalesce(origin.end_y, origin.y, y) as py", "0D as positive_xt", "xg"
    )
    df = prog.union(shot).where("px is not null and py is not null")
    df = df.withColumn("cell", geometry.grid_cell("py", 3) * 7 + geometry.grid_cell("px", 7))
    cells = df.groupBy(*MT, "cell").agg(
        F.count(F.lit(1)).alias("actions"), F.sum("positive_xt").alias("xt_created"), F.sum("xg").alias("attributed_xg")
    )
    grid = cells.select(*MT).distinct().select(*MT, F.explode(F.sequence(F.lit(0), F.lit(20))).alias("cell"))
    out = grid.join(cells, [*MT, "cell"], "left").na.fill(0, ["actions", "xt_created", "attributed_xg"])
    out = out.withColumn("threat", F.expr("xt_created + attributed_xg"))
    rank = Window.partitionBy(*MT).orderBy(F.round("threat", 9).desc(), "cell")
    out = out.withColumns({"share": share("threat", MT), "rank": F.row_number().over(rank)})
    return out.withColumn("top_box", F.expr("rank <= 5 and threat > 0"))


def possession_chains(valued: DataFrame) -> DataFrame:
    """Chains of ball actions per side with duration, value and outcome."""
    df = valued.where(
        "(is_pass or is_cross or is_carry or is_take_on or is_shot or box_entry) and x is not null and y is not null"
    )
    w = Window.partitionBy("match_id", "team_key").orderBy("period", "expanded_minute", "event_index")
    df = df.withColumn("_b", F.lag(F.struct("period", "clock_s")).over(w))
    df = with_flags(df, _new="_b is null or _b.period <> period or clock_s - _b.clock_s not between 0 and 10")
    df = df.withColumn("chain_id", F.sum(F.col("_new").cast("int")).over(w))
    order = F.struct("period", "expanded_minute", "event_index")
    ends = F.struct("x", "y", F.expr("coalesce(end_x, x)").alias("fx"), F.expr("coalesce(end_y, y)").alias("fy"), "clock_s",
                    F.expr("(is_pass or is_cross or is_carry or is_take_on) and not is_success").alias("lost"))
    out = df.groupBy(*MT, "chain_id").agg(
        F.count(F.lit(1)).alias("actions"), F.min_by(ends, order).alias("a"), F.max_by(ends, order).alias("z"),
        F.sum("xg").alias("xg"), F.sum("xt_added").alias("xt_added"), F.max("is_shot").alias("_s"), F.max("is_goal").alias("_g"),
        F.max("box_entry").alias("_b"), F.count_distinct("player").alias("players"),
    ).where("actions >= 2 or _s or _b")
    return out.selectExpr(
        *MT, "chain_id", "actions", "players", "a.x as start_x", "a.y as start_y", "z.fx as end_x", "z.fy as end_y",
        "greatest(0D, z.clock_s - a.clock_s) as duration", "xg", "xt_added",
        "case when _g then 'Goal' when _s then 'Shot' when _b then 'Box entry' when z.lost then 'Failed progression'"
        " else 'Retained progression' end as outcome",
    )


def chain_lists(valued: DataFrame, k: int | None = None) -> DataFrame:
    """Six ranked lists of chains per match and team."""
    lists = {
        "best": "true", "long_build_up": "actions >= 7 or duration >= 25", "direct": "duration <= 15 and end_x - start_x >= 25",
        "failed": "outcome = 'Failed progression'", "shot": "outcome in ('Shot','Goal')", "box": "outcome in ('Box entry','Shot','Goal')",
    }
    names = F.array_compact(F.array(*[F.when(F.expr(r), F.lit(n)) for n, r in lists.items()]))
    df = possession_chains(valued).withColumn("list", F.explode(names))
    score = F.round(F.expr("xg + greatest(0D, xt_added)"), 9)
    return top_per_group(df, [*MT, "list"], [score.desc(), F.desc("actions"), F.col("chain_id")], k)


def match_value_breakdown(valued: DataFrame) -> DataFrame:
    return valued.where("(f_pass or f_carry) and f_success and not f_set_piece and zone_start >= 0 and zone_end >= 0").groupBy(*MT, "action_type").agg(
        F.count(F.lit(1)).alias("actions"), F.sum("positive_xt").alias("positive_xt"), F.sum("xt_added").alias("xt_added")
    ).withColumn("share", share("positive_xt", MT))


_OPEN_MOVE = "_move and not f_set_piece"


def top_actions(valued: DataFrame, k: int = 35) -> DataFrame:
    """The ``k`` most valuable open play movements of each team in a match, with where they start and end."""
    df = valued.where(_OPEN_MOVE).where("positive_xt > 0")
    df = df.select(*MT, "event_index", "expanded_minute", "player", "action_type", *[F.expr(f"least(greatest({c}, 0D), 100D)").alias(c) for c in ("x", "y", "end_x", "end_y")], "positive_xt")
    return top_per_group(df, MT, [F.round("positive_xt", 9).desc(), F.col("event_index")], k)


def top_players(valued: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` players of each team in a match whose open play movements add most value."""
    df = valued.where(_OPEN_MOVE).groupBy(*MT, "player").agg(F.sum("positive_xt").alias("total_xt"), F.count("*").alias("actions")).where("round(total_xt, 9) > 0")
    return top_per_group(df, MT, [F.round("total_xt", 9).desc(), F.col("player")], k)


def touch_points(c: DataFrame, k: int | None = None) -> DataFrame:
    """Located touches of each team in match order, all or the first k."""
    df = c.where("is_touch and x is not null and y is not null")
    return top_per_group(df, MT, [F.col("period"), F.col("expanded_minute"), F.col("event_index")], k)


def shot_sequences(valued: DataFrame) -> DataFrame:
    """The unbroken lead-up of every shot: same team run, steps of at most 15 s, not across a
    break, a set-piece shot starting at its set piece, at most 10 actions."""
    df = links.team_runs(valued)
    w = links.run_window()
    df = with_flags(
        df,
        _stop="(type_c rlike 'start|end|substitution|formation|card|foul|offside|clearance'"
        " or outcome_c rlike 'unsuccessful|inaccurate|lost|offside') and not is_set_piece",
    )
    df = df.withColumn("_p", F.lag(F.struct("clock_s", "_stop")).over(w))
    df = with_flags(df, _cut="_p is not null and (clock_s - _p.clock_s > 15 or _p._stop)")
    df = df.withColumn("_seq", F.sum(F.col("_cut").cast("int")).over(w))
    ws = Window.partitionBy("match_id", "run_id", "_seq").orderBy("period", "expanded_minute", "event_index")
    item = F.struct("event_index", "clock_s", "positive_xt", "is_shot", "is_set_piece", "x", "y", "end_x", "end_y", "type_c", "player")
    df = df.withColumn("lead_up", F.collect_list(item).over(ws.rowsBetween(-9, -1))).where("is_shot")
    cut = "size(lead_up) - array_position(reverse(transform(lead_up, a -> a.is_set_piece)), true)"
    df = df.withColumn(
        "lead_up",
        F.expr(
            f"if(is_set_piece and exists(lead_up, a -> a.is_set_piece), slice(lead_up, cast({cut} + 1 as int), 10), lead_up)"
        ),
    )
    return df.withColumns(
        {
            "action_count": F.expr("size(lead_up) + 1"),
            "pre_shot_xt": F.expr("aggregate(filter(lead_up, a -> not a.is_shot), 0D, (s, a) -> s + a.positive_xt)"),
        }
    ).withColumn("threat", F.expr("pre_shot_xt + xg"))


def danger_tags(sequences_: DataFrame) -> DataFrame:
    """Label each shot sequence by how the danger arose."""
    df = sequences_.withColumn("_last", F.expr("get(lead_up, size(lead_up) - 1)"))
    df = df.withColumns(
        {
            "_sl": geometry.lane5("coalesce(_last.y, 50)"), "_el": geometry.lane5("coalesce(_last.end_y, _last.y, 50)"),
        }
    ).withColumns({"_sf": geometry.lane_family("_sl"), "_ef": geometry.lane_family("_el")})
    located = "filter(concat(lead_up, array(named_struct('event_index',event_index,'clock_s',clock_s,'positive_xt',positive_xt,'is_shot',is_shot,'is_set_piece',is_set_piece,'x',x,'y',y,'end_x',end_x,'end_y',end_y,'type_c',type_c,'player',player))), a -> a.x is not null and a.end_x is not null)"
    df = df.withColumn("_loc", F.expr(located))
    df = df.withColumn(
        "_central", F.expr("size(filter(_loc, a -> coalesce(a.end_y, a.y) >= 18 and coalesce(a.end_y, a.y) <= 82))")
    )
    return df.withColumn(
        "tag",
        F.expr(
            """case when is_set_piece or exists(lead_up, a -> a.is_set_piece) then 'Set piece'
            when concat(array_join(transform(lead_up, a -> a.type_c), ' '), ' ', type_c) rlike 'rebound|block|clearance|aerial' then 'Second ball'
            when _last is not null and _last.type_c rlike 'carry|dribble|takeon|run' then 'Individual carry'
            when _last is not null and _last.type_c like '%cross%' and _sf = 'wide' then 'Cross from wide'
            when _last is not null and _sf in ('wide','half_space') and _ef = 'central' and coalesce(_last.end_x, _last.x, 0) >= 83 then 'Cutback or low cross'
            when _last is not null and coalesce(_last.end_x, _last.x, 0) - coalesce(_last.x, 0) >= 30 then 'Direct ball'
            when size(_loc) > 0 and _central >= greatest(1D, size(_loc) / 2D) then 'Central access'
            when action_count <= 4 and clock_s - coalesce(get(lead_up, 0).clock_s, clock_s) <= 10 then 'Transition'
            when _last is not null and _sf = 'wide' then 'Wide overload' else 'Other' end"""
        ),
    ).drop("_last", "_sl", "_el", "_sf", "_ef", "_loc", "_central")


def visible_heat(valued: DataFrame, seqs: DataFrame) -> DataFrame:
    """Danger heat maps in one long table: shots, box shots, goals, chance origins, entries."""
    shots = valued.where("is_shot and x is not null").selectExpr(*MT, "x as hx", "y as hy", "xg as weight", "is_goal", "start_in_box")
    origin = seqs.withColumn("_o", F.expr("get(filter(reverse(lead_up), a -> a.x is not null and a.y is not null), 0)")).selectExpr(
        *MT, "coalesce(_o.x, x) as hx", "coalesce(_o.y, y) as hy", "pre_shot_xt as weight"
    ).where("hx is not null")
    entries = links.box_entry_arrows(valued).selectExpr(*MT, "end_x as hx", "end_y as hy", "positive_xt as weight")
    cols = [*MT, "layer", "hx", "hy", "weight"]
    long = (
        shots.withColumn("layer", F.lit("shots")).select(*cols)
        .union(shots.where("start_in_box").withColumn("layer", F.lit("box_shots")).select(*cols))
        .union(shots.where("is_goal").withColumn("layer", F.lit("goals")).select(*cols))
        .union(origin.withColumn("layer", F.lit("chance_origins")).select(*cols))
        .union(entries.withColumn("layer", F.lit("box_entries")).select(*cols))
    )
    return data_grid(long, [*MT, "layer"], "hx", "hy", weight="weight")
