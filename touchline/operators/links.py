"""Links between events of one match: following events, receivers, presses, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.functions import geometry
from touchline.functions.flags import with_flags
from touchline.operators import sequences
from touchline.operators.facts import SEASON
from touchline.operators.ordering import ORDER, match_window, row_blocks


def latest_locations(c: DataFrame, minute: float, also: list[str] | None = None) -> DataFrame:
    """Last touch, pass or carry of every player up to a minute. ``also``: columns that a match has one value of."""
    rank = F.struct(*ORDER)
    return (
        c.where(f"expanded_minute <= {minute} and x is not null and (is_touch or is_pass or is_carry)")
        .groupBy(*(also or []), "match_id", "team", "player")
        .agg(F.max_by(F.struct("x", "y", "expanded_minute"), rank).alias("s"))
        .select(*(also or []), "match_id", "team", "player", "s.*")
    )


# The strict key is whole nanoseconds of the clock. The other one is the clock in milliseconds with the
# event index below it, in a range of its own (ten digits and three for inferred rows, which leaves room
# for a clock of a day), so that no distance of indexes ever counts as time.
SECOND = 1_000_000_000
INDEXES = 100_000_000_000
CLOCK_KEY = f"cast(clock_s * {SECOND} as bigint)"
ORDER_KEY = f"cast(round(clock_s * 1000) as bigint) * {INDEXES} + cast(round(event_index * 1000) as bigint)"


def _reach(seconds: float, strict: bool = False) -> int:
    """How far a frame must reach, in units of its key; what lies beyond the time is tested on the row found."""
    return int(seconds * SECOND) if strict else (int(seconds * 1000) + 1) * INDEXES


def following_in_blocks(
    df: DataFrame, rules: dict[str, tuple[str, str, float]], payload: list[str], strict: bool = False, rows: int = 50_000
) -> DataFrame:
    """``following`` for logs whose matches have no size bound: no task sees more than one range of about ``rows`` rows.

    Inside a range the first later event that fits is a running minimum from its end. Beyond it, a range hands back two
    events for each rule: its first one that fits, and its first one later than the range's first key, in case the row
    that asks, and the range, begin at the same moment. A row before the last key of its range may take any of a
    later range; a row at that key only what is later still.
    """
    df = row_blocks(df.withColumn("_key", F.expr(CLOCK_KEY if strict else ORDER_KEY)), ["period", "_key", "event_index"], rows)
    item, by = F.struct("clock_s", "event_index", *payload), ["match_id", "period", "_block"]
    fits = {}
    for name, (mask, whose, _) in rules.items():
        sides = {"any": "true"} if whose == "any" else {s: f"team_side = '{s}'" for s in ("home", "away")}
        fits.update({f"{name}_{side}": F.when(F.expr(f"({mask}) and {test}"), item) for side, test in sides.items()})
    late = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*by).orderBy(F.desc("_key")).rangeBetween(*late)
    df = df.withColumns({f"_in_{n}": F.min(c).over(inside) for n, c in fits.items()}).withColumn("_low", F.min("_key").over(Window.partitionBy(*by)))
    ends = df.groupBy(*by).agg(
        F.max("_key").alias("_high"), *[F.struct(F.min_by("_key", c).alias("key"), F.min(c).alias("item")).alias(f"a_{n}") for n, c in fits.items()],
        *[F.struct(F.min_by("_key", F.when(F.col("_key") > F.col("_low"), c)).alias("key"), F.min(F.when(F.col("_key") > F.col("_low"), c)).alias("item")).alias(f"b_{n}") for n, c in fits.items()])
    asked = [F.struct(F.col("_high").alias("key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(ends.schema[f"a_{next(iter(fits))}"].dataType["item"].dataType).alias("item"))]
    told = [F.struct(F.col(f"{k}_{n}.key").alias("key"), F.lit(n).alias("name"), F.col(f"{k}_{n}.item").alias("item")) for n in fits for k in "ab"]
    line = ends.select(*by, F.explode(F.array(*asked, *told)).alias("e")).where("e.key is not null").select(*by, "e.*")
    after = Window.partitionBy("match_id", "period").orderBy(F.desc("key"))
    here = lambda n, w: F.min(F.when(F.col("name") == n, F.col("item"))).over(w)
    line = line.withColumns({f"_from_{n}": here(n, after.rangeBetween(Window.unboundedPreceding, 0)) for n in fits} | {f"_past_{n}": here(n, after.rangeBetween(*late)) for n in fits})
    carried = line.where("name is null").select(*by, F.col("key").alias("_high"), *[f"_{k}_{n}" for n in fits for k in ("from", "past")])
    df = df.join(carried, by)
    found = {n: F.coalesce(f"_in_{n}", F.when(F.col("_key") < F.col("_high"), F.col(f"_from_{n}")).otherwise(F.col(f"_past_{n}"))) for n in fits}
    home, out = F.col("team_side") == "home", {}
    for name, (_, whose, seconds) in rules.items():
        first, second = ("home", "away") if whose == "own" else ("away", "home")
        event = found[f"{name}_any"] if whose == "any" else F.when(home, found[f"{name}_{first}"]).otherwise(found[f"{name}_{second}"])
        out[name] = F.when(event["clock_s"] - F.col("clock_s") <= seconds, event)
    helpers = ["_key", "_low", "_high", "_block", *[f"_{k}_{n}" for n in fits for k in ("in", "from", "past")]]
    return df.withColumns(out).drop(*helpers)


def following(
    df: DataFrame, rules: dict[str, tuple[str, str, float]], payload: list[str], strict: bool = False, keys: list[str] | None = None
) -> DataFrame:
    """For each rule (mask, whose, seconds) the first later event of the period that fits.

    ``whose`` is "own", "other" or "any".  Adds one struct column per rule (null if none);
    with ``strict`` the event must be later in time, else later in order is enough.  A RANGE
    frame on the clock does the search, so there is no self join."""
    df = df.withColumn("_key", F.expr(CLOCK_KEY if strict else ORDER_KEY))
    out: dict[str, Column] = {}
    item = F.struct("clock_s", "event_index", *payload)
    for name, (mask, whose, seconds) in rules.items():
        w = Window.partitionBy(*(keys or ["match_id", "period"])).orderBy("_key").rangeBetween(1, _reach(seconds, strict))
        if whose == "any":
            found = F.min(F.when(F.expr(mask), item)).over(w)
        else:
            home = F.min(F.when(F.expr(f"({mask}) and team_side = 'home'"), item)).over(w)
            away = F.min(F.when(F.expr(f"({mask}) and team_side = 'away'"), item)).over(w)
            own_home = F.col("team_side") == "home"
            found = F.when(own_home, home).otherwise(away) if whose == "own" else F.when(own_home, away).otherwise(home)
        out[name] = found
    df = df.withColumns(out).drop("_key")
    return df.withColumns(
        {n: F.expr(f"if({n}.clock_s - clock_s <= {s}, {n}, null)") for n, (_, _, s) in rules.items()}
    )


def any_following(df: DataFrame, name: str, mask: str, seconds: float, whose: str = "other") -> DataFrame:
    """Whether any later event of the period within the time fits the mask."""
    w = Window.partitionBy("match_id", "period").orderBy("_key").rangeBetween(1, _reach(seconds))
    df = df.withColumn("_key", F.expr(ORDER_KEY))
    home = F.min(F.when(F.expr(f"({mask}) and team_side = 'home'"), F.col("clock_s"))).over(w)
    away = F.min(F.when(F.expr(f"({mask}) and team_side = 'away'"), F.col("clock_s"))).over(w)
    mine = F.col("team_side") == "home"
    first, second = (away, home) if whose == "other" else (home, away)
    return df.withColumn(name, F.coalesce(F.when(mine, first).otherwise(second) - F.col("clock_s") <= seconds, F.lit(False))).drop("_key")


def team_runs(df: DataFrame) -> DataFrame:
    """Number the runs of one team inside a period; a stop-at-team-change search is then a
    frame inside the run."""
    w = match_window()
    df = df.withColumn("_b", F.lag(F.struct("period", "team_key")).over(w))
    new = F.expr("cast(_b is null or _b.period <> period or _b.team_key <> team_key as int)")
    return df.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w)).drop("_b", "_new")


def run_window() -> WindowSpec:
    return Window.partitionBy("match_id", "run_id").orderBy(*ORDER)


# Rows that are not a reception of the ball.
ADMIN = "('substitution','formationchange','card','start','end','offsidegiven')"


def receivers(prepared: DataFrame) -> DataFrame:
    """Who received a pass: first other player of the same unbroken team run within the next
    8 rows and 12 s."""
    df = team_runs(prepared)
    ahead = F.collect_list(F.struct("player", "clock_s", "type_c")).over(run_window().rowsBetween(1, 8))
    df = df.withColumn("_ahead", ahead).where("(is_pass or is_cross) and end_x is not null and end_y is not null")
    found = (
        "get(filter(_ahead, n -> n.clock_s - clock_s between 0 and 12 and coalesce(n.player,'') <> ''"
        f" and lower(n.player) <> lower(player) and n.type_c not in {ADMIN}), 0)"
    )
    return df.withColumn("receiver", F.expr(f"{found}.player")).drop("_ahead").where("receiver is not null")


def pressing_links(prepared: DataFrame) -> DataFrame:
    """Every press (defensive action from x = 45 on) with what came next."""
    escape = (
        "is_success and (is_pass or is_cross or is_carry) and x is not null and end_x is not null"
        " and (final_third_entry or box_entry or end_x - x >= 12)"
    )
    df = with_flags(prepared, _escape=escape)
    payload = ["x", "y", "end_x", "end_y", "type_c", "is_pass", "is_cross", "is_carry", "is_success", "_escape",
               "is_defensive_action", "is_touch"]
    df = following(df, {"nxt": ("true", "other", 8), "own": ("true", "own", 10), "shot": ("is_shot", "own", 15)}, payload)
    df = any_following(df, "escaped", "_escape", 8)
    return df.where("is_defensive_action and x >= 45")


def pressing_effect(prepared: DataFrame) -> DataFrame:
    """Outcomes of presses per match and team; an outcome event counts once."""
    df = pressing_links(prepared)
    passed = "(nxt.is_pass or nxt.is_cross)"
    rules = {
        "forced_back": (f"{passed} and nxt.end_x <= nxt.x - 6", "nxt.event_index"),
        "forced_lateral": (f"{passed} and abs(nxt.end_x - nxt.x) < 6 and abs(nxt.end_y - nxt.y) >= 10", "nxt.event_index"),
        "forced_long": (
            f"contains(nxt.type_c,'clear') or ({passed} and nxt.end_x - nxt.x >= 35 and nxt.x < 66.67)", "nxt.event_index"),
        "forced_out": (
            f"(({passed} or nxt.is_carry) and not nxt.is_success) or nxt.type_c rlike 'out|throw|blockedpass|badtouch|balltouch'",
            "nxt.event_index"),
        "escapes": ("nxt._escape", "nxt.event_index"),
        "failed_build_ups": (
            "nxt is not null and not escaped and (own.is_defensive_action or own.is_touch or own.is_pass)", "event_index"),
        "press_to_shot": ("nxt is not null and shot is not null", "shot.event_index"),
    }
    out = df.groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("presses"),
        F.count_if(F.expr("x >= 66.67")).alias("high_presses"),
        F.count_if(F.expr("x < 66.67")).alias("middle_presses"),
        *[F.size(F.collect_set(F.when(F.expr(r), F.expr(i)))).cast("bigint").alias(k) for k, (r, i) in rules.items()],
    )
    out = out.withColumn("forced_total", F.expr("forced_back + forced_lateral + forced_long + forced_out"))
    return out.withColumns(
        {
            "forced_rate": F.expr("100D * forced_total / presses"),
            "escape_rate": F.expr("100D * escapes / presses"),
        }
    )


def season_pressing(e: DataFrame) -> DataFrame:
    """Season form: pressure rows and the next three opponent events within 15 s."""
    w = Window.partitionBy("match_id", "period").orderBy("_key").rangeBetween(1, 15 * SECOND)
    item = F.struct("clock_s", "event_index", "ex", "ey", "eex", "eey", "e_final_third", "e_box", "e_shot", "outcome_c")
    near = {
        s: F.expr("slice(array_sort(_x), 1, 3)") for s in ("home", "away")
    }
    df = e.withColumn("_key", F.expr(CLOCK_KEY))
    for s in near:
        df = df.withColumn("_x", F.collect_list(F.when(F.col("team_side") == s, item)).over(w)).withColumn(f"_{s}", near[s])
    df = df.where("e_regain or (e_defensive and ex >= 55)")
    df = df.withColumn("_n", F.expr("if(team_side = 'home', _away, _home)"))

    def total(rule: str) -> Column:
        return F.sum(F.expr(f"cast(size(filter(_n, n -> {rule})) as bigint)"))

    return df.groupBy(*SEASON, "team").agg(
        F.count(F.lit(1)).alias("pressures"),
        total("n.eex - n.ex < -8").alias("forced_back"),
        total("sqrt(power(n.eex - n.ex, 2) + power(n.eey - n.ey, 2)) > 45").alias("forced_long"),
        total("n.outcome_c rlike 'out|throw|corner'").alias("forced_out"),
        total("n.e_final_third or n.e_box").alias("escaped"),
        total("n.e_shot").alias("shots_after"),
        total("n.e_box").alias("box_after"),
    )


def regains_after_loss(prepared: DataFrame) -> DataFrame:
    """Defensive actions with a failed own pass, cross or carry in the 11 rows and 5 s before."""
    w = match_window().rowsBetween(-11, -1)
    loss = "(is_pass or is_cross or is_carry) and not is_success"
    df = prepared
    for s in ("home", "away"):
        df = df.withColumn(f"_{s}", F.max(F.when(F.expr(f"{loss} and team_side = '{s}'"), F.struct("period", "clock_s"))).over(w))
    df = df.withColumn("_loss", F.expr("if(team_side = 'home', _home, _away)"))
    df = with_flags(df, regained="is_defensive_action and clock_s - _loss.clock_s <= 5")
    return df.groupBy("match_id", "team").agg(F.count_if("regained").alias("regains_after_loss"))


def fast_attacks(e: DataFrame) -> DataFrame:
    """High regains followed within a quarter of a minute by any own danger event."""
    df = following(e, {"danger": ("e_shot or e_box or e_final_third", "own", 15)}, [], strict=True)
    return df.groupBy(*SEASON, "team").agg(
        F.count_if("e_regain").alias("high_regains"), F.count_if(F.expr("e_regain and danger is not null")).alias("fast_attacks")
    )


def shot_origins(valued: DataFrame) -> DataFrame:
    """Nearest own pass, cross, carry or take-on with a location in the 10 rows and 15 s
    before a shot, inside the same team run."""
    df = team_runs(valued)
    ball = "(is_pass or is_cross or is_carry or is_take_on) and ((x is not null and y is not null) or (end_x is not null and end_y is not null))"
    item = F.struct("event_index", "clock_s", "x", "y", "end_x", "end_y", "player", "type")
    df = df.withColumn("origin", F.last(F.when(F.expr(ball), item), True).over(run_window().rowsBetween(-10, -1)))
    return df.where("is_shot").withColumn("origin", F.expr("if(clock_s - origin.clock_s <= 15, origin, null)"))


PROGRESSION = "(is_pass or is_cross or is_carry) and is_success and x is not null and y is not null and end_x is not null and end_y is not null"


def chain_window() -> WindowSpec:
    return Window.partitionBy("match_id", "team_key", "attack_chain_id").orderBy(*ORDER)


def box_entry_arrows(valued: DataFrame) -> DataFrame:
    """Box entries linked to the first shot of their chain within 10 s, with the positive
    value gained from the entry to that shot."""
    df = sequences.attack_chains(valued, per_team=True)
    w = chain_window()
    df = df.withColumn("_cum", F.sum("positive_xt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shot = F.when(F.col("is_shot"), F.struct("clock_s", "event_index", "_cum"))
    df = df.withColumn("_shot", F.min(shot).over(w.rowsBetween(0, Window.unboundedFollowing)))
    df = df.where(f"box_entry and {PROGRESSION}")
    df = with_flags(df, led_to_shot="_shot.clock_s - clock_s between 0 and 10")
    return df.withColumn("xt_to_shot", F.expr("if(led_to_shot, _shot._cum - _cum + positive_xt, 0D)")).drop("_cum", "_shot")


def progression_links(prepared: DataFrame) -> DataFrame:
    """Progressive actions, and whether a later shot of the chain is at most 10 s or 5
    actions away."""
    df = sequences.attack_chains(prepared, per_team=True)
    w = chain_window()
    df = df.withColumn("_pos", F.row_number().over(w))
    shot = F.when(F.col("is_shot"), F.struct("_pos", "clock_s"))
    df = df.withColumn("_shot", F.min(shot).over(w.rowsBetween(1, Window.unboundedFollowing))).where(PROGRESSION)
    df = df.withColumn("lane", geometry.lane5("end_y")).withColumn("lane_family", geometry.lane_family("lane"))
    df = with_flags(
        df,
        central="lane_family in ('central','half_space')",
        led_to_shot="_shot.clock_s - clock_s <= 10 or _shot._pos - _pos <= 5",
    )
    return df.where("final_third_entry or box_entry or central or end_x - x >= 10").drop("_pos", "_shot")


def _danger(x: str, y: str) -> str:
    return f"(({x} >= 83 and {y} between 21.1 and 78.9) or ({x} >= 78 and {y} between 24 and 76))"


def final_third_passes(prepared: DataFrame) -> DataFrame:
    """Passes in or into the final third, classed by what the next 8 rows (20 s) of the same
    team run led to."""
    ex, ey = "coalesce(end_x, x)", "coalesce(end_y, y)"
    df = with_flags(
        team_runs(prepared),
        _danger=f"{_danger('x', 'y')} or {_danger(ex, ey)}",
        _back="(is_pass or is_cross) and end_x <= x - 5",
        _box=f"x is not null and y is not null and not start_in_box and {ex} >= 83 and {ey} between 21.1 and 78.9",
    )
    ahead = F.collect_list(F.struct("clock_s", "is_goal", "is_shot", "is_carry", "is_take_on", "_danger", "_back")).over(
        run_window().rowsBetween(1, 8)
    )
    df = df.withColumn("_ahead", ahead).where("(is_pass or is_cross) and x is not null and y is not null and (x >= 66.67 or end_x >= 66.67)")
    df = df.withColumn("_ahead", F.expr("filter(_ahead, n -> n.clock_s - clock_s between 0 and 20)"))
    df = with_flags(
        df,
        led_to_goal="exists(_ahead, n -> n.is_goal)",
        led_to_shot="exists(_ahead, n -> n.is_shot)",
        led_to_carry="exists(_ahead, n -> n.is_carry and n._danger)",
        led_to_take_on="exists(_ahead, n -> n.is_take_on and n._danger)",
        recycled="_back or exists(_ahead, n -> n._back)",
    )
    return df.withColumn(
        "outcome_class",
        F.expr(
            "case when led_to_goal then 'goal_chain' when led_to_shot then 'shot_chain' when led_to_carry then 'carry_into_danger'"
            " when led_to_take_on then 'take_on_in_danger' when _box then 'box_entry' when recycled then 'backward_recycle'"
            " when not is_success then 'incomplete' else 'completed' end"
        ),
    )


def season_final_third_passes(e: DataFrame) -> DataFrame:
    """Season form: eight overlapping classes, counted per team."""
    df = sequences.season_chains(e)
    w = Window.partitionBy("match_id", "chain_id").orderBy(*ORDER).rowsBetween(1, 8)
    later = {
        "_shot": "e_shot", "_goal": "e_goal", "_box": "e_box", "_danger": "e_box or e_shot or e_goal",
    }
    df = df.withColumns({k: F.max(F.when(F.expr(r), 1).otherwise(0)).over(w) for k, r in later.items()})
    df = df.where("e_pass and (ex >= 80 or eex >= 80)")
    return df.groupBy(*SEASON, "team").agg(
        F.count(F.lit(1)).alias("all_passes"),
        F.count_if(F.expr("not e_set_piece")).alias("open_play"),
        F.count_if(F.expr("_danger = 1")).alias("danger"),
        F.count_if(F.expr("_box = 1")).alias("box_entry"),
        F.count_if(F.expr("_shot = 1")).alias("shot_chain"),
        F.count_if(F.expr("_goal = 1")).alias("goal_chain"),
        F.count_if(F.expr("eex < ex")).alias("backwards"),
        F.count_if(F.expr("not e_success")).alias("incomplete"),
    )


def transition_links(prepared: DataFrame, in_blocks: bool = False) -> DataFrame:
    """Regains and losses with the first shot or box entry of either side within 15 s."""
    rules = {
        "own_shot": ("is_shot", "own", 15), "own_box": ("box_entry", "own", 15),
        "own_pass": ("is_pass or is_cross", "own", 15),
        "other_shot": ("is_shot", "other", 15), "other_box": ("box_entry", "other", 15),
    }
    find = following_in_blocks if in_blocks else following
    df = find(prepared, rules, ["player", "type"], strict=True)
    return with_flags(
        df,
        is_loss="(is_pass or is_cross or is_carry or is_take_on) and not is_success",
        _regain_danger="is_defensive_action and (own_shot is not null or own_box is not null)",
    )


def transition_outcomes(prepared: DataFrame, in_blocks: bool = False) -> DataFrame:
    df = transition_links(prepared, in_blocks)
    n = lambda r: F.count_if(F.expr(r))
    return df.groupBy("match_id", "team").agg(
        n("is_defensive_action").alias("regains"),
        n("is_defensive_action and x >= 60").alias("high_regains"),
        n("is_defensive_action and own_shot is not null").alias("regains_to_shot"),
        n("is_defensive_action and own_box is not null").alias("regains_to_box"),
        n("is_defensive_action and (own_shot is not null or own_box is not null)").alias("counter_attacks"),
        n("is_defensive_action and own_pass is not null").alias("first_passes"),
        n("is_loss").alias("losses"),
        n("is_loss and other_shot is not null").alias("losses_to_shot"),
        n("is_loss and other_box is not null").alias("losses_to_box"),
        n("is_loss and (other_shot is not null or other_box is not null)").alias("counter_attacks_against"),
    )


def transition_players(prepared: DataFrame) -> DataFrame:
    df = with_flags(prepared, is_loss="(is_pass or is_cross or is_carry or is_take_on) and not is_success")
    return (
        df.groupBy("match_id", "team", "player")
        .agg(
            F.count_if("is_defensive_action").alias("regains"),
            F.count_if(F.expr("is_defensive_action and x >= 60")).alias("high_regains"),
            F.count_if("is_loss").alias("losses"),
        )
        .where("regains > 0 or losses > 0")
        .withColumn("transition_score", F.expr("regains + 0.75D * high_regains - 0.35D * losses"))
    )


def control_cells(locations: DataFrame, cells_x: int = 24, cells_y: int = 16) -> DataFrame:
    """Raster of the pitch; the nearest player owns a cell, the first by name of equally near ones.

    The players of a match are brought together before its cells are made, and a cell's owner is the least of plain
    numbers (distance in billionths, then the player's place by name): no exchange or sort sees the distances."""
    who = locations.select("match_id", "team", "player", "x", "y").withColumn(
        "_no", F.row_number().over(Window.partitionBy("match_id").orderBy("player")).cast("bigint"))
    df = who.select("match_id", "_no", "x", "y", F.explode(F.expr(f"sequence(0, {cells_x * cells_y - 1})")).alias("cell"))
    df = df.withColumns(
        {
            "cell_x": F.expr(f"(cell % {cells_x} + 0.5D) * 120 / {cells_x}"),
            "cell_y": F.expr(f"(cast(floor(cell / {cells_x}) as int) + 0.5D) * 80 / {cells_y}"),
        }
    ).withColumn("distance", F.expr("sqrt(power(x * 1.2D - cell_x, 2) + power(y * 0.8D - cell_y, 2))"))
    # The rank is below 2^20 and a distance on the pitch below 2^38 billionths, so both fit into one number.
    key = F.expr("coalesce(cast(round(round(distance, 9) * 1000000000D) as bigint), -1L) * 1048576L + _no")
    cells = df.groupBy("match_id", "cell").agg(F.min(key).alias("_key"), F.min("distance").alias("distance"))
    cells = cells.withColumn("_no", F.expr("pmod(_key, 1048576L)"))
    names = who.select(F.col("match_id").alias("_match"), F.col("_no").alias("_own"), "player", "team")
    own = F.col("match_id").eqNullSafe(F.col("_match")) & (F.col("_no") == F.col("_own"))
    return cells.join(names, own).select("match_id", "cell", "player", "team", "distance")
