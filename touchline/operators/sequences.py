"""Order-dependent event operators: ids, possessions, chains, inferred rows, score state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.flags import with_flags
from touchline.operators.ordering import ORDER, match_window, numbered_in_blocks, row_blocks, running_in_blocks

# Event kinds that interrupt play, and kinds a carry starts from or ends in.
INTERRUPT = "substitution|formation|card|start|end|offsidegiven|foul"
STOPPAGE = "start|end|substitution|formation|card|foul|offside|period"
CARRY_START = "('ballrecovery','balltouch','goodskill','shieldballopp','takeon','dribble')"
CARRY_END = (
    "('pass','cross','offsidepass','takeon','dribble','savedshot','attemptsaved','missedshots','shotonpost',"
    "'blockedshot','goal','dispossessed','balltouch','blockedpass','goodskill')"
)


def event_index(log: DataFrame) -> DataFrame:
    df = log.withColumn("row_index", F.row_number().over(match_window()) - 1)
    return df.withColumn("event_uid", F.concat_ws("::", "match_id", "row_index", "team_key"))


def event_index_in_blocks(log: DataFrame, rows: int = 50_000) -> DataFrame:
    """The same index for logs whose matches have no size bound."""
    df = numbered_in_blocks(log, ["match_id"], {}, "true", "_pos", rows)
    df = df.withColumn("row_index", F.expr("cast(_pos - 1 as int)")).drop("_pos")
    return df.withColumn("event_uid", F.concat_ws("::", "match_id", "row_index", "team_key"))


def add_take_on_ends(c: DataFrame) -> DataFrame:
    """End point of a take-on: where the same player is next seen, within 8 rows and 10 s of
    an unbroken run of the same team, 1 to 60 units away."""
    ahead = match_window().rowsBetween(1, 8)
    df = with_flags(c, interrupt=f"type_c rlike '{INTERRUPT}' or outcome_c like '%offside%'")
    df = df.withColumn(
        "_next", F.collect_list(F.struct("period", "clock_s", "team_key", "player", "x", "y", "interrupt")).over(ahead)
    )
    stop = "n -> n.period <> period or n.clock_s - clock_s > 10 or n.interrupt or n.team_key <> team_key"
    usable = (
        "n -> n.clock_s >= clock_s and lower(n.player) = lower(player) and n.x is not null and n.y is not null"
        " and hypot(n.x - x, n.y - y) between 1 and 60"
    )
    open_end = "(end_x is null or end_y is null or hypot(end_x - x, end_y - y) < 1)"
    df = with_flags(df, _open=f"is_take_on and x is not null and y is not null and {open_end}")
    df = df.withColumn("_stop", F.expr(f"case when _open then array_position(transform(_next, {stop}), true) end"))
    df = df.withColumn(
        "_end",
        F.expr(
            f"case when _open then"
            f" get(filter(if(_stop = 0, _next, slice(_next, 1, cast(_stop - 1 as int))), {usable}), 0) end"
        ),
    )
    return df.withColumns(
        {
            "end_x": F.expr("coalesce(_end.x, end_x)"),
            "end_y": F.expr("coalesce(_end.y, end_y)"),
            "take_on_end_inferred": F.expr("_end is not null"),
            "take_on_seconds": F.expr("coalesce(_end.clock_s - clock_s, 0D)"),
        }
    ).drop("_next", "_open", "_stop", "_end", "interrupt")


def infer_carries(c: DataFrame) -> DataFrame:
    """A player who has the ball and acts next, 3 to 60 units and at most 10 s away, carried
    it there: one extra row right after the first (index + .001), from a single pass."""
    w = match_window()
    df = with_flags(
        c,
        _start=f"type_c in {CARRY_START}",
        _stop=f"type_c in {CARRY_END} or is_pass or is_cross or is_shot or is_take_on",
        _bad=f"type_c rlike '{INTERRUPT}' or outcome_c rlike 'unsuccessful|lost|offside'",
    )
    names = ["period", "clock_s", "team_key", "player", "x", "y", "_stop", "_bad", "event_index", "type"]
    df = df.withColumn("_n", F.lead(F.struct(*names)).over(w))
    df = with_flags(
        df,
        _carry="_start and _n._stop and not _bad and not _n._bad and _n.period = period and _n.team_key = team_key"
        " and lower(_n.player) = lower(player) and _n.clock_s - clock_s between 0 and 10"
        " and hypot(_n.x - x, _n.y - y) between 3 and 60",
    )
    df = df.withColumn("_copy", F.explode(F.expr("if(_carry, array(false, true), array(false))")))
    changed = {
        "event_index": "event_index + 0.001D",
        "type": "'InferredCarry'",
        "type_c": "'inferredcarry'",
        "outcome": "'Successful'",
        "outcome_c": "'successful'",
        "end_x": "_n.x",
        "end_y": "_n.y",
        "is_carry": "true",
        "is_inferred_carry": "true",
        "is_take_on": "false",
        "is_pass": "false",
        "is_cross": "false",
        "is_shot": "false",
        "is_goal": "false",
        "is_success": "true",
        "is_touch": "false",
        "attacking_third_touch": "false",
        "is_chain_action": "true",
        "end_in_box": "coalesce(_n.x >= 83 and _n.y between 21.1 and 78.9, false)",
        "final_third_entry": "x < 66.67 and _n.x >= 66.67",
        "box_entry": "not start_in_box and coalesce(_n.x >= 83 and _n.y between 21.1 and 78.9, false)",
    }
    new = {
        "carry_distance": F.expr("if(_copy, hypot(_n.x - x, _n.y - y), null)"),
        "carry_seconds": F.expr("if(_copy, _n.clock_s - clock_s, null)"),
        "carry_end_type": F.expr("if(_copy, _n.type, null)"),
    }
    df = df.withColumns(new)
    df = df.withColumns({n: F.expr(f"if(_copy, {r}, {n})") for n, r in changed.items()})
    return df.drop("_start", "_stop", "_bad", "_n", "_carry", "_copy")


def prepare(c: DataFrame) -> DataFrame:
    """Flag set c plus take-on ends plus inferred carries: the table match sections read."""
    return infer_carries(add_take_on_ends(c))


def possessions(f: DataFrame) -> DataFrame:
    """Runs of one team inside a period, numbered per match, with values of the row before
    inside the same run."""
    w = match_window()
    df = f.withColumn("_before", F.lag(F.struct("period", "team")).over(w))
    df = with_flags(df, _new="_before is null or _before.period <> period or _before.team <> team")
    df = df.withColumn("possession_id", F.sum(F.col("_new").cast("int")).over(w))
    run = Window.partitionBy("match_id", "possession_id").orderBy("period", "expanded_minute", "event_index")
    flags = ["f_pass", "f_carry", "f_cross", "f_through", "f_cutback"]
    df = df.withColumns(
        {
            "possession_action": F.row_number().over(run),
            "prev_minute": F.lag("expanded_minute").over(run),
            "prev_player": F.lag("player").over(run),
            **{f"prev_{n[2:]}": F.coalesce(F.lag(n).over(run), F.lit(False)) for n in flags},
        }
    )
    return df.drop("_before", "_new")


def possessions_in_blocks(f: DataFrame, rows: int = 50_000) -> DataFrame:
    """Possession numbers without a whole match in one task."""
    new = "_prev_period is null or _prev_period <> period or _prev_team <> team"
    return numbered_in_blocks(f, ["match_id"], {"_prev_period": "period", "_prev_team": "team"}, new, "possession_id", rows)


def season_chains(log: DataFrame) -> DataFrame:
    """A new chain on every change of team inside a match."""
    w = match_window()
    df = log.withColumn("_before", F.lag("team_key").over(w))
    df = df.withColumn("_new", F.expr("cast(_before is null or _before <> team_key as int)"))
    return df.withColumn("chain_id", F.sum("_new").over(w)).drop("_before", "_new")


def season_chains_in_blocks(log: DataFrame, rows: int = 50_000) -> DataFrame:
    new = "_prev_team is null or _prev_team <> team_key"
    return numbered_in_blocks(log, ["match_id"], {"_prev_team": "team_key"}, new, "chain_id", rows)


def attack_chains(c: DataFrame, gap: float = 15.0, per_team: bool = False) -> DataFrame:
    """Break on period or team change, on a longer gap, and at a stoppage on either side.

    ``per_team`` numbers the rows of each team on their own (the view of one opponent)."""
    w = match_window("team_key") if per_team else match_window()
    df = with_flags(c, _halt=f"concat(type_c, outcome_c) rlike '{STOPPAGE}'")
    df = df.withColumn("_b", F.lag(F.struct("period", "team_key", "clock_s", "_halt")).over(w))
    df = with_flags(
        df,
        _new=f"_b is null or _b.period <> period or _b.team_key <> team_key or clock_s - _b.clock_s > {gap}"
        " or _halt or _b._halt",
    )
    return df.withColumn("attack_chain_id", F.sum(F.col("_new").cast("int")).over(w)).drop("_b", "_new", "_halt")


def attack_chains_in_blocks(c: DataFrame, gap: float = 15.0, per_team: bool = False, rows: int = 50_000) -> DataFrame:
    df = with_flags(c, _halt=f"concat(type_c, outcome_c) rlike '{STOPPAGE}'")
    before = {"_prev_period": "period", "_prev_team": "team_key", "_prev_clock": "clock_s", "_prev_halt": "_halt"}
    new = f"_prev_period is null or _prev_period <> period or _prev_team <> team_key or clock_s - _prev_clock > {gap} or _halt or _prev_halt"
    return numbered_in_blocks(df, ["match_id", "team_key"] if per_team else ["match_id"], before, new, "attack_chain_id", rows).drop("_halt")


def team_action_chains(prepared: DataFrame, gap: float = 10.0) -> DataFrame:
    """Ball actions of one team; a new chain after a longer gap or at a new period."""
    df = prepared.where("(is_chain_action or box_entry or final_third_entry) and x is not null")
    w = match_window("team_key")
    df = df.withColumn("_b", F.lag(F.struct("period", "clock_s")).over(w))
    df = with_flags(df, _new=f"_b is null or _b.period <> period or clock_s - _b.clock_s not between 0 and {gap}")
    return df.withColumn("chain_id", F.sum(F.col("_new").cast("int")).over(w)).drop("_b", "_new")


def team_action_chains_in_blocks(prepared: DataFrame, gap: float = 10.0, rows: int = 50_000) -> DataFrame:
    df = prepared.where("(is_chain_action or box_entry or final_third_entry) and x is not null")
    new = f"_prev_period is null or _prev_period <> period or clock_s - _prev_clock not between 0 and {gap}"
    return numbered_in_blocks(df, ["match_id", "team_key"], {"_prev_period": "period", "_prev_clock": "clock_s"}, new, "chain_id", rows)


def score_state(c: DataFrame) -> DataFrame:
    """Home and away goals before and after each event."""
    w = match_window()
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    out = c
    for side in ("home", "away"):
        goal = F.expr(f"cast(is_goal and team_side = '{side}' as int)")
        out = out.withColumns(
            {
                f"{side}_before": F.coalesce(F.sum(goal).over(before), F.lit(0)),
                f"{side}_after": F.sum(goal).over(upto),
            }
        )
    return out


def score_state_in_blocks(c: DataFrame, rows: int = 50_000) -> DataFrame:
    goals = {s: F.expr(f"cast(is_goal and team_side = '{s}' as int)") for s in ("home", "away")}
    out = running_in_blocks(row_blocks(c, rows=rows), ["match_id"], ORDER, {f"{s}_after": g for s, g in goals.items()}).drop("_block")
    return out.withColumns({f"{s}_before": F.col(f"{s}_after") - g for s, g in goals.items()})
