"""Ingest projections: end points, scales, clocks, context columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def end_point_from_qualifiers(df: DataFrame) -> DataFrame:
    """Fill a missing end point from the PassEndX / PassEndY qualifiers."""
    return df.withColumns(
        {
            "end_x": F.expr("coalesce(end_x, try_cast(qual_map['PassEndX'] as double))"),
            "end_y": F.expr("coalesce(end_y, try_cast(qual_map['PassEndY'] as double))"),
        }
    )


def rescale_unit_coordinates(df: DataFrame, columns: list[str], scope: list[str]) -> DataFrame:
    """Columns whose maximum in the scope is at most 1.5 are fractions: times 100.

    The maxima are one small row per scope, aggregated before the join; Spark broadcasts
    them only when their measured size allows it.
    """
    top = df.groupBy(*scope).agg(*[F.max(c).alias(f"_max_{c}") for c in columns])
    out = df.join(top, scope, "left")
    out = out.withColumns({c: F.expr(f"if(_max_{c} <= 1.5, {c} * 100, {c})") for c in columns})
    return out.drop(*[f"_max_{c}" for c in columns])


def to_percent(df: DataFrame, column: str, scale: float, target: str) -> DataFrame:
    """Any of 0-1, 0-100 or scaled pitch units to 0-100, clipped."""
    top = df.agg(F.max(column).alias("_max"))
    factor = top.select(
        F.expr(f"case when _max <= 1.5 then 100D when _max > 105 then 1 / {scale}D else 1D end").alias("_f")
    )
    # one global row, read back as a scalar subquery
    df = df.sparkSession.sql(
        f"select *, if({column} is null, null, least(greatest({column} * (select _f from {{factor}}), 0D), 100D)) as {target} from {{df}}",
        factor=factor,
        df=df,
    )
    return df


def expanded_minute(df: DataFrame) -> DataFrame:
    """Applied once: the base minute plus the seconds."""
    return df.withColumn(
        "expanded_minute", F.expr("coalesce(expanded_minute, cast(minute as double)) + coalesce(second, 0) / 60D")
    )


def flip(df: DataFrame, columns: list[str], upper: float = 100.0) -> DataFrame:
    return df.withColumns({c: F.lit(upper) - F.col(c) for c in columns})


def attach_match_context(events: DataFrame, match_index: DataFrame) -> DataFrame:
    """Left join on match id; opponent and side follow from the team key."""
    index = match_index.select("match_id", "home_team", "away_team", "home_key", "away_key", "kickoff", "home_score", "away_score")
    out = events.join(index, "match_id", "left")
    return out.withColumns(
        {
            "opponent": F.expr("if(team_key = home_key, away_team, home_team)"),
            "team_side": F.expr("case when team_key = home_key then 'home' when team_key = away_key then 'away' else '' end"),
        }
    )


def side_from_names(df: DataFrame) -> DataFrame:
    """Existing side kept; then equal or either-way prefix of the keys; then the team id."""
    def hit(side: str) -> str:
        return f"(source_key = {side}_key or startswith(source_key, {side}_key) or startswith({side}_key, source_key))"

    return df.withColumn(
        "side",
        F.expr(
            f"case when side in ('home','away') then side when source_key <> '' and {hit('home')} then 'home'"
            f" when source_key <> '' and {hit('away')} then 'away' when team_id = home_id then 'home'"
            f" when team_id = away_id then 'away' else '' end"
        ),
    )


def one_direction(df: DataFrame) -> DataFrame:
    """Per match, team and period: if the median terminal x is below 50 flip all coordinates."""
    w = Window.partitionBy("match_id", "team", "period")
    df = df.withColumn("direction_x", F.percentile(F.coalesce("end_x", "x"), 0.5).over(w))
    df = df.withColumn("flipped", F.coalesce(F.col("direction_x") < 50, F.lit(False)))
    return df.withColumns(
        {f"one_{c}": F.expr(f"if(flipped, 100 - {c}, {c})") for c in ("x", "y", "end_x", "end_y")}
    )


# Action, result and body-part ids of the action-row format.
ACTIONS = [
    "pass", "cross", "throw_in", "freekick_crossed", "freekick_short", "corner_crossed", "corner_short", "take_on", "foul", "tackle",
    "interception", "shot", "shot_penalty", "shot_freekick", "keeper_save", "keeper_claim", "keeper_punch", "clearance", "bad_touch", "dribble",
]
RESULTS = ["fail", "success", "offside"]
BODY_PARTS = ["foot", "head", "other"]


def action_rows(log: DataFrame) -> DataFrame:
    """Flat action table on a 105 x 68 pitch."""
    df = log.withColumn("_t", F.expr("transform(qual_tags, t -> lower(t))"))
    has = lambda t: f"array_contains(_t,'{t}')"
    df = df.withColumns(
        {
            "type_name": F.expr(
                f"""case when {has('corner')} and {has('cross')} then 'corner_crossed' when {has('corner')} then 'corner_short'
                when {has('freekick')} and {has('cross')} then 'freekick_crossed' when {has('freekick')} then 'freekick_short'
                when {has('throwin')} then 'throw_in' when {has('cross')} or type_c = 'cross' then 'cross' when type_c = 'takeon' then 'take_on'
                when type_c in ('dribble','carry','run') then 'dribble'
                when type_c like '%shot%' or is_shot then if({has('penalty')}, 'shot_penalty', 'shot')
                when type_c like '%save%' then 'keeper_save' when type_c like '%claim%' then 'keeper_claim' when type_c like '%punch%' then 'keeper_punch'
                when type_c like '%interception%' then 'interception' when type_c like '%clearance%' then 'clearance'
                when type_c rlike 'tackle|challenge' then 'tackle' when type_c like '%foul%' then 'foul' when type_c like '%touch%' then 'bad_touch' else 'pass' end"""
            ),
            "result_name": F.expr(
                "case when is_goal or outcome_c in ('successful','success','won','complete','completed','accurate') then 'success'"
                " when outcome_c like '%offside%' then 'offside' else 'fail' end"
            ),
            "bodypart_name": F.expr("if(arrays_overlap(_t, array('header','head','headed')), 'head', 'foot')"),
        }
    )
    number = lambda names, c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)).cast("int") - 1
    return df.select(
        "event_id", F.col("match_id").alias("game_id"), F.expr("coalesce(period, 1)").alias("period_id"), F.expr("minute * 60D + second").alias("time_seconds"),
        F.expr("coalesce(team_id, -1)").alias("team_id"), F.expr("coalesce(player_id, -1)").alias("player_id"),
        F.expr("x * 1.05D").alias("start_x"), F.expr("y * 0.68D").alias("start_y"), F.expr("end_x * 1.05D").alias("end_x"), F.expr("end_y * 0.68D").alias("end_y"),
        "type_name", number(ACTIONS, "type_name").alias("type_id"), "result_name", number(RESULTS, "result_name").alias("result_id"),
        "bodypart_name", number(BODY_PARTS, "bodypart_name").alias("bodypart_id"),
    )


def positions(df: DataFrame, column: str) -> DataFrame:
    """Primary position token and its group from provider text such as "(DMC, MC)"."""
    df = df.withColumn("token", F.regexp_extract(F.split(F.col(column), ",")[0], "([A-Z]{2,3})", 1))
    return df.withColumn(
        "position_group",
        F.expr(
            """case when token = 'GK' then 'GK' when token in ('DC','CB') then 'CB' when token in ('DR','DL','RB','LB') then 'FB'
            when token in ('DMR','DML','WB','RWB','LWB') then 'WB' when token in ('DMC','DM') then 'DM' when token in ('MC','CM') then 'CM'
            when token in ('MR','ML','RM','LM') then 'WM' when token in ('AMC','AM') then 'AM' when token in ('AML','AMR','FWR','FWL','LW','RW') then 'WF'
            when token in ('FW','ST','CF') then 'CF' else '' end"""
        ),
    )


# Short names that mean a club whatever the schedule calls it.
TEAM_ALIASES = {"bayern": "Bayern Munich", "rbl": "RB Leipzig"}


def canonical_team(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """Team id -> schedule name, else normalised name -> schedule name; unmatched rows drop."""
    from touchline.functions.text import team_key

    # One name per id and per key, that of the earliest fixture, so that no event is multiplied.
    names = schedule.withColumn("_first", F.struct("kickoff", "home_team"))
    by_id = names.groupBy(F.col("home_id").alias("team_id")).agg(F.min("_first").alias("_f")).select("team_id", F.col("_f.home_team").alias("_a"))
    by_key = names.groupBy(F.col("home_key").alias("_key")).agg(F.min("_first").alias("_f")).select("_key", F.col("_f.home_team").alias("_b"))
    alias = F.create_map(*[F.lit(x) for pair in TEAM_ALIASES.items() for x in pair])
    keyed = df.withColumn("_key", team_key(F.col("team")))
    out = keyed.join(by_id, "team_id", "left").join(by_key, "_key", "left")
    return out.withColumn("canonical", F.coalesce("_a", "_b", alias[F.col("_key")])).where("canonical is not null").drop("_a", "_b", "_key")


def finished_and_kickoff(schedule: DataFrame) -> DataFrame:
    """Finished by status or elapsed text; kickoff is the first column that parses."""
    stamps = [f"try_to_timestamp({c})" for c in ("started_at_utc", "start_time", "date")]
    return schedule.withColumns(
        {
            "finished": F.expr(
                "coalesce(status in ('6','FT','AET','PEN'), false) or coalesce(upper(elapsed) in ('FT','AET','PEN','FULL TIME'), false)"
            ),
            "kickoff": F.expr(f"coalesce({', '.join(stamps)})"),
        }
    )


def match_index(schedule: DataFrame) -> DataFrame:
    return schedule.where("match_id is not null").select(
        "match_id", "home_team", "away_team", "home_key", "away_key", F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss").alias("kickoff_text"),
        F.date_format("kickoff", "yyyy-MM-dd").alias("match_date"), F.coalesce("status", F.lit("")).alias("status"),
        F.col("home_score").cast("double").alias("home_score"), F.col("away_score").cast("double").alias("away_score"),
    )


def stage_phase(df: DataFrame, primary: int) -> DataFrame:
    words = "play-?off|final|knockout|semi|quarter|promotion|relegation"
    df = df.withColumn("is_playoff", F.coalesce(F.lower("stage_name").rlike(words), F.lit(False)))
    return df.withColumn(
        "phase", F.expr(f"case when is_playoff then 'Playoffs' when stage_id = {primary} then 'League phase' else 'Additional stage' end")
    )
