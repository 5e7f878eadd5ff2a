"""The match log: the canonical event table projected from a raw ``events`` table.

A raw event row carries an id, a user, a kind, a value and a small JSON document.  The
projection below turns it into one on-ball event.  Everything is integer arithmetic on
the row itself, so the log needs no shuffle and grows with the table:

* ``match_id`` is ``event_id div 200 + 1``; event ids are unique, so a match can never
  hold more than 200 rows however large the table is.  That bound is what makes windows
  partitioned by match safe (see ``ordering.py`` for logs without such a bound).
* thirty matches form one season of six clubs, eight seasons one league; leagues, clubs
  and players therefore grow in number with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCH_ROWS = 200
SEASON_MATCHES = 30
LEAGUE_MATCHES = 240
CLUBS = 6

_SHOTS = "('Goal','SavedShot','MissedShots','BlockedShot','ShotOnPost')"


def _club(number: str, league: str) -> str:
    return f"concat('Club ', substr('ABCDEF', cast({number} as int) + 1, 1), ' ', {league})"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def season_columns(df: DataFrame) -> DataFrame:
    """Fixture columns of a frame that has the 0-based match number ``m``."""
    return (
        df.selectExpr(
            "*",
            *([] if "match_id" in df.columns else ["m + 1 as match_id"]),
            "m div 240 as league_no",
            "(m div 30) % 8 as season_no",
            "m % 30 as match_round",
        )
        .selectExpr(
            "*",
            "match_round % 6 as home_no",
            "(match_round + 1 + match_round div 6) % 6 as away_no",
            "concat('N', league_no div 2) as nation",
            "concat('T', league_no % 2 + 1) as tier",
            "concat(2016 + season_no, '-', 2017 + season_no) as season",
        )
        .selectExpr(
            "*",
            f"{_club('home_no', 'league_no')} as home_team",
            f"{_club('away_no', 'league_no')} as away_team",
            "league_no * 6 + home_no as home_id",
            "league_no * 6 + away_no as away_id",
            "timestamp_seconds(unix_date(make_date(cast(2016 + season_no as int), 8, 1)) * 86400L"
            " + match_round * 604800L + 54000L) as kickoff",
        )
    )


def match_log(events: DataFrame, keep: list[str] | None = None, parts: int = 0) -> DataFrame:
    """Raw events -> canonical event rows (a projection only); ``keep`` names raw columns to
    carry along.

    With ``parts``, the rows of a match are brought together in one of so many partitions first: windows over a
    match then need no exchange of their own, and what is sent is the raw row instead of the wide one."""
    keep = keep or []
    raw = events.selectExpr(
        "event_id as e",
        "user_id as u",
        "event_type as kind",
        "value as v",
        "try_cast(get_json_object(props, '$.k') as bigint) as k",
        *keep,
    )
    if parts:
        raw = raw.selectExpr("*", "e div 200 + 1 as match_id").repartition(parts, "match_id")
    base = raw.selectExpr(
        "*",
        "e div 200 as m",
        "e % 200 as p",
        "(e * 7 + k) % 100 as q",
        "(e * 11 + k * 3) % 100 as q2",
    )
    timed = season_columns(base).selectExpr(
        "*",
        "(p div 8) * 216 + (p % 8) * 8 + k % 8 as clock",
        "case when (p div 8 + m) % 2 = 0 then u % 4 <> 0 else u % 4 = 0 end as at_home",
        "case when u % 3 = 0 then (p div 8 + m) % 14 else u % 14 end + 1 as shirt",
        """case kind
             when 'view' then 'Pass'
             when 'click' then case when k % 4 = 0 then 'TakeOn'
                                    when k % 4 = 1 and k % 3 = 0 then 'Carry' else 'Pass' end
             when 'purchase' then case when k % 2 = 1 then 'Pass'
                                       when v >= 100 then 'Goal'
                                       when k % 10 = 8 then 'ShotOnPost'
                                       when k % 3 = 0 then 'SavedShot'
                                       when k % 3 = 1 then 'MissedShots' else 'BlockedShot' end
             when 'error' then element_at(array('Tackle','Tackle','Interception','Clearance','Foul',
                                                'Card','Aerial','Challenge','Dispossessed','BlockedPass'),
                                          cast(k % 10 as int) + 1)
             else element_at(array('BallRecovery','BallRecovery','BallRecovery','BallTouch','BallTouch',
                                   'BallTouch','CornerAwarded','SubstitutionOff','SubstitutionOn','KeeperPickup'),
                             cast(k % 10 as int) + 1)
           end as type""",
    )
    tagged = timed.selectExpr(
        "*",
        f"""case when q < 4 and type = 'Pass' then 'CornerTaken'
                 when q < 8 and type = 'Pass' then 'FreekickTaken'
                 when q < 12 and type = 'Pass' then 'ThrowinSetPiece'
                 when q < 20 and type = 'Pass' then 'Cross'
                 when q < 20 and type in {_SHOTS} then 'FromCorner'
                 when q < 23 and type in {_SHOTS} then 'Penalty'
                 when q < 30 and type = 'Pass' then 'Longball'
                 when q < 34 and type in {_SHOTS} then 'Freekick'
                 when q < 40 and type = 'Goal' then 'OwnGoal'
                 when q < 44 and type = 'Card' then 'VoidYellowCard'
                 when q < 50 and type = 'Pass' then 'Throughball'
                 when q < 53 then 'FastBreak' end as tag1""",
        f"""case when q2 < 12 then 'Head'
                 when q2 < 20 and type in {_SHOTS} then 'BigChance'
                 when q2 < 26 then 'FirstTime'
                 when q2 < 30 and type in {_SHOTS} then 'Rebound'
                 when q2 < 34 and type in {_SHOTS} then 'High'
                 when q2 < 38 and type in {_SHOTS} then 'LowLeft'
                 when q2 < 42 and type = 'Pass' then 'Cutback'
                 when q2 < 46 and type = 'Pass' then 'Corner' end as tag2""",
        "case when at_home then home_team else away_team end as team",
        "case when at_home then away_team else home_team end as opponent",
        "concat('club', substr('abcdef', cast(if(at_home, home_no, away_no) as int) + 1, 1), league_no) as team_key",
        "case when at_home then home_id else away_id end as team_id",
        "type in ('Pass','Carry','Goal','SavedShot','MissedShots','BlockedShot','ShotOnPost') as has_end",
        f"type in {_SHOTS} as is_shot",
        "(e * 37 + k * 11) % 1000 as xi",
        "(e * 91 + 13 + k * 29) % 1000 as yi",
        "(e * 53 + k * 7) % 1000 as exi",
        "(e * 71 + k * 3) % 1000 as eyi",
    )
    return tagged.selectExpr(
        "e as event_id",
        "season", "nation", "tier", "match_id",
        "cast(p as double) as event_index",
        "cast(case when clock < 2700 then 1 else 2 end as int) as period",
        "cast(clock div 60 as int) as minute",
        "cast(clock % 60 as int) as second",
        "clock / cast(60 as double) as expanded_minute",
        "cast(clock as double) as clock_s",
        "team",
        "team_key",
        "team_id",
        "case when at_home then 'home' else 'away' end as team_side",
        "opponent",
        "concat('P', team_id, '.', shirt) as player",
        "team_id * 100 + shirt as player_id",
        "cast(shirt as int) as shirt_no",
        "element_at(array('GK','DR','DL','DC','DC','DMC','MR','MC','FW','AMC','AML','Sub','Sub','Sub'),"
        " cast(shirt as int)) as position",
        "shirt <= 11 as is_starter",
        "type",
        "lower(type) as type_c",
        "case when (e + k) % 4 <> 0 then 'Successful' else 'Unsuccessful' end as outcome",
        "case when (e + k) % 4 <> 0 then 'successful' else 'unsuccessful' end as outcome_c",
        "case when type = 'Card' then case when (k div 10) % 5 = 3 then 'SecondYellow'"
        " when (k div 10) % 5 = 4 then 'Red' else 'Yellow' end end as card_type",
        "array_compact(array(tag1, tag2)) as qual_tags",
        "lower(concat(coalesce(tag1, ''), coalesce(tag2, ''))) as qual_c",
        "case when e % 97 <> 0 then xi / cast(10 as double) end as x",
        "case when e % 97 <> 0 then yi / cast(10 as double) end as y",
        "case when has_end then exi / cast(10 as double) end as end_x",
        "case when has_end then eyi / cast(10 as double) end as end_y",
        "case when is_shot and k % 7 <> 0 then 40 + (e * 13) % 200 / cast(10 as double) end as goal_mouth_y",
        "case when is_shot and k % 6 <> 0 then (e * 17) % 600 / cast(10 as double) end as goal_mouth_z",
        "case when type = 'BlockedShot' then (e * 19) % 1000 / cast(10 as double) end as blocked_y",
        "case when is_shot and k % 5 = 0 then k % 40 / cast(100 as double) end as provider_xg",
        "type not in ('Card','Foul','CornerAwarded','SubstitutionOff','SubstitutionOn') as is_touch",
        "is_shot",
        "type = 'Goal' as is_goal",
        "home_team", "away_team", "home_id", "away_id", "kickoff",
        *keep,
    )


def schedule(events: DataFrame) -> DataFrame:
    """One row per match, from its first event, whichever that is (one partial aggregation)."""
    own = events.selectExpr("event_id div 200 as m", "event_id", "try_cast(get_json_object(props, '$.k') as bigint) as k")
    heads = own.groupBy("m").agg(F.min_by("k", "event_id").alias("k"))
    return season_columns(heads).selectExpr(
        "nation", "tier", "season", "match_id", "match_round",
        "home_team", "away_team", "home_id", "away_id", "kickoff",
        "regexp_replace(lower(home_team), '[^a-z0-9]+', '') as home_key",
        "regexp_replace(lower(away_team), '[^a-z0-9]+', '') as away_key",
        "case when k % 10 = 0 then null when k % 10 = 1 then '1' else '6' end as status",
        "case when k % 10 = 0 then 'FT' when k % 20 = 1 then 'HT' end as elapsed",
        "cast(k % 4 as int) as home_score",
        "cast(k % 3 as int) as away_score",
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_log(read_events(spark, sf_dir))
