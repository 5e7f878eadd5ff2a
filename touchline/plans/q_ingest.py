"""Sources, sinks, context joins, coverage, set operations, scalar families."""

from pyspark.sql import functions as F

from touchline.functions import text
from touchline.functions.flags import flags_b
from touchline.operators import facts, normalise
from touchline.operators.topk import top_per_group
from touchline.plans.oracle_base import cte
from touchline.plans.q_facts import TMS
from touchline.plans.registry import Tables, query
from touchline.session import scratch_dir
from touchline.sources import documents, match_store, tables, versions

# ------------------------------------------------------------------ text and files
_HEADER = "event_id,kind,user,value"


@query("s01_resilient_csv", """select event_id::varchar as event_id,event_type as kind,case when event_type='signup' then '' else user_id::varchar end as "user",case when event_type='signup' then '' else (event_id%50)::varchar end as "value",case when event_type in ('signup','error') then 'repaired_field_count' else 'normal' end as read_mode from events""")
def s01(t: Tables):
    full = "concat_ws(',', event_id, event_type, user_id, event_id % 50)"
    lines = t.events.selectExpr(
        f"explode(case event_type when 'signup' then array(concat_ws(',', event_id, event_type)) when 'error' then array(concat({full}, ',extra,more'))"
        f" when 'purchase' then array('', {full}, '  ') else array({full}) end) as value"
    )
    return tables.parse_lines(lines, _HEADER)


@query("s01_csv_scan", "select event_id::varchar as event_id,event_type as kind,user_id::varchar as \"user\",(event_id%50)::varchar as \"value\",'normal' as read_mode from events")
def s01b(t: Tables):
    path = scratch_dir(t.spark, "csv")
    t.events.selectExpr("event_id", "event_type as kind", "user_id as user", "event_id % 50 as value").write.option("header", True).csv(path)
    return tables.read_csv(t.spark, path, _HEADER)


@query("s01_csv_files", """select event_id::varchar as event_id,'line'||chr(10)||'"'||event_type||'", end' as note,case when event_id%2=1 then user_id::varchar end as "user" from events""")
def s01_files(t: Tables):
    folder = scratch_dir(t.spark, "csv-files")
    e = t.events.selectExpr("event_id", "concat('line\\n\"', event_type, '\", end') as note", "user_id as user")
    options = {"header": True, "escape": '"', "quoteAll": True}
    e.where("event_id % 2 = 0").select("event_id", "note").write.options(**options).csv(f"{folder}/two columns")
    e.where("event_id % 2 = 1").select("note", "user", "event_id").write.options(**options).csv(f"{folder}/three")
    rows, _ = tables.read_csv_files(t.spark, [folder])
    return rows.select("event_id", "note", "user")


_PATHS = """select case match_id%4 when 0 then 'root0/'||nation||'/'||tier||'/'||home_key||'/'||season||'.csv' when 1 then 'root1/'||nation||'/'||tier||'/'||home_key||'/'||season||'.csv' when 2 then 'root0/'||nation||'/'||tier||'/'||season||'.csv' else 'root0/'||nation||'/_old/'||home_key||'/'||season||'.csv' end as path,(match_id%4=1)::int as root_no from sched"""


@query("s02_event_file_discovery", f"""with p as (select distinct path,root_no from ({_PATHS})), f as (select *, string_split(path,'/') as s from p where path not like '%/_old/%'),
 g as (select path,s[2] as nation,s[3] as tier,case when len(s)=4 then '__season_event_file' else s[4] end as source_team,replace(s[-1],'.csv','') as season,root_no from f) select path,nation,tier,source_team,season from (select *, row_number() over (partition by nation,tier,source_team,season order by root_no,path) as k from g) where k=1""")
def s02(t: Tables):
    files = t.schedule.selectExpr(
        "case match_id % 4 when 0 then concat_ws('/', 'root0', nation, tier, home_key, concat(season, '.csv')) when 1 then concat_ws('/', 'root1', nation, tier, home_key, concat(season, '.csv'))"
        " when 2 then concat_ws('/', 'root0', nation, tier, concat(season, '.csv')) else concat_ws('/', 'root0', nation, '_old', home_key, concat(season, '.csv')) end as path",
        "int(match_id % 4 = 1) as root_no",
    ).distinct()
    return tables.event_files(files).select("path", "nation", "tier", "source_team", "season")


@query("s03_schedule_selection", """select match_id from sched where match_id%5 not in (0,1,2)""")
def s03(t: Tables):
    df = t.schedule.selectExpr(
        "match_id", "concat('Schedule/', nation, ' ', tier, '/', case match_id % 5 when 0 then concat(season, '.backup.csv') when 1 then concat(season, '.tmp') when 2 then concat('~', season, '.csv') else concat(season, '.csv') end) as path")
    return tables.selectable(df).select("match_id")


@query("s04_season_load", "select distinct match_id,event_index,team,type,x,end_x from log")
def s04(t: Tables):
    cols = ["match_id", "period", "expanded_minute", "event_index", "team", "player", "type", "outcome", "x", "y", "end_x", "end_y"]
    home = t.log.where("team_side = 'home'").select(*cols, F.lit("home file").alias("source"))
    away = t.log.where("team_side = 'away' or is_shot").select(*cols)  # shots are in both files
    return tables.season_events([home, away]).select("match_id", "event_index", "team", "type", "x", "end_x")


@query("s05_match_load", "select match_id,event_index,team_side,type from log where match_id=3")
def s05(t: Tables):
    twice = t.log.unionByName(t.log.where("is_shot"))
    return tables.match_events(twice, 3).select("match_id", "event_index", "team_side", "type")


def _store(t: Tables) -> str:
    keep = ["season", "match_id", "event_index", "period", "team", "team_key", "type", "x", "is_pass", "is_shot", "is_goal", "box_entry"]
    return tables.processed_store(t.b.select(*keep))


@query("s06_processed_season_scan", "select match_id,event_index,team,type,is_shot,box_entry from fb where season='2016-2017'")
def s06(t: Tables):
    return t.spark.read.parquet(_store(t)).where("season = '2016-2017'").select("match_id", "event_index", "team", "type", "is_shot", "box_entry")


@query("s07_processed_match_scan", "select match_id,event_index,team,type,is_shot,box_entry from fb where match_id=4")
def s07(t: Tables):
    return tables.read_match(t.spark, _store(t), 4).select("match_id", "event_index", "team", "type", "is_shot", "box_entry")


@query("s08_processed_team_scan", "select match_id,event_index,team,type,is_shot,box_entry from fb where team_key='cluba0'")
def s08(t: Tables):
    return tables.read_team(t.spark, _store(t), "cluba0").select("match_id", "event_index", "team", "type", "is_shot", "box_entry")


@query("s09_store_build", "select season,count(*) as rows,count(distinct match_id) as matches,count(*) filter (is_shot) as shots from fb group by 1")
def s09(t: Tables):
    df = t.spark.read.parquet(_store(t))
    return df.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("match_id").alias("matches"), F.count_if("is_shot").alias("shots"))


@query("s10_typed_output", """select match_id::double as match_id,x,case when event_id%5=4 then team else '' end as team,event_id%2=0 as is_key,strftime(kickoff,'%Y-%m-%dT%H:%M:%S') as kickoff,try_cast(case when event_id%3=0 then 'n/a' else minute::varchar end as double) as minute from log""")
def s10(t: Tables):
    df = t.log.selectExpr("match_id", "x", "case event_id % 5 when 0 then ' ' when 1 then 'nan' when 2 then 'None' when 3 then null else team end as team",
                          "if(event_id % 2 = 0, 'yes', 'no') as is_key", "kickoff", "if(event_id % 3 = 0, 'n/a', string(minute)) as minute")
    return tables.typed_output(df)


@query("s11_event_upsert", "select match_id,event_index,case when w then 'new' else 'old' end as version from log join (select match_id,home_score>away_score as w from sched) using(match_id) where not (w and period=2)")
def s11(t: Tables):
    won = t.schedule.where("home_score > away_score").select("match_id")
    old = t.log.selectExpr("match_id", "event_index", "'old' as version")
    new = t.log.where("period = 1").join(won, "match_id", "left_semi").selectExpr("match_id", "event_index", "'new' as version")
    return tables.upsert_matches(old, new)


@query("s11_partition_upsert", "select season,count(*) filter (season<>'2016-2017' or event_index<100) as rows from log group by 1")
def s11b(t: Tables):
    path = scratch_dir(t.spark, "upsert")
    base = t.log.select("season", "match_id", "event_index")
    base.write.mode("overwrite").partitionBy("season").parquet(path)
    tables.upsert_matches_table(base.where("season = '2016-2017' and event_index < 100"), path, "season")
    return t.spark.read.parquet(path).groupBy("season").agg(F.count(F.lit(1)).alias("rows"))


@query("s12_schedule_upsert", "select o_orderkey,case when o_orderstatus='F' then 'new' else o_orderstatus end as status,case when o_orderstatus='F' then o_totalprice end as extra from orders")
def s12(t: Tables):
    o = t.table("orders")
    old = o.selectExpr("o_orderkey", "o_orderstatus as status")
    new = o.where("o_orderstatus = 'F'").selectExpr("o_orderkey", "'new' as status", "o_totalprice as extra")
    return tables.upsert_by_key(old, new, ["o_orderkey"])


@query("s13_position_upsert", """select match_id,team,player,case when p%3=0 then 'old' when p%3=1 then 'new' else 'new' end as player_position from (select match_id,team,player,min(event_id) as p from log group by 1,2,3)""")
def s13(t: Tables):
    base = t.log.groupBy("match_id", "team", "player").agg(F.min("event_id").alias("p"))
    old = base.selectExpr("match_id", "team", "player", "if(p % 3 = 1, 'Unknown', 'old') as player_position")
    new = base.selectExpr("match_id", "team", "player", "if(p % 3 = 0, 'Unknown', 'new') as player_position")
    return tables.upsert_positions(old, new)


@query("s14_failed_log", "select match_id,case when status is null then 'new' else 'old' end as reason from sched where status is null or (home_score=0 and away_score<>0)")
def s14(t: Tables):
    s = t.schedule
    return tables.failed_log(s.where("home_score = 0").selectExpr("match_id", "'old' as reason"), s.where("away_score = 0").select("match_id"), s.where("status is null").selectExpr("match_id", "'new' as reason"))


def _docs(t: Tables):
    """Match documents built from the log: one JSON text per match of bounded size."""
    ev = t.log.selectExpr(
        "match_id", "home_team", "away_team", "home_id", "away_id",
        "struct(event_id as id, int(event_index) as eventId, team_id as teamId, player_id as playerId, if(period = 1, 'FirstHalf', 'SecondHalf') as period, minute, second, expanded_minute as expandedMinute,"
        " type, outcome as outcomeType, x, y, end_x as endX, end_y as endY, is_touch as isTouch, is_shot as isShot, is_goal as isGoal, transform(qual_tags, q -> struct(q as type, 'true' as value)) as qualifiers) as ev",
        "struct(player_id as playerId, player as name, shirt_no as shirtNo, position, is_starter as isFirstEleven, double(90) as minutesPlayed) as pl", "team_side",
    )
    g = ev.groupBy("match_id", "home_team", "away_team", "home_id", "away_id").agg(
        F.collect_list("ev").alias("events"), F.collect_set(F.expr("if(team_side = 'home', pl, null)")).alias("hp"), F.collect_set(F.expr("if(team_side = 'away', pl, null)")).alias("ap"))
    return g.select(F.expr("to_json(struct(match_id as matchId, struct(home_id as teamId, home_team as name, hp as players) as home, struct(away_id as teamId, away_team as name, ap as players) as away, events))").alias("document"))


@query("s15_match_document_events", "select match_id,event_index::bigint as event_id,team_id,team,player_id,player,type,outcome,case when period=1 then 'FirstHalf' else 'SecondHalf' end as period,minute,x,end_x,is_shot,is_goal from log")
def s15(t: Tables):
    return documents.document_events(documents.parse_match_documents(_docs(t))).select(
        "match_id", "event_id", "team_id", "team", "player_id", "player", "type", "outcome", "period", "minute", "x", "end_x", "is_shot", "is_goal")


@query("s16_match_document_lineups", "select distinct match_id,team_id,team,player_id,player,is_starter,90::double as mins_played,shirt_no,position from log")
def s16(t: Tables):
    return documents.document_lineups(documents.parse_match_documents(_docs(t)))


@query("s17_fixture_documents", "select match_id as game_id,strftime(kickoff,'%Y-%m-%d') as date,home_team,away_team,home_id as home_team_id,away_id as away_team_id,home_score,away_score,status,elapsed,1::bigint as stage_id,'League' as stage_name,'League phase' as competition_phase,false as is_playoff from sched")
def s17(t: Tables):
    docs = t.schedule.selectExpr(
        "to_json(struct(match_id as id, date_format(kickoff, 'yyyy-MM-dd') as startTimeUtc, home_team as homeTeamName, away_team as awayTeamName, home_id as homeTeamId, away_id as awayTeamId,"
        " home_score as homeScore, away_score as awayScore, status, elapsed, 1 as stageId, 'League' as stageName)) as document")
    return documents.fixture_rows(docs.union(docs))


@query("s18_container_columns", "select event_id,case when len(qual_tags)=0 then '[]' else '[\"'||array_to_string(qual_tags,'\",\"')||'\"]' end as as_text,len(qual_tags) as n from log")
def s18(t: Tables):
    path = scratch_dir(t.spark, "containers")
    t.log.select("event_id", "qual_tags").write.mode("overwrite").parquet(path)
    back = t.spark.read.parquet(path).select("event_id", F.to_json("qual_tags").alias("as_text"))
    return back.withColumn("n", F.size(F.from_json("as_text", "array<string>")).cast("bigint"))


@query("s19_freshness", "select 'f'||match_id as path,case when home_score=3 then 'new' when away_score=2 then 'removed' when home_score=1 then 'changed' else 'current' end as state from sched where not (home_score=3 and away_score=2)")
def s19(t: Tables):
    s = t.schedule
    prev = s.where("home_score <> 3").selectExpr("concat('f', match_id) as path", "match_id as length", "kickoff as modified")
    now = s.where("away_score <> 2").selectExpr("concat('f', match_id) as path", "match_id + int(home_score = 1) as length", "kickoff as modified")
    return tables.freshness(prev, now)


@query("s19_file_snapshot")
def s19b(t: Tables):
    return tables.file_listing(t.spark, _store(t)).withColumn("path", F.regexp_extract("path", r"(season=[^/]+/bucket=\d+)", 1)).groupBy("path").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("s20_dimensions", "select nation,tier,season,team_key,min(team) as team,count(distinct match_id) as matches from log group by 1,2,3,4")
def s20(t: Tables):
    return t.log.groupBy("nation", "tier", "season", "team_key").agg(F.min_by("team", F.struct("match_id", "event_index")).alias("team"), F.count_distinct("match_id").alias("matches"))


@query("s21_event_preview", "select * from (select match_id,event_index,type,coalesce(end_x::varchar,'') as end_x,row_number() over (partition by match_id order by event_index)::int as pos from log)")
def s21(t: Tables):
    df = t.log.select("match_id", "event_index", "type", F.coalesce(F.col("end_x").cast("string"), F.lit("")).alias("end_x"))
    return top_per_group(df, ["match_id"], [F.col("event_index")])


@query("s22_filtered_team_events", "select match_id,event_index,type,player from log where team_key='clubb0' and lower(type) like '%shot%' and lower(player) like '%p1.%'")
def s22(t: Tables):
    return t.log.where("team_key = 'clubb0' and contains(lower(type), 'shot') and contains(lower(player), 'p1.')").select("match_id", "event_index", "type", "player")


@query("s24_profile_store", """select nation,tier,season,team,passes,shots,events from stf""")
def s24(t: Tables):
    rows = facts.season_team_facts(facts.season_match_facts(t.e))
    path = scratch_dir(t.spark, "profiles")
    rows.select("nation", "tier", "season", "team", F.to_json(F.struct("passes", "shots", "events")).alias("profile")).write.mode("overwrite").parquet(path)
    back = t.spark.read.parquet(path).withColumn("p", F.from_json("profile", "passes long, shots long, events long"))
    return back.select("nation", "tier", "season", "team", "p.*")


@query("s26_team_scan", "select event_id,match_id,type from log where team_key in (select home_key from sched where match_round=1)")
def s26(t: Tables):
    keys = t.schedule.where("match_round = 1").select(F.col("home_key").alias("team_key")).distinct()
    return t.log.join(keys, "team_key", "left_semi").select("event_id", "match_id", "type")


# ------------------------------------------------------------------ context joins

@query("j01_match_context", "select l.event_id,s.home_team,s.away_team,s.home_score,case when l.team_key=s.home_key then s.away_team else s.home_team end as opponent,case when l.team_key=s.home_key then 'home' when l.team_key=s.away_key then 'away' else '' end as team_side from log l left join sched s using(match_id)")
def j01(t: Tables):
    ev = t.log.select("event_id", "match_id", "team_key")
    return normalise.attach_match_context(ev, t.schedule).select("event_id", "home_team", "away_team", "home_score", "opponent", "team_side")


@query("j02_position_join", "select event_id,case when event_id%3=0 then position when shirt_no%2=0 or event_id%2=0 then position else 'Unknown' end as position from log")
def j02(t: Tables):
    lineup = t.log.select("match_id", "team_id", "player_id", "player", "position", "shirt_no").distinct()
    pos = lineup.where("shirt_no % 2 = 0").select("match_id", "team_id", "player_id", F.upper("player").alias("player"), "position").unionByName(
        t.log.where("event_id % 2 = 0 and shirt_no % 2 = 1").selectExpr("match_id", "team_id", "cast(null as bigint) as player_id", "concat(player, '#', event_id) as player", "position"))
    ev = t.log.withColumn("position", F.expr("if(event_id % 3 = 0, position, if(event_id % 2 = 0, 'Unknown', ''))")).withColumn(
        "player", F.expr("if(event_id % 2 = 0 and shirt_no % 2 = 1, concat(player, '#', event_id), player)"))
    return tables.positions_join(ev, pos).select("event_id", "position")


@query("j08_prefix_join", "select distinct nation,tier,season,substr(home_key,1,5)||case when match_round%2=0 then '' else home_key[6:] end as event_key,home_team as team from sched")
def j08(t: Tables):
    names = t.schedule.selectExpr("nation", "tier", "season", "if(match_round % 2 = 0, substr(home_key, 1, 5), home_key) as event_key").distinct()
    teams = t.schedule.selectExpr("nation", "tier", "season", "home_key as team_key", "home_team as team").distinct()
    return tables.prefix_join(names, teams)


_COV = """with p as (select match_id,team_key,count(*) as n from log join (select match_id,status as st,away_score as aw from sched) using(match_id) where st is not null and not (aw=2 and team_side='away') group by 1,2), f as (select match_id,'timeout' as reason from sched where home_score=0),
 j as (select s.*,coalesce(h.n,0) as home_rows,coalesce(a.n,0) as away_rows,f.reason,coalesce(status in ('6','FT','AET','PEN'),false) or coalesce(elapsed in ('FT','AET','PEN','FULL TIME'),false) as finished from sched s left join p h on h.match_id=s.match_id and h.team_key=s.home_key left join p a on a.match_id=s.match_id and a.team_key=s.away_key left join f on f.match_id=s.match_id),
 k as (select *, case when home_rows>0 and away_rows>0 then 'complete' when home_rows>0 or away_rows>0 then 'partial' else 'missing' end as data_status from j)
 select nation,tier,season,match_id,home_team,away_team,kickoff,finished,home_rows,away_rows,data_status,case when data_status='complete' then 'saved' when not finished then 'not_finished' when reason is not null and data_status='partial' then 'failed_partial' when reason is not null then 'failed' when data_status='partial' then 'to_complete' else 'to_fetch' end as scrape_status from k"""
cte("cov", _COV)


def _saved(t: Tables):
    """Rows on disk: matches without a status are not fetched, some away files are missing."""
    state = t.schedule.selectExpr("match_id", "status", "away_score")
    return t.log.join(state, "match_id").where("status is not null and not (away_score = 2 and team_side = 'away')")


def _coverage(t: Tables):
    failed = t.schedule.where("home_score = 0").selectExpr("match_id", "'timeout' as reason")
    return tables.coverage(t.schedule, _saved(t), failed)


@query("j09_coverage", "select * from cov")
def j09(t: Tables):
    return _coverage(t)


@query("a47_coverage_overview", """with g as (select nation,tier,season,count(*) as fixtures,count(*) filter (finished) as finished,count(*) filter (data_status='complete') as complete,count(*) filter (data_status='partial') as partial,count(*) filter (data_status='missing') as missing,count(*) filter (scrape_status like 'failed%') as failed,count(*) filter (scrape_status in ('to_fetch','to_complete')) as to_fetch,count(*) filter (finished and data_status='complete') as finished_complete,sum(home_rows+away_rows)::bigint as event_rows from cov group by 1,2,3)
 select *, case when finished>0 then 100.0*finished_complete/finished else 0 end as coverage_pct,case when fixtures=0 then 'no schedule' when failed>0 then 'has failures' when to_fetch>0 and complete=0 then 'not started' when to_fetch>0 then 'incomplete' when partial>0 then 'partial' when finished=0 then 'waiting' else 'complete' end as status from g""")
def a47(t: Tables):
    return tables.coverage_overview(_coverage(t))


@query("j10_fixture_availability", "select match_id,home_team,away_team,kickoff,status,status is not null as has_home,status is not null and away_score<>2 as has_away,status is not null and away_score<>2 as has_both from sched")
def j10(t: Tables):
    return tables.fixtures(t.schedule, _saved(t))


@query("j28_schedule_merge", "select match_id,case when away_score<>0 and home_score<>1 then 'E'||match_id when home_score<>0 then 'P'||match_id end as venue,status,home_score=0 as added from sched where home_score<>0 or away_score<>0")
def j28(t: Tables):
    pri = t.schedule.where("home_score <> 0").selectExpr("match_id", "concat('P', match_id) as venue", "status")
    enr = t.schedule.where("away_score <> 0").selectExpr("match_id", "if(home_score = 1, null, concat('E', match_id)) as venue", "status")
    return tables.merge_schedules(pri, enr)


# ------------------------------------------------------------------ set operations

@query("u01_union_missing_columns", "select o_orderkey as id,o_orderstatus as status,null::varchar as segment from orders union all select c_custkey,null,c_mktsegment from customer")
def u01(t: Tables):
    a = t.table("orders").selectExpr("o_orderkey as id", "o_orderstatus as status")
    return a.unionByName(t.table("customer").selectExpr("c_custkey as id", "c_mktsegment as segment"), allowMissingColumns=True)


@query("u02_event_dedupe", "select match_id,event_index,type,player from log")
def u02(t: Tables):
    return tables.dedupe_events(t.log.unionByName(t.log.where("is_shot"))).select("match_id", "event_index", "type", "player")


@query("u03_id_set_operations", """select match_id,'both' as kind from sched where home_score=0 and away_score=0 union all select match_id,'left' from sched where home_score=0 and away_score<>0 union all select match_id,'any' from sched where home_score=0 or away_score=0""")
def u03(t: Tables):
    a, b = t.schedule.where("home_score = 0").select("match_id"), t.schedule.where("away_score = 0").select("match_id")
    tag = lambda d, k: d.withColumn("kind", F.lit(k))
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "left")).union(tag(a.union(b).distinct(), "any"))


@query("u04_schedule_teams", "select nation,tier,season,home_team as team from sched union select nation,tier,season,away_team from sched")
def u04(t: Tables):
    k = ["nation", "tier", "season"]
    return t.schedule.select(*k, F.col("home_team").alias("team")).union(t.schedule.select(*k, "away_team")).distinct()


# ------------------------------------------------------------------ scalar families

@query("x01_string", "select page_id,lower(trim(url)) as l,url like '%example%' as has,starts_with(url,'https') as secure,string_split(url,'/')[3] as host,regexp_extract(url,'/([0-9]+)',1) as number,concat_ws('-',page_id::varchar,'x') as tag from pages")
def x01(t: Tables):
    return t.table("pages").selectExpr("page_id", "lower(trim(url)) as l", "contains(url,'example') as has", "startswith(url,'https') as secure", "split(url,'/')[2] as host", "regexp_extract(url,'/([0-9]+)',1) as number", "concat_ws('-',page_id,'x') as tag")


@query("x02_datetime", "select event_id,strftime(ts,'%Y-%m-%dT%H:%M:%S') as iso,coalesce(try_strptime(case when event_id%2=0 then 'soon' else strftime(ts,'%Y-%m-%d') end,'%Y-%m-%d'),date_trunc('day',ts)+interval 1 day) as day from events")
def x02(t: Tables):
    return t.events.selectExpr("event_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") as iso",
                               "coalesce(try_to_timestamp(if(event_id % 2 = 0, 'soon', date_format(ts,'yyyy-MM-dd')), 'yyyy-MM-dd'), cast(date_trunc('day', ts) as timestamp) + interval 1 day) as day")


@query("x03_math", "select l_orderkey,l_linenumber,sqrt(l_quantity) as r,sqrt(power(l_quantity,2)+power(l_tax,2)) as h,acos(l_discount) as a,exp(-l_tax/4) as e,floor(l_extendedprice)::bigint as f,ceil(l_extendedprice)::bigint as c,least(greatest(l_quantity,10),40) as k,case when l_tax>0 then l_quantity/l_tax end as d from lineitem")
def x03(t: Tables):
    return t.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "sqrt(l_quantity) as r", "hypot(l_quantity,l_tax) as h", "acos(l_discount) as a", "exp(-l_tax/4) as e", "floor(l_extendedprice) as f", "ceil(l_extendedprice) as c", "least(greatest(l_quantity,10D),40D) as k", "try_divide(l_quantity,l_tax) as d")


@query("x04_array_map", "select event_id,list_contains(qual_tags,'Head') as head,list_has_any(qual_tags,['Cross','Longball']) as wide,len(qual_tags) as n,array_to_string(list_transform(qual_tags, lambda z: upper(z)),'|') as up,array_to_string(list_sort(list_distinct(qual_tags))[1:1],'') as first_tag from log")
def x04(t: Tables):
    return t.log.selectExpr("event_id", "array_contains(qual_tags,'Head') as head", "arrays_overlap(qual_tags,array('Cross','Longball')) as wide", "bigint(size(qual_tags)) as n", "array_join(transform(qual_tags, z -> upper(z)),'|') as up", "array_join(slice(array_sort(array_distinct(qual_tags)),1,1),'') as first_tag")


@query("x05_json", "select event_id,cast(json_extract_string(props,'$.k') as int) as k,coalesce(json_extract_string(props,'$.missing'),'none') as missing,'{\"k\":'||json_extract_string(props,'$.k')||'}' as again from events")
def x05(t: Tables):
    df = t.events.withColumn("p", F.from_json("props", "k int, missing string"))
    return df.select("event_id", "p.k", F.coalesce("p.missing", F.lit("none")).alias("missing"), F.to_json(F.struct("p.k")).alias("again"))


@query("x06_conditional", "select event_id,coalesce(end_x,0) as end_or_zero,nullif(outcome,'Unsuccessful') as good,case when x is null then -1 else x end as x_or from log")
def x06(t: Tables):
    return t.log.selectExpr("event_id", "coalesce(nanvl(end_x,null),0D) as end_or_zero", "nullif(outcome,'Unsuccessful') as good", "case when x is null then -1D else x end as x_or")


@query("x07_rates", "select match_id,team,case when count(*) filter (is_pass)>0 then 100.0*count(*) filter (is_pass and is_success)/count(*) filter (is_pass) else 0 end as pass_pct,case when count(*) filter (is_card)>0 then 100.0*count(*) filter (is_red_card)/count(*) filter (is_card) else 0 end as red_pct from fc group by 1,2")
def x07(t: Tables):
    n = lambda r: F.count_if(F.expr(r))
    return t.c.groupBy("match_id", "team").agg(text.pct(n("is_pass and is_success"), n("is_pass")).alias("pass_pct"), text.pct(n("is_red_card"), n("is_card")).alias("red_pct"))


@query("x08_hash", "select event_id,sha256('{\"event_id\":'||event_id||',\"event_type\":\"'||event_type||'\",\"user_id\":'||user_id||'}') as digest from events")
def x08(t: Tables):
    return t.events.select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")), 256).alias("digest"))


@query("a61_column_audit", " union all ".join(
    f"select '{c}' as \"column\",'{k}' as type,count(*) as rows,count(*) filter (\"{c}\" is null or lower(trim(\"{c}\"::varchar)) in ('nan','none','null','<na>','nat')) as null_like,count(*) filter (trim(\"{c}\"::varchar)='') as blank,count(*) filter (\"{c}\" is not null and trim(\"{c}\"::varchar)<>'' and try_cast(\"{c}\"::varchar as double) is null) as not_numeric from documents"
    for c, k in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))))
def a61(t: Tables):
    return tables.column_audit(t.table("documents"))


# ------------------------------------------------------------------ versioned store

#: Half of the matches of one season come again with their first 100 rows only.
_COMES = "(season = '2016-2017' and match_id % 2 = 0)"
cte("fb2", f"select * from fb where not {_COMES} or event_index < 100")
cte("tms2", TMS.replace("from fb ", "from fb2 "))


def _match_store(t: Tables, upserted: bool) -> str:
    root = scratch_dir(t.spark, "match-store")
    match_store.build(t.b, root, versions.source_files(t.spark, [f"{t.sf_dir}/events.parquet"]))
    if upserted:
        match_store.upsert(t.b.where(f"{_COMES} and event_index < 100"), root)
    return root


_MP = "(select distinct season,match_id,team,floor(expanded_minute/10) from {})"


def _store_counts(fb: str, tms: str, version: int) -> str:
    parts = {"events": fb, "team_match_summary": tms, "match_index": f"(select distinct season,match_id from {fb})", "momentum_profiles": _MP.format(fb)}
    return " union all ".join(f"select '{k}' as table_name,{version}::int as version,season as partition,count(*) as rows from {v} group by season" for k, v in parts.items())


@query("s09_versioned_store", _store_counts("fb", "tms", 1))
def s09_versions(t: Tables):
    return versions.counts(t.spark, _match_store(t, False)).withColumnRenamed("table", "table_name").where("table_name <> 'sources'")


@query("s09_store_upsert", _store_counts("fb2", "tms2", 2))
def s09_upsert(t: Tables):
    return versions.counts(t.spark, _match_store(t, True)).withColumnRenamed("table", "table_name").where("table_name <> 'sources'")


@query("s09_upserted_summary", "select * from tms2")
def s09_summary(t: Tables):
    return versions.read(t.spark, _match_store(t, True), "team_match_summary")
