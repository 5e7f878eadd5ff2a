"""Order-dependent operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import sequences as seq
from touchline.plans.oracle_base import cte
from touchline.plans.registry import ORACLES, Tables, query

_W = "partition by match_id order by period,expanded_minute,event_index"

_W01 = f"""select event_id,(row_number() over ({_W})-1)::int as row_index,
 match_id||'::'||(row_number() over ({_W})-1)||'::'||team_key as event_uid from log"""


@query("w01_event_index", _W01)
def w01(t: Tables):
    return seq.event_index(t.log).select("event_id", "row_index", "event_uid")


@query("w01_event_index_in_blocks", _W01)
def w01b(t: Tables):
    return seq.event_index_in_blocks(t.log).select("event_id", "row_index", "event_uid")


cte("poss", f"""
with a as (select *, lag(period) over ({_W}) as pp, lag(team) over ({_W}) as pt from ff),
b as (select *, sum(case when pp is null or pp<>period or pt<>team then 1 else 0 end) over ({_W}) as possession_id from a)
select *, row_number() over w as possession_action, lag(expanded_minute) over w as prev_minute, lag(player) over w as prev_player,
 coalesce(lag(f_pass) over w,false) as prev_pass, coalesce(lag(f_carry) over w,false) as prev_carry, coalesce(lag(f_cross) over w,false) as prev_cross,
 coalesce(lag(f_through) over w,false) as prev_through, coalesce(lag(f_cutback) over w,false) as prev_cutback
from b window w as (partition by match_id,possession_id order by period,expanded_minute,event_index)""")


@query("w02_possessions", """select event_id,possession_id::bigint as possession_id,possession_action::int as possession_action,prev_minute,prev_player,
 prev_pass,prev_carry,prev_cross,prev_through,prev_cutback from poss""")
def w02(t: Tables):
    return seq.possessions(t.f).select(
        "event_id", "possession_id", "possession_action", "prev_minute", "prev_player", "prev_pass", "prev_carry",
        "prev_cross", "prev_through", "prev_cutback",
    )


@query("w02_possessions_in_blocks", "select event_id,possession_id::bigint as possession_id from poss")
def w02b(t: Tables):
    return seq.possessions_in_blocks(t.f).select("event_id", "possession_id")


@query("w03_season_chains", f"""select event_id, sum(case when pt is null or pt<>team_key then 1 else 0 end) over ({_W})::bigint as chain_id
 from (select *, lag(team_key) over ({_W}) as pt from log)""")
def w03(t: Tables):
    return seq.season_chains(t.log).select("event_id", "chain_id")


def chain_sql(src: str, part: str) -> str:
    w = f"partition by {part} order by period,expanded_minute,event_index"
    return f"""with h as (select *, regexp_matches(type_c||outcome_c,'start|end|substitution|formation|card|foul|offside|period') as halt from {src}),
 p as (select *, lag(period) over w as pp, lag(team_key) over w as pt, lag(clock_s) over w as pc, lag(halt) over w as ph from h window w as ({w}))
 select * exclude (halt,pp,pt,pc,ph), sum(case when pp is null or pp<>period or pt<>team_key or clock_s-pc>15 or halt or ph then 1 else 0 end) over ({w})::bigint as attack_chain_id from p"""


cte("chains", chain_sql("fc", "match_id"))
cte("ochains", chain_sql("pv", "match_id,team_key"))


@query("w03_season_chains_in_blocks", ORACLES["w03_season_chains"])
def w03_blocks(t: Tables):
    return seq.season_chains_in_blocks(t.log).select("event_id", "chain_id")


@query("w04_attack_chains_in_blocks", "select event_id, attack_chain_id from chains")
def w04_blocks(t: Tables):
    return seq.attack_chains_in_blocks(t.c).select("event_id", "attack_chain_id")


@query("w05_team_action_chains_in_blocks", "select match_id,event_index,team,chain_id from tac")
def w05_blocks(t: Tables):
    return seq.team_action_chains_in_blocks(t.prep).select("match_id", "event_index", "team", "chain_id")


@query("w04_attack_chains", "select event_id, attack_chain_id from chains")
def w04(t: Tables):
    return seq.attack_chains(t.c).select("event_id", "attack_chain_id")


cte("tac", """with a as (select * from pv where (is_chain_action or box_entry or final_third_entry) and x is not null),
 p as (select *, lag(period) over w as pp, lag(clock_s) over w as pc from a window w as (partition by match_id,team_key order by period,expanded_minute,event_index))
 select * exclude (pp,pc), sum(case when pp is null or pp<>period or clock_s-pc<0 or clock_s-pc>10 then 1 else 0 end) over (partition by match_id,team_key order by period,expanded_minute,event_index)::bigint as chain_id from p""")


@query("w05_team_action_chains", "select match_id,event_index,team,chain_id from tac")
def w05(t: Tables):
    return seq.team_action_chains(t.prep).select("match_id", "event_index", "team", "chain_id")


_SC = f"""select match_id,event_index,
 coalesce(sum(case when is_goal and team_side='home' then 1 else 0 end) over ({_W} rows between unbounded preceding and 1 preceding),0)::bigint as home_before,
 sum(case when is_goal and team_side='home' then 1 else 0 end) over ({_W} rows between unbounded preceding and current row)::bigint as home_after,
 coalesce(sum(case when is_goal and team_side='away' then 1 else 0 end) over ({_W} rows between unbounded preceding and 1 preceding),0)::bigint as away_before,
 sum(case when is_goal and team_side='away' then 1 else 0 end) over ({_W} rows between unbounded preceding and current row)::bigint as away_after from fc"""
cte("score", _SC)
_SCC = ["match_id", "event_index", "home_before", "home_after", "away_before", "away_after"]


@query("w07_score_state", "select * from score")
def w07(t: Tables):
    return seq.score_state(t.c).select(*_SCC)


@query("w07_score_state_in_blocks", "select * from score")
def w07b(t: Tables):
    return seq.score_state_in_blocks(t.c).select(*_SCC)


@query("w12_match_markers", """select f.match_id,f.event_index,f.team,f.player,case when f.is_goal then 'goal' else 'red card' end as marker,
 s.home_after||'-'||s.away_after as score from fc f join score s using(match_id,event_index) where f.is_goal or f.is_red_card""")
def w12(t: Tables):
    return (
        seq.score_state(t.c)
        .where("is_goal or is_red_card")
        .selectExpr("match_id", "event_index", "team", "player", "if(is_goal, 'goal', 'red card') as marker",
                    "concat(home_after, '-', away_after) as score")
    )


@query("w15_inferred_carries", """select match_id,event_index,team,player,x,y,end_x,end_y,carry_distance,carry_seconds,carry_end_type,final_third_entry,box_entry
 from prep where type='InferredCarry'""")
def w15(t: Tables):
    return t.prep.where("type = 'InferredCarry'").select(
        "match_id", "event_index", "team", "player", "x", "y", "end_x", "end_y", "carry_distance", "carry_seconds",
        "carry_end_type", "final_third_entry", "box_entry",
    )


@query("w18_take_on_ends", "select event_id,end_x,end_y,take_on_end_inferred,take_on_seconds::double as take_on_seconds from tk where is_take_on")
def w18(t: Tables):
    return seq.add_take_on_ends(t.c).where("is_take_on").select("event_id", "end_x", "end_y", "take_on_end_inferred", "take_on_seconds")


@query("s25_prepared_events", """select match_id,event_index,type,team_side,x,end_x,is_carry,is_inferred_carry,xt_added,xg from pv""")
def s25(t: Tables):
    from touchline.sources.store import prepared_table

    return prepared_table(t.valued).select(
        "match_id", "event_index", "type", "team_side", "x", "end_x", "is_carry", "is_inferred_carry", "xt_added", "xg")


@query("w16_latest_location", """with a as (select *, row_number() over (partition by match_id,team,player order by period desc,expanded_minute desc,event_index desc) as rn
 from fc where expanded_minute<=60 and x is not null and (is_touch or is_pass or is_carry)) select match_id,team,player,x,y,expanded_minute from a where rn=1""")
def w16(t: Tables):
    from touchline.operators.links import latest_locations

    return latest_locations(t.c, 60).select("match_id", "team", "player", "x", "y", "expanded_minute")
