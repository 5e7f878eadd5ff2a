"""Filters, style, squads and remaining projections."""

from pyspark.sql import functions as F

from touchline.functions import geometry, shots
from touchline.functions.flags import with_flags
from touchline.operators import facts, filters, maps, normalise, players, sequences, squads, style, value
from touchline.operators.topk import top_per_group
from touchline.plans.oracle_base import cte
from touchline.plans.registry import Tables, query

_K = "nation,tier,season,team"

# ------------------------------------------------------------------ filters
cte("mst", """with f as (select f.*, s.home_before,s.away_before, min(case when is_goal then expanded_minute end) over (partition by match_id) as fg,min(case when is_red_card then expanded_minute end) over (partition by match_id) as fr,min(case when type_c like '%substitution%' then expanded_minute end) over (partition by match_id) as fs
 from fc f join (select match_id,event_index,home_before,away_before from score) s using(match_id,event_index)) select * from f""")
_ST = {"all": "true", "first_half": "period=1", "second_half": "period=2", "before_first_goal": "fg is null or expanded_minute<fg", "after_first_goal": "fg is null or expanded_minute>=fg", "level_score": "home_before=away_before",
       "selected_team_leading": "home_before>away_before", "selected_team_trailing": "home_before<away_before", "after_first_red_card": "fr is null or expanded_minute>=fr", "after_first_substitution": "fs is null or expanded_minute>=fs"}


@query("f01_game_state", " union all ".join(f"select match_id,count(*) as rows_before,'{k}' as state,count(*) filter ({r}) as rows_after from mst group by 1" for k, r in _ST.items()))
def f01(t: Tables):
    return filters.game_state_counts(sequences.score_state(t.c))


@query("f01_level_rows", "select match_id,event_index from mst where home_before=away_before")
def f01b(t: Tables):
    return filters.game_state(sequences.score_state(t.c), "level_score").select("match_id", "event_index")


@query("f02_team_filter", "select event_id,team from log where team_key in (select home_key from sched where match_round=0)")
def f02(t: Tables):
    keys = t.schedule.where("match_round = 0").select(F.col("home_key").alias("team_key")).distinct()
    return filters.team_rows(t.log, keys).select("event_id", "team")


@query("f03_match_set_filter", "select event_id,match_id from log where match_id in (select match_id from sched where status='6' or elapsed='FT')")
def f03(t: Tables):
    return filters.in_matches(t.log, t.schedule.where("status = '6' or elapsed = 'FT'").select("match_id")).select("event_id", "match_id")


_MASK = ["progression", "move", "danger", "stoppage", "sequence_break", "forward_escape"]
_PROG = "((is_pass or is_cross or is_carry) and is_success and x is not null and y is not null and end_x is not null and end_y is not null)"
cte("masks", f"""select match_id,event_index,team_side,{_PROG} as progression,(is_pass or is_cross or is_carry or is_take_on) as move,(is_shot or box_entry or final_third_entry) as danger,
 regexp_matches(type_c||outcome_c,'start|end|substitution|formation|card|foul|offside|period') as stoppage,(regexp_matches(type_c,'start|end|substitution|formation|card|foul|offside|clearance') or regexp_matches(outcome_c,'unsuccessful|inaccurate|lost|offside')) as sequence_break,
 coalesce(is_success and (is_pass or is_cross or is_carry) and x is not null and end_x is not null and (final_third_entry or box_entry or end_x-x>=12),false) as forward_escape,is_pass and x is not null and end_x is not null as distribution from prep""")


@query("f04_movement_masks", "select match_id,event_index,progression,move,danger from masks")
def f04(t: Tables):
    return filters.with_masks(t.prep).select("match_id", "event_index", "progression", "move", "danger")


@query("f05_keyword_shots", "select f.event_id from feat f join fc c using(event_id) where regexp_matches(c.type_c||c.qual_c||f.shot_family,'corner|freekick|penalty')")
def f05(t: Tables):
    feats = value.shot_features(sequences.possessions(t.f))
    return filters.keyword_shots(feats, ["corner", "freekick", "penalty"]).select("event_id")


@query("f06_break_tests", "select match_id,event_index,stoppage,sequence_break from masks where stoppage or sequence_break")
def f06(t: Tables):
    return filters.with_masks(t.prep).where("stoppage or sequence_break").select("match_id", "event_index", "stoppage", "sequence_break")


@query("f07_side_filter", "select match_id,event_index,distribution from masks where team_side='away'")
def f07(t: Tables):
    return filters.side_rows(t.prep, "away").select("match_id", "event_index", "distribution")


@query("f08_forward_escape", "select match_id,event_index from masks where forward_escape")
def f08(t: Tables):
    return filters.with_masks(t.prep).where("forward_escape").select("match_id", "event_index")


# ------------------------------------------------------------------ style

_IPL = """case when chains<5 and moves<25 then 'Low control attack' when transition_rate>=8 and direct_share>=12 then 'Transition side' when chain_actions>=5.5 and long_share>=18 then 'Possession side' when direct_share>=20 or long_ball_share>=18 or (forward_share>=45 and chain_actions<4.8) then 'Direct side'
 when chain_actions>=4.5 or long_share>=12 then 'Mixed possession/direct' when transition_rate>=7 then 'Transition side' when forward_share>=40 then 'Direct side' else 'Low control attack' end"""


def _ip(keys: str) -> str:
    return f"""with c0 as (select {keys},match_id as mm,team as tt,chain_id,count(*) as actions,max(clock_s)-min(clock_s) as duration,arg_min(x,expanded_minute*100000+event_index) as x0,arg_max(coalesce(end_x,x),expanded_minute*100000+event_index) as x1,bool_or(is_shot) as shot,bool_or(box_entry) as box from tac group by all),
 c as (select {keys},count(*) as chains,avg(actions) as chain_actions,avg(duration) as chain_duration,count(*) filter (actions>=7 or duration>=25) as lc,count(*) filter (duration<=15 and x1-x0>=25) as dc,count(*) filter (shot) as sc,count(*) filter (box) as bc from c0 group by all),
 e as (select {keys},count(*) filter (is_pass or is_cross) as passes,count(*) filter ((is_pass or is_cross) and is_success) as good_passes,count(*) filter (is_pass or is_cross or is_carry or is_take_on) as moves,count(*) filter ((is_pass or is_cross) and is_success and end_x-x>=8) as fp,count(*) filter ((is_pass or is_cross) and qual_c like '%longball%') as lb,count(*) filter (high_regain or final_third_entry or box_entry or is_shot) as te from prep group by all),
 j as (select e.*,coalesce(chains,0) as chains,coalesce(chain_actions,0) as chain_actions,coalesce(chain_duration,0) as chain_duration,case when chains>0 then 100.0*lc/chains else 0 end as long_share,case when chains>0 then 100.0*dc/chains else 0 end as direct_share,case when chains>0 then 100.0*sc/chains else 0 end as shot_share,case when chains>0 then 100.0*bc/chains else 0 end as box_share,
  case when good_passes>0 then 100.0*fp/good_passes else 0 end as forward_share,case when passes>0 then 100.0*lb/passes else 0 end as long_ball_share,100.0*te/greatest(moves,1) as transition_rate from e left join c using({keys}))
 select * exclude (fp,lb,te), {_IPL} as label from j"""


cte("ipm", _ip("match_id,team"))
cte("ips", _ip(_K))


@query("a29_in_possession_style", "select * from ipm")
def a29(t: Tables):
    return style.in_possession(t.prep)


_OOPL = """case when actions<8 then 'Low event sample' when high_regain_share>=18 and high_share>=28 then 'Counter press side' when high_share>=36 or mean_x>=58 or ppda_proxy<=5 then 'High press side' when low_share>=46 or mean_x<=42 then 'Low block side' when high_share>=22 and mean_x>=50 then 'Mid/high press side' else 'Mid block side' end"""


def _oop(keys: str) -> str:
    ok = keys.replace("team", "opponent as team")
    return f"""with o as (select {keys},count(*) filter (is_defensive_action) as actions,count(*) filter (is_defensive_action and x>=60) as h,count(*) filter (is_defensive_action and x>=40 and x<60) as m,count(*) filter (is_defensive_action and x<40) as l,coalesce(avg(x) filter (is_defensive_action),0) as mean_x,count(*) filter (high_regain) as regains,count(*) filter (is_defensive_action and x>=50) as press from prep group by all),
 p as (select {ok},count(*) filter ((is_pass or is_cross) and is_success and x<60) as build,count(*) filter (box_entry) as box_allowed,count(*) filter (final_third_entry) as final_third_allowed from prep group by all),
 j as (select o.*,coalesce(box_allowed,0) as box_allowed,coalesce(final_third_allowed,0) as final_third_allowed,case when actions>0 then 100.0*h/actions else 0 end as high_share,case when actions>0 then 100.0*m/actions else 0 end as middle_share,case when actions>0 then 100.0*l/actions else 0 end as low_share,case when actions>0 then 100.0*regains/actions else 0 end as high_regain_share,case when coalesce(build,0)>0 then build/greatest(press,1)::double else 0 end as ppda_proxy from o left join p using({keys}))
 select * exclude (h,m,l,press), {_OOPL} as label from j"""


cte("oopm", _oop("match_id,team"))
cte("oops", _oop(_K))


@query("a30_out_of_possession_style", "select * from oopm")
def a30(t: Tables):
    return style.out_of_possession(t.prep)


@query("a31_style_shift", f"""with k as (select distinct {_K},match_id from prep) select k.*,a.label as match_ip,b.label as match_oop,c.label as season_ip,d.label as season_oop,a.label<>c.label as ip_shift,b.label<>d.label as oop_shift from k join ipm a using(match_id,team) join oopm b using(match_id,team) join ips c using({_K}) join oops d using({_K})""")
def a31(t: Tables):
    return style.style_shift(t.prep)


cte("phs", """select match_id,team,count(*) filter (is_pass and x<50) as b,count(*) filter (final_third_entry) as p,count(*) filter (is_shot) as f,count(*) filter (is_defensive_action) as d,avg(x) filter (is_shot) as sx,avg(x) filter (is_defensive_action) as dx from prep group by 1,2""")


@query("a32_phase_breakdown", """select match_id,team,'build up' as phase,b as count,null::double as mean_x from phs union all select match_id,team,'progression',p,null from phs union all select match_id,team,'finishing',f,sx from phs union all select match_id,team,'defending',d,dx from phs""")
def a32(t: Tables):
    return style.phases(t.prep)


@query("p52_season_tags", f"""with g as (select {_K},count(*) as rows,count(*) filter (e_pass) as passes,count(*) filter (e_final_third) as ft,count(*) filter (e_box) as bx,count(*) filter (e_move) as moves,count(*) filter (e_wide) as wide,count(*) filter (e_central) as central,count(*) filter (e_regain) as reg,count(*) filter (e_set_piece and e_shot) as sps,avg(ex) filter (e_defensive) as depth,count(distinct match_id) as matches from fe group by all)
 select {_K},array_to_string(list_filter([case when 100.0*passes/rows>=48 then 'Possession heavy' end,case when ft>0 and bx/ft>=0.42 then 'Direct' end,case when 100.0*wide/greatest(moves,1)>=52 then 'Wing focused' end,case when 100.0*central/greatest(moves,1)>=38 then 'Central progression' end,case when reg>=greatest(6,matches*2) then 'High pressing' end,case when reg>=greatest(4,matches) and bx>=greatest(3,matches) then 'Transition threat' end,case when sps>=greatest(2,matches) then 'Set piece threat' end,case when depth>0 and depth<45 and reg<greatest(4,matches) then 'Deep defending' end], lambda z: z is not null),'; ') as tags from g""")
def p52(t: Tables):
    return style.season_style_tags(t.e)


_L3 = "case when {0} is null then 'unknown' when {0}<33.333 then 'left' when {0}<66.667 then 'central' else 'right' end"
cte("sch", """with a as (select *, lag(team_key) over (partition by match_id order by period,expanded_minute,event_index) as pt from pv),
 c as (select *, sum(case when pt is null or pt<>team_key then 1 else 0 end) over (partition by match_id order by period,expanded_minute,event_index)::bigint as chain_id, expanded_minute*100000+event_index as kk from a)
 select nation,tier,season,team,match_id,chain_id,count(*) as actions,arg_min_null(y,kk) as y0,arg_max_null(coalesce(end_y,y),kk) as y1,count(*) filter (is_carry) as carries,bool_or(is_cross) as cr,bool_or(box_entry) as box,bool_or(final_third_entry) as ft,bool_or(is_shot) as shot,bool_or(is_goal) as goal,sum(xg) as xg,max(xg) as best_xg,sum(positive_league_xt) as xt from c group by all""")
cte("schf", f"""select *, concat_ws(' ',{_L3.format('y0')},'to',{_L3.format('y1')},case when cr then 'cross' when carries>=2 then 'carry progression' when box then 'box entry' else 'final third progression' end) as family from sch where actions>=2 and (shot or box or round(xt,9)>=0.12)""")


@query("p49_chain_family", "select match_id,chain_id,family from schf")
def p49(t: Tables):
    return style.chain_families(t.valued).select("match_id", "chain_id", "family")


@query("w20_repeated_chains", f"""with g as (select {_K},family,count(*) as chains,count(*) filter (shot) as shots,count(*) filter (goal) as goals,sum(xg) as xg,sum(xt) as xt,avg(actions) as mean_actions from schf group by all)
 select * from (select *, row_number() over (partition by {_K} order by chains desc,round(xg,8) desc,family)::int as pos from g)""")
def w20(t: Tables):
    return style.repeated_chains(t.valued)


@query("w21_sequence_browser", f"""with l as (select nation,tier,season,team,match_id,chain_id,actions,goal,shot,box,xg,best_xg,xt,unnest(list_filter([case when goal then 'goal' end,case when best_xg>=0.20 or (shot and box) then 'big_chance' end,case when shot then 'highest_xg' end,case when round(xt,9)>0 then 'highest_xt' end], lambda z: z is not null)) as list from sch)
 select * from (select *, row_number() over (partition by {_K},list order by round(case when list='highest_xt' then xt else xg end,8) desc,match_id,chain_id)::int as pos from l)""")
def w21(t: Tables):
    return style.sequence_browser(t.valued)


# ------------------------------------------------------------------ squads

@query("a57_discipline", """select * from (select match_id,team_side,player,count(*) filter (is_yellow_card) as yellow,count(*) filter (is_red_card) as red,count(*) filter (is_goal) as goals,min(expanded_minute) filter (type_c like '%substitution%') as substitution_minute from fc group by 1,2,3) where yellow>0 or red>0 or goals>0 or substitution_minute is not null""")
def a57(t: Tables):
    return squads.discipline(t.c)


cte("pos_", """select match_id,team,player,arg_min(position,event_index) as position,bool_or(is_starter) as is_starter from log where event_id%3<>0 group by 1,2,3""")
cte("lineup_", """with s as (select match_id,team,team_side,player,min(expanded_minute*100000+event_index) as f,min(shirt_no) as shirt_no from fc group by all), a as (select *, row_number() over (partition by match_id,team order by f,player)::int as appearance from s),
 j as (select match_id,team,player,a.team_side,a.shirt_no,a.appearance,p.position,p.is_starter from a full join pos_ p using(match_id,team,player))
 select match_id,team,player,team_side,shirt_no,appearance,position,coalesce(is_starter,max(case when position is not null then 1 else 0 end) over (partition by match_id,team)=0 and appearance<=11,false) as starter from j""")


def _positions(t: Tables):
    return t.log.where("event_id % 3 <> 0").groupBy("match_id", "team", "player").agg(
        F.min_by("position", "event_index").alias("position"), F.max("is_starter").alias("is_starter"))


@query("j26_lineup_candidates", "select * from lineup_")
def j26(t: Tables):
    return squads.lineup_candidates(t.c, _positions(t))


@query("a58_match_setup", """with d as (select match_id,player,count(*) filter (is_yellow_card) as yellow,count(*) filter (is_red_card) as red,count(*) filter (is_goal) as goals,min(expanded_minute) filter (type_c like '%substitution%') as substitution_minute from fc group by 1,2)
 select l.*,coalesce(yellow,0) as yellow,coalesce(red,0) as red,coalesce(goals,0) as goals,substitution_minute,case when not starter or (substitution_minute is not null and coalesce(position,'Sub')='Sub') then 'bench' else 'starter' end as role from lineup_ l left join d using(match_id,player)""")
def a58(t: Tables):
    return squads.match_setup(t.c, _positions(t))


@query("j27_shirt_enrichment", """with s as (select match_id,team_side,player,min(shirt_no) as ls from fc group by 1,2,3) select event_id,coalesce(case when event_id%2=0 then c.shirt_no end,ls) as shirt_no from fc c left join s using(match_id,team_side,player)""")
def j27(t: Tables):
    ev = t.c.withColumn("shirt_no", F.expr("if(event_id % 2 = 0, shirt_no, null)"))
    return squads.enrich_shirts(ev, t.c).select("event_id", "shirt_no")


@query("w17_best_lineup_row", """with r as (select match_id,team,player,case when event_id%5=0 then 'Sub' when event_id%7=0 then null else position end as position,case when event_id%4=0 then is_starter end as st,event_id as row_no from log),
 k as (select *, row_number() over (partition by match_id,team,player order by (position is not null and position not in ('','Unknown','Sub')) desc,(coalesce(position,'')='Sub'),length(coalesce(position,'')) desc,position nulls first,row_no) as k,bool_or(st) over (partition by match_id,team,player) as anyt from r)
 select match_id,team,player,position,row_no,coalesce(anyt,position is not null and position not in ('','Unknown','Sub')) as starter from k where k=1""")
def w17(t: Tables):
    rows = t.log.selectExpr("match_id", "team", "player", "case when event_id % 5 = 0 then 'Sub' when event_id % 7 = 0 then null else position end as position",
                            "if(event_id % 4 = 0, is_starter, null) as is_starter", "event_id as row_no")
    return squads.best_lineup_row(rows)


cte("keep", f"""with g as (select {_K},player,count(*) filter (regexp_matches(type_c,'keeper|save$|claim|punch') or position='GK' or shirt_no=1) as keeper_rows,count(*) filter (e_pass) as passes,avg(x) filter (e_pass) as pass_x from fe group by all)
 select * exclude (k) from (select *, row_number() over (partition by {_K} order by keeper_rows desc,round(pass_x,6) asc nulls last,player) as k from g) where k=1""")


@query("a51_keepers", "select * from keep")
def a51(t: Tables):
    return squads.keepers(t.e)


@query("a51_keeper_distribution", f"""with p as (select e.*, sqrt(power(eex-ex,2)+power(eey-ey,2)) as len,case when eey<80/3.0::double then 'left' when eey<=160/3.0::double then 'central' else 'right' end as target_lane from fe e join keep k using({_K},player) where e_pass and end_x is not null and x is not null)
 select {_K},player,case when len<20 then 'short' when len<45 then 'medium' when len<55 then 'long' else 'launched' end as band,target_lane,count(*) as passes,count(*) filter (e_success) as good,count(*) filter (eex-ex>=10) as progressive,avg(len) as mean_length,100.0*count(*) filter (e_success)/count(*) as completion from p group by all""")
def a51b(t: Tables):
    return squads.keeper_distribution(t.e)


cte("xi", f"""with g as (select {_K},player,count(distinct match_id) as matches,count(*) as events,avg(ex/1.2) as mean_x,avg(ey/0.8) as mean_y from fe group by all), r as (select *, row_number() over (partition by {_K} order by matches desc,events desc,player)::int as pos from g)
 select *, case when mean_x<26 then 'DF' when mean_x<55 then 'MF' when mean_x<75 then 'AM' else 'FW' end as role from r where pos<=11""")


@query("a52_common_lineup", "select * from xi")
def a52(t: Tables):
    return squads.common_lineup(t.e)


@query("a52_formation", f"""with g as (select {_K},count(*) filter (role='DF') as DF,count(*) filter (role='MF') as MF,count(*) filter (role='AM') as AM,count(*) filter (role='FW') as FW from xi group by all) select *, DF||'-'||MF||'-'||AM||'-'||FW as formation from g""")
def a52b(t: Tables):
    return squads.formation(squads.common_lineup(t.e))


cte("bp", """with p as (select match_id,team,player,count(*) filter (is_goal) as g,count(*) filter (is_shot) as s,count(*) filter (box_entry) as b,count(*) filter (final_third_entry) as f,count(*) filter (is_cross) as c,count(*) filter (is_carry) as ca,count(*) filter (is_take_on) as t,count(*) filter (high_regain) as r,count(*) filter (is_defensive_action) as d,sum(positive_xt) as xt from pv group by 1,2,3),
 l as (select match_id,team,player,score as dl from dlead), w as (select match_id,team,player,sum(count*case role when 'taker' then 0.75 when 'first_contact' then 1 when 'shot' then 1.4 when 'clearer' then 1 else 1.3 end)::double as sp from spinv group by 1,2,3),
 q as (select p.match_id,p.team,p.player,5*g+1.25*s+1.15*b+0.55*f+0.35*c+0.35*(ca+t)+14*xt as attacking_score,2.2*r+0.45*d+coalesce(dl,0) as defensive_score,2.0*r+0.8*b+0.35*f+0.35*(ca+t)+7*xt as transition_score,coalesce(sp,0) as set_piece_score from p left join l using(match_id,team,player) left join w using(match_id,team,player))
 select match_id,team,player,attacking_score::double as attacking_score,defensive_score::double as defensive_score,transition_score::double as transition_score,set_piece_score::double as set_piece_score,(attacking_score+defensive_score+transition_score+set_piece_score)::double as overall_score from q""")


@query("a28_best_players", "select * from bp")
def a28(t: Tables):
    return squads.best_players(t.valued)


@query("k01_best_player_lists", """with u as (select match_id,team,player,x.list,round(case x.list when 'attacking' then attacking_score when 'defensive' then defensive_score when 'transition' then transition_score when 'set_piece' then set_piece_score else overall_score end,8) as score from bp cross join (values ('attacking'),('defensive'),('transition'),('set_piece'),('overall')) x(list))
 select * from (select *, row_number() over (partition by match_id,team,list order by score desc,player)::int as pos from u where score>0)""")
def k01(t: Tables):
    return squads.best_lists(squads.best_players(t.valued))


cte("pxg", "select ff.season,ff.nation,ff.tier,ff.team,ff.player,ff.player_id,sum(l.xg) as xg from ff join logx l using(event_id) where ff.f_shot group by all")


@query("j24_player_metric_merge", """with p as (select team,player,case when min(event_id)%2=0 then any_value(player_id) end as player_id from log group by 1,2), i as (select team,player_id,sum(xg) as a from pxg group by 1,2), n as (select team,lower(player) as nm,sum(xg) as b from pxg group by 1,2)
 select p.team,p.player,p.player_id,coalesce(a,b,0) as xg from p left join i on i.team=p.team and i.player_id=p.player_id left join n on n.team=p.team and n.nm=lower(p.player)""")
def j24(t: Tables):
    base = t.log.groupBy("team", "player").agg(F.expr("if(min(event_id) % 2 = 0, max(player_id), null)").alias("player_id"))
    xg = players.player_xg(t.shots)
    return squads.metric_merge(base, xg).select("team", "player", "player_id", "xg")


@query("a64_contribution_table", """select 'xg' as family,season,nation,tier,team,player,xg as value from pxg union all select 'xa',season,nation,tier,team,player,sum(xg) from assist where role='assist' group by 1,2,3,4,5,6 union all select 'xt',season,nation,tier,team,player,sum(league_xt_added) from pv where f_move group by 1,2,3,4,5,6""", trained=True)
def a64(t: Tables):
    k = ["season", "nation", "tier", "team", "player"]
    xg = players.player_xg(t.shots).select(F.lit("xg").alias("family"), *k, F.col("xg").alias("value"))
    xa = t.credits.where("role = 'assist'").groupBy(*k).agg(F.sum("xg").alias("value")).withColumn("family", F.lit("xa"))
    f = t.valued.where("(f_pass or f_carry) and f_success and zone_start >= 0 and zone_end >= 0")
    xt = f.groupBy(*k).agg(F.sum("league_xt_added").alias("value")).withColumn("family", F.lit("xt"))
    return xg.unionByName(xa, allowMissingColumns=True).unionByName(xt, allowMissingColumns=True)


@query("a65_goal_mouth_split", """select c.nation,c.tier,c.season,c.team,case when g.status='goal' then 'goal' when g.status like 'saved%' then 'save' when g.status='blocked' then 'block' else 'off' end as outcome,count(*) as shots,avg(g.horizontal) as mean_horizontal from gm g join fc c using(match_id,event_index) group by all""")
def a65(t: Tables):
    df = shots.goal_mouth(t.c.where("is_shot")).withColumn("outcome", F.expr("case when status = 'goal' then 'goal' when status like 'saved%' then 'save' when status = 'blocked' then 'block' else 'off' end"))
    return df.groupBy("nation", "tier", "season", "team", "outcome").agg(F.count(F.lit(1)).alias("shots"), F.avg("horizontal").alias("mean_horizontal"))


@query("a62_one_direction", """with m as (select match_id,team,period,median(coalesce(end_x,x)) as dx from fc group by all) select event_id,coalesce(dx<50,false) as flipped,case when dx<50 then 100-x else x end as one_x,case when dx<50 then 100-y else y end as one_y,case when dx<50 then 100-end_x else end_x end as one_end_x from fc join m using(match_id,team,period)""")
def a62(t: Tables):
    return normalise.one_direction(t.c).select("event_id", "flipped", "one_x", "one_y", "one_end_x")


# ------------------------------------------------------------------ projections

@query("p50_threat_value", """select match_id,event_index,least(greatest(v,0),1.4) as threat from (select *, greatest(0.08,positive_xt,xg)+0.22*coalesce(end_x>=83 and end_y between 21.1 and 78.9,false)::int+0.16*final_third_entry::int+0.24*box_entry::int+0.35*is_shot::int as v from pv where is_pass or is_cross or is_carry or is_shot)""")
def p50(t: Tables):
    df = t.valued.where("is_pass or is_cross or is_carry or is_shot")
    return df.selectExpr("match_id", "event_index",
                         "least(greatest(greatest(0.08D, positive_xt, xg) + if(coalesce(end_x >= 83 and end_y between 21.1 and 78.9, false), 0.22D, 0D) + if(final_third_entry, 0.16D, 0D)"
                         " + if(box_entry, 0.24D, 0D) + if(is_shot, 0.35D, 0D), 0D), 1.4D) as threat")


@query("p51_substitution_tests", "select event_id,type_c like '%substitution%' as is_substitution,type_c like '%substitutionon%' as comes_on,type_c like '%substitutionoff%' as goes_off from log")
def p51(t: Tables):
    return with_flags(t.log, is_substitution=filters.SUBSTITUTION, comes_on="type_c rlike 'substitutionon|subon'", goes_off="type_c rlike 'substitutionoff|suboff'").select(
        "event_id", "is_substitution", "comes_on", "goes_off")


@query("p45_event_points", "select * from (select match_id,team,event_index,expanded_minute,player,type,x,y,end_x,end_y,is_success,row_number() over (partition by match_id,team order by period,expanded_minute,event_index)::int as pos from fc where x is not null and (is_pass or is_shot or is_carry))")
def p45(t: Tables):
    df = t.c.where("x is not null and (is_pass or is_shot or is_carry)")
    return top_per_group(df, ["match_id", "team"], [F.col("period"), F.col("expanded_minute"), F.col("event_index")]).select(
        "match_id", "team", "event_index", "expanded_minute", "player", "type", "x", "y", "end_x", "end_y", "is_success", "pos")


@query("p54_event_kind", """select event_id,case when type_c like '%goal%' then 'goal' when is_shot then 'shot' when is_cross then 'cross' when is_pass then 'pass' when is_take_on then 'take_on' when is_carry then 'carry' when is_defensive_action then 'defensive' else 'other' end as kind,
 case when (is_pass or is_cross) and x is not null and end_x is not null then case when len<20 then 'short' when len<40 then 'medium' when len<60 then 'long' else 'launched' end end as length_bucket from (select *, sqrt(power(end_x-x,2)+power(end_y-y,2)) as len from fc)""")
def p54(t: Tables):
    df = t.c.withColumn("len", F.expr("sqrt(power(end_x - x, 2) + power(end_y - y, 2))"))
    return df.selectExpr(
        "event_id", "case when type_c like '%goal%' then 'goal' when is_shot then 'shot' when is_cross then 'cross' when is_pass then 'pass' when is_take_on then 'take_on' when is_carry then 'carry' when is_defensive_action then 'defensive' else 'other' end as kind",
        "case when (is_pass or is_cross) and x is not null and end_x is not null then case when len < 20 then 'short' when len < 40 then 'medium' when len < 60 then 'long' else 'launched' end end as length_bucket")


@query("p58_on_target", """select event_id,case when is_goal then true when regexp_matches(t,'block|missed|offtarget|wide|overbar|high') then false else regexp_matches(t,'saved|save|ontarget|keeper') end as on_target from (select *, type_c||outcome_c||qual_c as t from fc where is_shot)""")
def p58(t: Tables):
    txt = "concat(type_c, outcome_c, qual_c)"
    return t.c.where("is_shot").selectExpr("event_id", f"case when is_goal then true when {txt} rlike 'block|missed|offtarget|wide|overbar|high' then false else {txt} rlike 'saved|save|ontarget|keeper' end as on_target")


@query("p26_action_rows", """with b as (select *, list_transform(qual_tags, lambda z: lower(z)) as tc from log),
 n as (select *, case when list_contains(tc,'corner') and list_contains(tc,'cross') then 'corner_crossed' when list_contains(tc,'corner') then 'corner_short' when list_contains(tc,'freekick') and list_contains(tc,'cross') then 'freekick_crossed' when list_contains(tc,'freekick') then 'freekick_short' when list_contains(tc,'throwin') then 'throw_in'
  when list_contains(tc,'cross') or type_c='cross' then 'cross' when type_c='takeon' then 'take_on' when type_c in ('dribble','carry','run') then 'dribble' when type_c like '%shot%' or is_shot then case when list_contains(tc,'penalty') then 'shot_penalty' else 'shot' end when type_c like '%save%' then 'keeper_save' when type_c like '%claim%' then 'keeper_claim' when type_c like '%punch%' then 'keeper_punch'
  when type_c like '%interception%' then 'interception' when type_c like '%clearance%' then 'clearance' when type_c like '%tackle%' or type_c like '%challenge%' then 'tackle' when type_c like '%foul%' then 'foul' when type_c like '%touch%' then 'bad_touch' else 'pass' end as type_name,
  case when is_goal or outcome_c='successful' then 'success' when outcome_c like '%offside%' then 'offside' else 'fail' end as result_name,case when list_has_any(tc,['header','head','headed']) then 'head' else 'foot' end as bodypart_name from b)
 select match_id as game_id,period as period_id,(minute*60+second)::double as time_seconds,team_id,player_id,x*1.05 as start_x,y*0.68 as start_y,end_x*1.05 as end_x,end_y*0.68 as end_y,type_name,result_name,bodypart_name,
  case result_name when 'fail' then 0 when 'success' then 1 else 2 end as result_id,case bodypart_name when 'foot' then 0 else 1 end as bodypart_id from n""")
def p26(t: Tables):
    return normalise.action_rows(t.log).drop("type_id", "event_id")


@query("p27_position", """select event_id,regexp_extract(split_part(p,',',1),'[A-Z]{2,3}') as token,case when regexp_extract(split_part(p,',',1),'[A-Z]{2,3}')='GK' then 'GK' when regexp_extract(split_part(p,',',1),'[A-Z]{2,3}') in ('DC','CB') then 'CB' when regexp_extract(split_part(p,',',1),'[A-Z]{2,3}') in ('DR','DL','RB','LB') then 'FB' when regexp_extract(split_part(p,',',1),'[A-Z]{2,3}')='DMC' then 'DM' when regexp_extract(split_part(p,',',1),'[A-Z]{2,3}')='MC' then 'CM'
 when regexp_extract(split_part(p,',',1),'[A-Z]{2,3}') in ('MR','ML') then 'WM' when regexp_extract(split_part(p,',',1),'[A-Z]{2,3}')='AMC' then 'AM' when regexp_extract(split_part(p,',',1),'[A-Z]{2,3}') in ('AML','AMR','FWR','FWL') then 'WF' when regexp_extract(split_part(p,',',1),'[A-Z]{2,3}')='FW' then 'CF' else '' end as position_group from (select event_id,'('||position||case when event_id%3=0 then ', MC' else '' end||')' as p from log)""")
def p27(t: Tables):
    df = t.log.selectExpr("event_id", "concat('(', position, if(event_id % 3 = 0, ', MC', ''), ')') as raw")
    return normalise.positions(df, "raw").select("event_id", "token", "position_group")


@query("p22_canonical_team", """select l.event_id,coalesce(case when l.event_id%3=0 then s.nm end,case when l.event_id%3=1 then k.nm end) as canonical from log l left join (select distinct home_id,home_team as nm from sched) s on s.home_id=l.team_id left join (select distinct home_key,home_team as nm from sched) k on k.home_key=l.team_key where coalesce(case when l.event_id%3=0 then s.nm end,case when l.event_id%3=1 then k.nm end) is not null""")
def p22(t: Tables):
    df = t.log.selectExpr("event_id", "if(event_id % 3 = 0, team_id, null) as team_id", "if(event_id % 3 = 1, upper(team), 'unknown') as team")
    return normalise.canonical_team(df, t.schedule).select("event_id", "canonical")


@query("p23_side", """select l.event_id,case when l.event_id%4=0 then 'home' when l.event_id%4<>3 then l.team_side when l.event_id%4=3 and l.team_id=l.home_id then 'home' else 'away' end as side from log l""")
def p23(t: Tables):
    df = t.log.selectExpr(
        "event_id", "if(event_id % 4 = 0, 'home', '') as side", "case event_id % 4 when 1 then team_key when 2 then substr(team_key, 1, 5) else '' end as source_key",
        "regexp_replace(lower(home_team),'[^a-z0-9]+','') as home_key", "regexp_replace(lower(away_team),'[^a-z0-9]+','') as away_key", "team_id", "home_id", "away_id")
    return normalise.side_from_names(df).select("event_id", "side")


@query("p24_finished_kickoff", """select match_id,coalesce(status in ('6','FT','AET','PEN'),false) or coalesce(elapsed in ('FT','AET','PEN','FULL TIME'),false) as finished, case when match_id%3=0 then null when match_id%3=1 then kickoff else kickoff - interval 15 hour end as started from sched""")
def p24(t: Tables):
    df = t.schedule.selectExpr(
        "match_id", "status", "elapsed", "if(match_id % 3 = 1, date_format(kickoff, 'yyyy-MM-dd HH:mm:ss'), 'tbc') as started_at_utc",
        "cast(null as string) as start_time", "if(match_id % 3 = 2, date_format(kickoff, 'yyyy-MM-dd'), '') as date")
    return normalise.finished_and_kickoff(df).select("match_id", "finished", F.col("kickoff").alias("started"))


@query("p25_match_index", "select match_id,home_team,away_team,home_key,away_key,strftime(kickoff,'%Y-%m-%dT%H:%M:%S') as kickoff_text,strftime(kickoff,'%Y-%m-%d') as match_date,coalesce(status,'') as status,home_score::double as home_score,away_score::double as away_score from sched")
def p25(t: Tables):
    return normalise.match_index(t.schedule)


@query("p53_stage_phase", """select match_id,case when regexp_matches(st,'play-?off|final|knockout|semi|quarter|promotion|relegation') then 'Playoffs' when sid=1 then 'League phase' else 'Additional stage' end as phase,regexp_matches(st,'play-?off|final|knockout|semi|quarter|promotion|relegation') as is_playoff from (select match_id,(match_id%3)+1 as sid,(['league','promotion play-offs','cup group'])[match_id%3+1] as st from sched)""")
def p53(t: Tables):
    df = t.schedule.selectExpr("match_id", "match_id % 3 + 1 as stage_id", "element_at(array('League','Promotion Play-offs','Cup group'), cast(match_id % 3 as int) + 1) as stage_name")
    return normalise.stage_phase(df, primary=1).select("match_id", "phase", "is_playoff")


@query("p56_league_dimension", "select match_id,nation||'-'||lower(tier) as league_key,nation,tier,season,substr(season,1,4)::int as start_year from sched")
def p56(t: Tables):
    dim = t.schedule.select("nation", "tier").distinct().withColumn("league_key", F.concat_ws("-", "nation", F.lower("tier")))
    return t.schedule.join(dim, ["nation", "tier"]).selectExpr("match_id", "league_key", "nation", "tier", "season", "int(substr(season, 1, 4)) as start_year")
