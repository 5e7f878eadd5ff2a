"""Team, player and season facts."""

from pyspark.sql import functions as F

from touchline.operators import facts
from touchline.plans.oracle_base import cte
from touchline.plans.registry import Tables, query

TMS = """select nation,tier,season,match_id,team,team_key,team_side,opponent,home_team,away_team,kickoff,
 count(*) filter (is_pass or is_cross) as passes, count(*) filter ((is_pass or is_cross) and is_success) as good_passes,
 count(*) filter (is_shot) as shots, count(*) filter (is_goal) as goals, count(*) filter (box_entry) as box_entries,
 count(*) filter (final_third_entry) as final_third_entries, count(*) filter (attacking_third_touch) as attacking_third_touches,
 count(*) filter (is_defensive_action) as defensive_actions, count(*) filter (high_regain) as high_regains,
 count(*) filter ((is_pass or is_cross) and is_success and end_x-x>=25) as direct_attacks,
 count(*) filter (high_regain or (box_entry and x<60)) as transition_attacks,
 count(*) filter ((is_pass or is_cross) and qual_c like '%longball%') as long_balls, count(*) as total_events,
 case when count(*) filter (is_pass or is_cross)>0 then 100.0*count(*) filter ((is_pass or is_cross) and is_success)/count(*) filter (is_pass or is_cross) else 0 end as pass_completion_pct,
 sum(case when is_defensive_action then coalesce(x,0) else 0 end)/greatest(count(*) filter (is_defensive_action),1) as defensive_height
 from fb group by all"""
cte("tms", TMS)


@query("a02_team_match_summary", "select * from tms")
def a02(t: Tables):
    return facts.team_match_summary(t.b)


@query("a03_team_style_profile", """
with m as (select nation,tier,season,team,team_key,count(distinct match_id) as match_count, avg(direct_attacks+long_balls) as direct_score,
 avg(passes) as possession_score, avg(transition_attacks) as transition_score, avg(defensive_height) as h, avg(high_regains) as r, avg(defensive_actions) as d from tms group by all),
s as (select *, h+r as press_score, greatest(0,50-h)+greatest(0,d-r) as low_block_score from m)
select nation,tier,season,team,team_key,match_count,direct_score,possession_score,transition_score,press_score,low_block_score,
 case when match_count<2 then 'low' when match_count<6 then 'medium' else 'high' end as confidence,
 case when match_count<2 then 'Low sample' when transition_score>=greatest(possession_score*0.12,direct_score) then 'Transition side'
  when possession_score>=220 and possession_score>=direct_score*8 then 'Possession side' when direct_score>=18 then 'Direct side' else 'Mixed possession/direct' end as in_possession_tag,
 case when match_count<2 then 'Low sample' when press_score>=65 then 'High press side' when low_block_score>=55 then 'Low block side' else 'Mid block side' end as out_of_possession_tag
from s""")
def a03(t: Tables):
    return facts.team_style_profile(facts.team_match_summary(t.b))


@query("a04_momentum_profile", """select match_id,team,(floor(expanded_minute/10)*10)::int as window_start,(floor(expanded_minute/10)*10+10)::int as window_end,
 count(*) as event_count, count(*) filter (is_shot) as shots, count(*) filter (box_entry) as box_entries, count(*) filter (final_third_entry) as final_third_entries,
 count(*) filter (is_shot)+count(*) filter (box_entry)+count(*) filter (final_third_entry) as danger_events from fb group by 1,2,3,4""")
def a04(t: Tables):
    return facts.momentum_windows(t.b)


cte("ts", """with g as (select nation,tier,season,match_id,team, count(*) filter (d_pass) as passes, count(*) filter (d_pass and is_success) as good_passes,
 count(*) filter (d_shot) as shots, count(*) filter (d_on_target) as shots_on_target, count(*) filter (d_goal) as goals, count(*) filter (d_cross) as crosses,
 count(*) filter (d_take_on) as take_ons, count(*) filter (d_take_on and is_success) as good_take_ons, count(*) filter (d_carry) as carries,
 count(*) filter (d_inferred) as inferred_carries, count(*) filter (d_progressive_carry) as progressive_carries,
 count(*) filter (d_carry_final_third) as carry_final_third_entries, count(*) filter (d_carry_box) as carry_box_entries,
 count(*) filter (d_final_third) as final_third_entries, count(*) filter (d_box) as box_entries, count(*) filter (d_box and not d_set_piece) as open_play_box_entries,
 count(*) filter (d_box and d_set_piece) as set_piece_box_entries, count(*) filter (d_defensive) as defensive_actions,
 count(*) filter (attacking_third_touch) as attacking_third_touches, count(*) filter (d_regain) as high_regains,
 count(*) filter (d_regain or d_final_third or d_box or d_shot) as transition_events, count(*) filter (d_set_piece) as set_piece_actions,
 count(*) filter (d_set_piece and d_shot) as set_piece_shots, count(*) filter (d_set_piece and d_goal) as set_piece_goals,
 count(*) filter (d_corner_awarded) as ca, count(*) filter (d_corner_taken) as ct, count(*) filter (d_free_kick) as free_kicks,
 count(*) filter (d_throw_in) as throw_ins, count(*) filter (d_penalty) as pt, count(*) filter (d_penalty_awarded) as pa,
 count(*) filter (d_card) as cards, count(*) filter (d_yellow) as yellow_cards, count(*) filter (d_red) as red_cards,
 count(*) filter (d_second_yellow) as second_yellows, count(*) filter (d_foul) as fouls, count(*) filter (d_interception) as interceptions,
 count(*) as rows_checked, coalesce(avg(x),0) as average_x,
 sum(case when d_shot and provider_xg is not null then least(greatest(provider_xg,0),1) end) as pxg, sum(case when d_shot then (select xg_strict from logs l where l.event_id=fd.event_id) end) as rxg
 from fd group by all)
select * exclude (ca,ct,pt,pa,pxg,rxg), case when passes>0 then 100.0*good_passes/passes else 0 end as pass_completion_pct,
 case when shots>0 then 100.0*shots_on_target/shots else 0 end as shot_accuracy_pct, case when take_ons>0 then 100.0*good_take_ons/take_ons else 0 end as take_on_success_pct,
 coalesce(pxg,rxg,0) as xg, (high_regains+0.8*final_third_entries+1.6*box_entries+2*shots+0.5*crosses)::double as transition_proxy,
 case when ca>0 then ca else ct end as corners, case when pt>0 then pt else pa end as penalties from g""")


@query("a01_team_summary", "select * from ts")
def a01(t: Tables):
    return facts.team_summary(t.d)


cte("smf", """select nation,tier,season,match_id,team,opponent,team_side,kickoff, count(*) filter (e_pass) as passes, count(*) filter (e_pass and e_success) as good_passes,
 count(*) filter (e_shot) as shots, count(*) filter (e_on_target) as on_target, count(*) filter (e_goal) as goals, count(*) filter (e_final_third) as final_third_entries,
 count(*) filter (e_box) as box_entries, count(*) filter (e_regain) as regains, count(*) filter (e_set_piece) as set_pieces, count(*) filter (e_corner) as corners,
 count(*) filter (e_free_kick) as free_kicks, count(*) filter (e_throw_in) as throw_ins, count(*) filter (e_cross) as crosses,
 count(*) filter (e_defensive) as defensive_actions, count(*) filter (e_carry) as carries, count(*) as events,
 sum(case when e_shot then least(greatest(least(greatest(1-sqrt(power(120-ex,2)+power(40-ey,2))/92.0,0.02::double),0.38::double)
  + (case when e_start_box then 0.07 else 0 end)::double + (case when e_goal then 0.18 else 0 end)::double,0.01::double),0.78::double) else 0 end) as xg from fe group by all""")
_SUMS = "passes,good_passes,shots,on_target,goals,final_third_entries,box_entries,regains,set_pieces,corners,free_kicks,throw_ins,crosses,defensive_actions,carries,events".split(",")
cte("stf", "select nation,tier,season,team,count(distinct match_id) as matches," + ",".join(f"sum({c})::bigint as {c}" for c in _SUMS) + ",sum(xg) as xg from smf group by 1,2,3,4")


@query("a05_season_match_facts", "select * from smf")
def a05(t: Tables):
    return facts.season_match_facts(t.e)


@query("a05_season_team_facts", "select * from stf")
def a05b(t: Tables):
    return facts.season_team_facts(facts.season_match_facts(t.e))


@query("a05_player_mean_locations", "select nation,tier,season,team,player,count(*) as events,avg(x) as mean_x,avg(y) as mean_y from fe group by all")
def a05c(t: Tables):
    return facts.player_mean_locations(t.e)


@query("a06_ppda_and_tilt", """
with g as (select match_id,team,opponent,count(*) filter (e_pass and e_success and x*1.2<72) as b, count(*) filter (e_defensive and x*1.2>=48) as d,
 count(*) filter (e_pass and e_success and x*1.2>=80) as f from fe group by all)
select g.match_id,g.team, case when g.d>0 then coalesce(o.b,0)/g.d::double end as ppda, case when g.f+coalesce(o.f,0)>0 then 100.0*g.f/(g.f+coalesce(o.f,0)) else 0 end as field_tilt
from g left join g o on o.match_id=g.match_id and o.team=g.opponent""")
def a06(t: Tables):
    return facts.ppda_and_tilt(t.log, t.e)


cte("pinv", """with g as (select nation,tier,season,team,player,count(*) as events,count(distinct match_id) as matches,count(*) filter (e_pass) as passes,
 count(*) filter (e_pass and e_success) as good_passes,count(*) filter (e_final_third) as final_third_entries,count(*) filter (e_box) as box_entries,
 count(*) filter (e_shot) as shots,count(*) filter (e_goal) as goals,count(*) filter (e_defensive) as defensive_actions,count(*) filter (e_regain) as regains,
 count(*) filter (e_set_piece) as set_pieces,count(*) filter (e_cross) as crosses,count(*) filter (e_carry) as carries,avg(x) as mean_x,avg(y) as mean_y from fe group by all),
 v as (select season,nation,tier,team,player,sum(xg) as xg,sum(xa) as xa,sum(xt) as xt from (select ff.season,ff.nation,ff.tier,ff.team,ff.player,l.xg,0 as xa,0 as xt from ff join logx l using(event_id) where ff.f_shot
  union all select season,nation,tier,team,player,0,xg,0 from assist where role='assist' union all select season,nation,tier,team,player,0,0,league_xt_added from pv where f_move) u group by 1,2,3,4,5),
 h as (select g.*, coalesce(v.xg,0)::double as xg,coalesce(v.xa,0)::double as xa,coalesce(v.xt,0)::double as xt from g left join v using(nation,tier,season,team,player)),
 s as (select *, (0.08*events+1.15*final_third_entries+1.65*box_entries+2.05*shots+4*goals+0.55*defensive_actions+1.35*regains+0.35*set_pieces+1.6*xg+1.6*xa+1.25*xt)::double as score from h)
 select *, row_number() over (partition by nation,tier,season,team order by round(score,6) desc, player)::int as rank from s""")


@query("a10_player_involvement", "select * from pinv", trained=True)
def a10(t: Tables):
    return t.involvement
