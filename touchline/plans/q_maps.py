"""Match maps, series, set pieces and defence."""

from pyspark.sql import functions as F

from touchline.functions import geometry, shots
from touchline.functions.flags import with_flags
from touchline.operators import defence, links, maps, momentum, setpieces
from touchline.operators.topk import top_per_group
from touchline.plans.oracle_base import cte
from touchline.plans.registry import Tables, query

_SH = lambda c, k="match_id,team": f"case when sum({c}) over (partition by {k})>0 then 100.0*{c}/sum({c}) over (partition by {k}) else 0 end"

cte("edges", """select r.match_id,r.team,r.player,v.receiver,count(*) as passes,avg(x) as start_x,avg(y) as start_y,avg(end_x) as receive_x,avg(end_y) as receive_y,sum(positive_xt) as xt,
 count(*) filter (end_x-x>=10) as progressive,count(*) filter (final_third_entry) as final_third_entries,count(*) filter (box_entry) as box_entries,count(*) filter (is_cross) as crosses
 from runs r join recv v using(match_id,event_index) where is_success and not is_set_piece and x is not null and y is not null group by 1,2,3,4""")


@query("a11_pass_edges", "select * from (select *, row_number() over (partition by match_id,team order by passes desc,player,receiver)::int as pos from edges)")
def a11(t: Tables):
    return maps.pass_edges(t.valued)


@query("a11_pass_nodes", """with u as (select match_id,team,player,passes as made,0 as received,start_x*passes as sx,start_y*passes as sy,xt from edges union all select match_id,team,receiver,0,passes,receive_x*passes,receive_y*passes,0 from edges),
 g as (select match_id,team,player,sum(made)::bigint as made,sum(received)::bigint as received,sum(xt) as xt,sum(sx)/sum(made+received) as x,sum(sy)/sum(made+received) as y,sum(made+received)::bigint as involvement from u group by 1,2,3)
 select * from (select *, row_number() over (partition by match_id,team order by involvement desc,player)::int as pos from g)""")
def a11b(t: Tables):
    return maps.pass_nodes(t.valued)


def _grid(src: str, keys: str, x: str, y: str, weight: str = "") -> str:
    val = f"sum(greatest(coalesce({weight},0),0))" if weight else "count(*)::double"
    return f"""with c as (select *, least(greatest({x},0),99.999)::double as gx, least(greatest({y},0),99.999)::double as gy from {src} where {x} is not null and {y} is not null),
 w as (select *, min(gx) over (partition by {keys}) as nx,max(gx) over (partition by {keys}) as mx,min(gy) over (partition by {keys}) as ny,max(gy) over (partition by {keys}) as my from c)
 select {keys},case when mx>nx then least(floor((gx-nx)*6/(mx-nx)),5)::int else 0 end as x_bin,case when my>ny then least(floor((gy-ny)*5/(my-ny)),4)::int else 0 end as y_bin,count(*) as count,{val} as value from w group by all"""


cte("touches", "select * from fc where is_touch")


@query("a12_touch_grid", _grid("touches", "match_id,team", "x", "y"))
def a12(t: Tables):
    return maps.data_grid(t.c.where("is_touch"), ["match_id", "team"], "x", "y")


cte("moves_", "select * from pv where f_move")


@query("a13_weighted_heat", _grid("moves_", "match_id,team", "end_x", "end_y", "positive_xt"))
def a13(t: Tables):
    return maps.data_grid(t.valued.where("(f_pass or f_carry) and f_success and zone_start >= 0 and zone_end >= 0"), ["match_id", "team"], "end_x", "end_y", weight="positive_xt")


@query("a14_fixed_grid", "select nation,tier,season,team,greatest(least(floor(x*12/100),11),0)::int as x_bin,greatest(least(floor(y*8/100),7),0)::int as y_bin,count(*) as count from log where x is not null and y is not null group by all")
def a14(t: Tables):
    return maps.fixed_grid(t.log, ["nation", "tier", "season", "team"])


_L3 = "case when {0}<33.333 then 'left' when {0}<66.667 then 'central' else 'right' end"


@query("a15_attack_direction", f"""with f as (select *, ((is_pass or is_cross or is_carry) and is_success) as pg from fc),
 g as (select *, case when pg and end_x is not null then end_x else x end as lx, case when pg and end_y is not null then end_y else y end as ly from f where (pg and (coalesce(x>=45,false) or coalesce(end_x>=45,false) or final_third_entry or box_entry or attacking_third_touch)) or is_shot),
 h as (select match_id,team,{_L3.format('ly')} as lane,count(*) as count,sum(1+1.2*final_third_entry::int+2.2*box_entry::int+2.8*is_shot::int+4*is_goal::int)::double as weight,avg(lx) as mean_x,avg(ly) as mean_y from g where ly is not null group by all)
 select *, {_SH('weight')} as share, row_number() over (partition by match_id,team order by round(weight,6) desc,lane)::int as rank from h""")
def a15(t: Tables):
    return maps.attack_direction(t.c)


_L3N = "case when {0} is null then 'unknown' when {0}<33.333 then 'left' when {0}<66.667 then 'central' else 'right' end"


@query("a16_threat_lanes", f"""with l as (select match_id,team,case when is_shot then {_L3N.format('y')} else {_L3N.format('coalesce(end_y,y)')} end as lane,xg+positive_xt as v from pv),
 g as (select match_id,team,x.lane,coalesce(sum(v) filter (l.lane=x.lane),0) as threat from l, (values ('left'),('central'),('right')) x(lane) group by all)
 select *, {_SH('threat')} as share, row_number() over (partition by match_id,team order by round(threat,9) desc,lane)::int as rank from g""")
def a16(t: Tables):
    return maps.threat_lanes(t.valued)


@query("a17_lane_kpis", f"""with g as (select nation,tier,season,team,case when ey<80/3.0::double then 'left' when ey<=160/3.0::double then 'central' else 'right' end as lane,count(*) as count,count(*) filter (e_final_third) as final_third_entries,
 count(*) filter (e_box) as box_entries,count(*) filter (e_shot) as shots,count(*) filter (e_goal) as goals,count(*) filter (e_cross) as crosses,count(*) filter (e_pass and e_success) as good_passes from fe where e_move or e_shot group by all)
 select *, {_SH('count','nation,tier,season,team')} as share from g""")
def a17(t: Tables):
    return maps.lane_kpis(t.e)


_PROG = "(is_pass or is_cross or is_carry) and is_success and x is not null and y is not null and end_x is not null and end_y is not null"
_L5 = "case when {0} is null then 'unknown' when {0}<18 then 'left_wide' when {0}<38 then 'left_half_space' when {0}<=62 then 'central' when {0}<=82 then 'right_half_space' else 'right_wide' end"


def _lanes(family: bool) -> str:
    lane = "case when lane in ('left_wide','right_wide') then 'wide' when lane like '%half%' then 'half_space' else lane end" if family else "lane"
    return f"""with i as (select match_id,opponent as team,{_L5.format('end_y')} as lane,final_third_entry::int as ft,box_entry::int as bx,0 as sh,0 as gl from prep where {_PROG} and (final_third_entry or box_entry)
  union all select match_id,opponent,{_L5.format('y')},0,0,1,is_goal::int from prep where is_shot),
 g as (select match_id,team,{lane} as lane,sum(ft)::bigint as final_third_entries,sum(bx)::bigint as box_entries,sum(sh)::bigint as shots,sum(gl)::bigint as goals from i where lane<>'unknown' group by 1,2,3)
 select *, {_SH('final_third_entries')} as final_third_entries_share,{_SH('box_entries')} as box_entries_share,{_SH('shots')} as shots_share from g"""


@query("a18_lane_protection", _lanes(False))
def a18(t: Tables):
    return defence.lane_protection(t.prep)


@query("a18_lane_family_protection", _lanes(True))
def a18b(t: Tables):
    return defence.lane_protection(t.prep, family=True)


@query("a19_threat_boxes", f"""with s as (select p.match_id,p.team,coalesce(o.oex,o.ox,p.x) as px,coalesce(o.oey,o.oy,p.y) as py,0::double as xt,p.xg from pv p left join orig o using(match_id,event_index) where p.is_shot),
 u as (select match_id,team,end_x as px,end_y as py,positive_xt as xt,0::double as xg from pv where {_PROG} union all select * from s),
 c as (select match_id,team,(least(floor(py*3/100),2)*7+least(floor(px*7/100),6))::int as cell,count(*) as actions,sum(xt) as xt_created,sum(xg) as attributed_xg from u where px is not null and py is not null group by all),
 g as (select m.match_id,m.team,k.cell,coalesce(actions,0) as actions,coalesce(xt_created,0) as xt_created,coalesce(attributed_xg,0) as attributed_xg from (select distinct match_id,team from c) m cross join (select unnest(range(21))::int as cell) k left join c using(match_id,team,cell)),
 h as (select *, xt_created+attributed_xg as threat from g), r as (select *, {_SH('threat')} as share, row_number() over (partition by match_id,team order by round(threat,9) desc,cell)::int as rank from h)
 select *, rank<=5 and threat>0 as top_box from r""")
def a19(t: Tables):
    return maps.threat_boxes(t.valued)


@query("a20_chain_funnel", """with c as (select match_id,team,attack_chain_id,bool_or(coalesce(x>=33.33,false) or coalesce(end_x>=33.33,false)) as m,bool_or(final_third_entry or coalesce(x>=66.67,false) or coalesce(end_x>=66.67,false)) as f,
  bool_or(box_entry or start_in_box or end_in_box or coalesce(end_x>=83 and end_y between 21.1 and 78.9,false)) as b,bool_or(is_shot) as s,bool_or(is_goal) as g,count(*) filter (is_shot) as ns,count(*) filter (is_goal) as ng from ochains group by all),
 o as (select match_id,team,count(*) as attacks,count(*) filter (m) as reached_middle,count(*) filter (f) as reached_final,count(*) filter (b) as entered_box,count(*) filter (s) as chains_with_shots,count(*) filter (g) as chains_with_goals,sum(ns)::bigint as shots,sum(ng)::bigint as goals from c group by all)
 select *,100.0*reached_final/attacks as final_third_rate,100.0*entered_box/attacks as box_rate,case when entered_box>0 then 100.0*chains_with_shots/entered_box else 0 end as shot_from_box_rate,case when chains_with_shots>0 then 100.0*chains_with_goals/chains_with_shots else 0 end as goal_from_shot_rate,100.0*(attacks-reached_final)/attacks as early_stop_rate from o""")
def a20(t: Tables):
    return defence.chain_funnel(t.prep)


@query("a21_event_funnel", """with g as (select nation,tier,season,opponent as team,count(*) filter (e_move) as attacks,count(*) filter (e_final_third) as final_third,count(*) filter (e_box) as box,count(*) filter (e_shot) as shots,count(*) filter (e_goal) as goals from fe group by 1,2,3,4)
 select *,greatest(attacks-final_third,0) as stopped_before_final_third,greatest(final_third-box,0) as stopped_before_box,greatest(box-shots,0) as stopped_before_shot,greatest(shots-goals,0) as stopped_before_goal from g""")
def a21(t: Tables):
    return defence.event_funnel(t.e)


cte("duel", f"select *, regexp_matches(type_c||outcome_c||qual_c,'aerial|headed|header') as aerial, is_success as won, {_L5.format('y')} as lane from prep where is_defensive_action and regexp_matches(type_c||outcome_c||qual_c,'duel|aerial|challenge|tackle')")


def _duel(by: str) -> str:
    return f"""select match_id,team{by},count(*) as duels,count(*) filter (won) as won,count(*) filter (aerial) as aerial,count(*) filter (aerial and won) as aerial_won,count(*) filter (not aerial) as ground,count(*) filter (not aerial and won) as ground_won,
 count(*) filter (not won) as lost,100.0*count(*) filter (won)/count(*) as win_rate from duel group by all"""


@query("p29_duel_rows", "select match_id,event_index,aerial,won,lane from duel")
def p29(t: Tables):
    return defence.duels(t.prep).select("match_id", "event_index", "aerial", "won", "lane")


@query("a22_duel_control", _duel(""))
def a22(t: Tables):
    return defence.duel_control(t.prep, [])


@query("a22_duels_by_player", _duel(",player"))
def a22b(t: Tables):
    return defence.duel_control(t.prep, ["player"])


@query("a22_duels_by_lane", _duel(",lane"))
def a22c(t: Tables):
    return defence.duel_control(t.prep, ["lane"])


@query("a23_disruption", f"""with g as (select match_id,team,count(*) filter (is_defensive_action and x>=66.67) as high,count(*) filter (is_defensive_action and x>=33.33 and x<66.67) as middle,count(*) filter (is_defensive_action and x<33.33) as low,avg(x) filter (is_defensive_action) as mean_height,
 count(*) filter (high_regain) as high_regains,count(*) filter ({_PROG}) as pr,count(*) filter ({_PROG} and end_x<x) as wb,count(*) filter ({_PROG} and end_x<=x+3) as rc from prep group by all)
 select g.match_id,g.team,g.high,g.middle,g.low,g.mean_height,g.high_regains,o.wb as forced_back,o.rc as recycled,case when o.pr>0 then 100.0*o.wb/o.pr else 0 end as forced_back_share,l.regains_after_loss
 from g join g o on o.match_id=g.match_id and o.team<>g.team left join ral l on l.match_id=g.match_id and l.team=g.team""")
def a23(t: Tables):
    return defence.disruption(t.prep)


@query("a24_height_profile", f"""with e as (select match_id,team,count(*) as en,count(*) filter (led_to_shot) as es from bea group by all),
 g as (select p.match_id,p.team,count(*) filter (is_defensive_action and x is not null) as actions,avg(x) filter (is_defensive_action) as mean_x,count(*) filter (is_defensive_action and x<33.33) as deep,count(*) filter (is_defensive_action and x>=66.67) as high,
  sum(case when {_PROG} then positive_xt else 0 end) as xt,sum(case when {_PROG} and end_y>=18 and end_y<=82 then positive_xt else 0 end) as cxt,count(*) filter (is_shot) as shots,coalesce(any_value(e.en),0) as en,coalesce(any_value(e.es),0) as es from pv p left join e using(match_id,team) group by 1,2),
 j as (select a.match_id,a.team,a.actions,a.mean_x,case when a.actions>0 then 100.0*a.deep/a.actions else 0 end as deep_share,case when a.actions>0 then 100.0*a.high/a.actions else 0 end as high_share,case when o.xt>0 then 100.0*o.cxt/o.xt else 0 end as central_share,case when o.en>0 then 100.0*o.es/o.en else 0 end as entry_shot_rate,o.xt as xt_allowed,o.en as entries_allowed,o.shots as os from g a join g o on o.match_id=a.match_id and o.team<>a.team)
 select * exclude (os), case when actions=0 then 'No clear block profile' when mean_x<38 and entry_shot_rate<=32 and central_share<=42 then 'Deep compact block' when mean_x<38 then 'Deep pressure survival' when mean_x<58 and entry_shot_rate<=38 and central_share<=45 then 'Mid block control' when mean_x<58 then 'Mid block exposed' when high_share>=35 and entries_allowed<=greatest(4,os*2) then 'High disruption profile' when high_share>=35 then 'High press exposed behind' else 'Unclear mixed profile' end as block_label from j""")
def a24(t: Tables):
    return defence.height_profile(t.valued)


def _block(by: str) -> str:
    return f"""select match_id,team{by},count(*) as actions,avg(x) as mean_x,avg(y) as mean_y,quantile_cont(x,0.75)-quantile_cont(x,0.25) as spread_x,quantile_cont(y,0.75)-quantile_cont(y,0.25) as spread_y,count(*) filter (x<33.33) as low,count(*) filter (x>=33.33 and x<66.67) as middle,count(*) filter (x>=66.67) as high,min(expanded_minute) as first_minute,max(expanded_minute) as last_minute
 from prep where is_defensive_action and x is not null and y is not null group by all"""


@query("a25_block_map", _block(""))
def a25(t: Tables):
    return defence.block_map(t.prep)


@query("a25_block_map_players", _block(",player"))
def a25b(t: Tables):
    return defence.block_map(t.prep, by_player=True)


_CAT = """case when type_c like '%interception%' then 'Interceptions' when type_c like '%tackle%' or type_c like '%challenge%' then 'Tackles and challenges' when type_c like '%clearance%' then 'Clearances' when type_c like '%block%' then 'Blocks' when type_c like '%recovery%' then 'Recoveries'
 when type_c like '%aerial%' or type_c like '%duel%' then 'Duels' when type_c like '%foul%' then 'Fouls' else 'Other defensive actions' end"""
cte("dcat", f"select *, {_CAT} as category from prep where is_defensive_action")


@query("p28_defensive_category", "select match_id,event_index,category from dcat")
def p28(t: Tables):
    return t.prep.where("is_defensive_action").select("match_id", "event_index", F.expr(defence.CATEGORY).alias("category"))


@query("a26_category_audit", f"select *, {_SH('count')} as share from (select match_id,team,category,count(*) as count,count(*) filter (is_success) as good from dcat group by all)")
def a26(t: Tables):
    return defence.category_audit(t.prep)


cte("dlead", """with g as (select match_id,team,player,count(*) as actions,count(*) filter (category in ('Interceptions','Recoveries')) as interceptions_recoveries,count(*) filter (category='Tackles and challenges' and is_success) as tackles_won,count(*) filter (high_regain) as high_regains,count(*) filter (category='Blocks') as blocks,count(*) filter (category='Clearances' and start_in_box) as box_clearances from dcat group by all),
 s as (select *, (0.4*actions+1.4*interceptions_recoveries+1.5*tackles_won+2*high_regains+2.2*blocks+1.5*box_clearances)::double as score from g) select *, row_number() over (partition by match_id,team order by round(score,6) desc,player)::int as pos from s""")


@query("a27_defensive_leaders", "select * from dlead")
def a27(t: Tables):
    return defence.leaders(t.prep)


# ------------------------------------------------------------------ series

cte("mins", """select match_id,unnest(range(1,n+1))::int as minute from (select match_id,greatest(90,ceil(max(expanded_minute)))::int as n from prep group by 1)""")
cte("mom", """with e as (select *, (8*is_goal::int+4*is_shot::int+6*case when is_shot then coalesce(provider_xg,0) else 0 end+3*box_entry::int+1.35*final_third_entry::int+0.65*is_cross::int+0.9*high_regain::int+0.12*attacking_third_touch::int)::double as w, least(positive_xt,0.12) as cx from pv),
 j as (select m.match_id,m.minute,e.team_side as s,e.w*exp(-(m.minute-e.expanded_minute)/4) as wp,e.cx*34*exp(-(m.minute-e.expanded_minute)/4) as xp from mins m left join e on e.match_id=m.match_id and e.expanded_minute<=m.minute and e.expanded_minute>=greatest(0,m.minute-10)),
 g as (select match_id,minute,coalesce(sum(wp) filter (s='home'),0) as home_pressure,coalesce(sum(wp) filter (s='away'),0) as away_pressure,coalesce(sum(xp) filter (s='home'),0) as home_xt,coalesce(sum(xp) filter (s='away'),0) as away_xt from j group by 1,2)
 select *, home_pressure+home_xt as home, away_pressure+away_xt as away, home_pressure+home_xt-away_pressure-away_xt as net from g""")


@query("w06_rolling_momentum", "select * from mom")
def w06(t: Tables):
    return momentum.rolling_momentum(t.valued)


@query("w11_rolling_possession", """with b as (select * from prep where is_touch or is_pass or is_cross or is_carry or is_take_on or is_shot),
 j as (select m.match_id,m.minute,count(*) filter (b.team_side='home') as h,count(*) filter (b.team_side='away') as a from mins m left join b on b.match_id=m.match_id and b.expanded_minute between greatest(0,m.minute-3) and m.minute group by 1,2),
 l as (select m.match_id,m.minute,arg_max(b.team_side,b.expanded_minute*1000000+b.event_index) as known from mins m left join b on b.match_id=m.match_id and b.expanded_minute<=m.minute group by 1,2),
 k as (select match_id,minute,case when h+a=0 then (known='home')::bigint else h end as home_events,case when h+a=0 then (known='away')::bigint else a end as away_events,case when h+a=0 then coalesce(known,'none') when abs(h-a)<=1 then 'even' when h>a then 'home' else 'away' end as dominant_side from j join l using(match_id,minute))
 select match_id,minute,coalesce(home_events,0) as home_events,coalesce(away_events,0) as away_events,dominant_side,100.0*coalesce(home_events,0)/greatest(coalesce(home_events,0)+coalesce(away_events,0),1) as home_share from k""")
def w11(t: Tables):
    return momentum.rolling_possession(t.prep)


@query("w22_peak_windows", """with r as (select match_id,minute,net,row_number() over (partition by match_id order by round(net,9) desc,minute) as k from mom), a as (select * from r where k=1),
 b as (select r.*, row_number() over (partition by r.match_id order by r.k) as j from r join a on a.match_id=r.match_id and abs(r.minute-a.minute)>=6), b1 as (select * from b where j=1),
 c as (select r.*, row_number() over (partition by r.match_id order by r.k) as j from r join a on a.match_id=r.match_id and abs(r.minute-a.minute)>=6 join b1 on b1.match_id=r.match_id and abs(r.minute-b1.minute)>=6)
 select match_id,1 as rank,minute,net as value from a union all select match_id,2,minute,net from b1 union all select match_id,3,minute,net from c where j=1""")
def w22(t: Tables):
    return momentum.spaced_windows(momentum.rolling_momentum(t.valued), "net")


_MP = """select match_id,'{s}' as side,100.0*count(*) filter ({g}net>0)/count(*) as control,max({g}net) as peak,min({g}net) as trough,avg({g}net) filter (minute<=30) as early,avg({g}net) filter (minute>30 and minute<=60) as middle,avg({g}net) filter (minute>60) as late from mom group by 1"""


@query("a55_momentum_profile", _MP.format(s="home", g="") + " union all " + _MP.format(s="away", g="-"))
def a55(t: Tables):
    return momentum.momentum_profile(momentum.rolling_momentum(t.valued))


_BK = "case when minute<=15 then '0-15' when minute<=30 then '16-30' when minute<=45 then '31-45' when minute<=60 then '46-60' when minute<=75 then '61-75' when minute<=90 then '76-90' else '90+' end"


@query("p43_minute_bucket", f"select event_id, {_BK.replace('minute','expanded_minute')} as bucket from log")
def p43(t: Tables):
    return t.log.select("event_id", F.expr(momentum.bucket("expanded_minute")).alias("bucket"))


@query("a56_momentum_buckets", f"select match_id,{_BK} as bucket,avg(home) as home,avg(away) as away,avg(net) as net,count(*) as minutes from mom group by 1,2")
def a56(t: Tables):
    return momentum.momentum_buckets(momentum.rolling_momentum(t.valued))


# ------------------------------------------------------------------ chains

cte("pchain", """with b as (select * from pv where (is_pass or is_cross or is_carry or is_take_on or is_shot or box_entry) and x is not null and y is not null),
 p as (select *, lag(period) over w as pp,lag(clock_s) over w as pc from b window w as (partition by match_id,team order by period,expanded_minute,event_index)),
 c as (select *, sum(case when pp is null or pp<>period or clock_s-pc<0 or clock_s-pc>10 then 1 else 0 end) over (partition by match_id,team order by period,expanded_minute,event_index)::bigint as chain_id from p),
 o as (select *, expanded_minute*100000+event_index as k from c),
 g as (select match_id,team,chain_id,count(*) as actions,count(distinct player) as players,arg_min(x,k) as start_x,arg_min(y,k) as start_y,arg_max(coalesce(end_x,x),k) as end_x,arg_max(coalesce(end_y,y),k) as end_y,max(clock_s)-min(clock_s) as duration,sum(xg) as xg,sum(xt_added) as xt_added,
  bool_or(is_shot) as s,bool_or(is_goal) as gg,bool_or(box_entry) as bb,arg_max((is_pass or is_cross or is_carry or is_take_on) and not is_success,k) as lost from o group by all)
 select * exclude (s,gg,bb,lost), case when gg then 'Goal' when s then 'Shot' when bb then 'Box entry' when lost then 'Failed progression' else 'Retained progression' end as outcome from g where actions>=2 or s or bb""")


@query("w19_possession_chains", "select * from pchain")
def w19(t: Tables):
    return maps.possession_chains(t.valued)


@query("w19_chain_lists", """with l as (select *, unnest(list_filter(['best',case when actions>=7 or duration>=25 then 'long_build_up' end,case when duration<=15 and end_x-start_x>=25 then 'direct' end,case when outcome='Failed progression' then 'failed' end,case when outcome in ('Shot','Goal') then 'shot' end,case when outcome in ('Box entry','Shot','Goal') then 'box' end], lambda z: z is not null)) as list from pchain),
 r as (select *, row_number() over (partition by match_id,team,list order by round(xg+greatest(0,xt_added),9) desc,actions desc,chain_id)::int as pos from l) select * from r""")
def w19b(t: Tables):
    return maps.chain_lists(t.valued)


@query("a50_match_value_breakdown", f"select *, {_SH('positive_xt')} as share from (select match_id,team,action_type,count(*) as actions,sum(positive_xt) as positive_xt,sum(xt_added) as xt_added from pv where f_move and not f_set_piece group by all)")
def a50(t: Tables):
    return maps.match_value_breakdown(t.valued)


_MM = "f_move and not f_set_piece"


@query("a50_match_action_mix", f"select *, {_SH('positive_xt')} as share from (select match_id,team,action_type,count(*) as actions,sum(positive_xt) as positive_xt,sum(xt_added) as xt_added from mpv where {_MM} group by all)")
def a50_mix(t: Tables):
    return maps.match_value_breakdown(t.match_valued)


@query("a50_match_top_actions", f"""select * from (select match_id,team,event_index,expanded_minute,player,action_type,least(greatest(x,0),100) as x,least(greatest(y,0),100) as y,least(greatest(end_x,0),100) as end_x,least(greatest(end_y,0),100) as end_y,positive_xt,
 row_number() over (partition by match_id,team order by round(positive_xt,9) desc,event_index)::int as pos from mpv where {_MM} and positive_xt>0) where pos<=35""")
def a50_actions(t: Tables):
    return maps.top_actions(t.match_valued)


@query("a50_match_top_players", f"""select * from (select *, row_number() over (partition by match_id,team order by round(total_xt,9) desc,player)::int as pos from (
 select match_id,team,player,sum(positive_xt) as total_xt,count(*) as actions from mpv where {_MM} group by all) where round(total_xt,9)>0) where pos<=8""")
def a50_players(t: Tables):
    return maps.top_players(t.match_valued)


@query("k02_capped_touch_points", "select * from (select match_id,team,event_index,x,y,row_number() over (partition by match_id,team order by period,expanded_minute,event_index)::int as pos from fc where is_touch and x is not null)")
def k02(t: Tables):
    return maps.touch_points(t.c).select("match_id", "team", "event_index", "x", "y", "pos")


# shot sequences by walking back with a join: rows with as many cuts before them as the shot
cte("sseq", """with r as (select *, ((regexp_matches(type_c,'start|end|substitution|formation|card|foul|offside|clearance') or regexp_matches(outcome_c,'unsuccessful|inaccurate|lost|offside')) and not is_set_piece) as brk from runs),
 l as (select *, lag(clock_s) over w as pc, lag(brk) over w as pb from r window w as (partition by match_id,run_id order by pos)),
 k as (select *, sum(coalesce(clock_s-pc>15 or pb,false)::int) over (partition by match_id,run_id order by pos) as cuts from l),
 c as (select s.match_id,s.event_index as sidx,s.team,s.pos as sp,s.is_set_piece as sset,s.xg as sxg,s.is_goal as sgoal,s.clock_s as sclk,b.* exclude (match_id,team) from k s join k b on b.match_id=s.match_id and b.run_id=s.run_id and b.cuts=s.cuts and b.pos<s.pos and b.pos>=s.pos-9 where s.is_shot),
 m as (select *, max(case when is_set_piece then pos end) over (partition by match_id,sidx) as lastset from c),
 f as (select * from m where not (sset and lastset is not null and pos<lastset)),
 g as (select match_id,sidx,count(*) as n,coalesce(sum(positive_xt) filter (not is_shot),0) as pre,min(clock_s) as c0,bool_or(is_set_piece) as anyset,bool_or(regexp_matches(type_c,'rebound|block|clearance|aerial')) as sb,arg_max(type_c,pos) as lt,arg_max(coalesce(x,0),pos) as lx,arg_max(coalesce(end_x,x,0),pos) as lex,arg_max(coalesce(y,50),pos) as ly,arg_max(coalesce(end_y,y,50),pos) as ley,
   count(*) filter (x is not null and end_x is not null) as nl,count(*) filter (x is not null and end_x is not null and coalesce(end_y,y)>=18 and coalesce(end_y,y)<=82) as nc,arg_max(x,pos) filter (x is not null) as ox,arg_max(y,pos) filter (x is not null) as oy from f group by all)
 select s.match_id,s.event_index,s.team,s.is_goal,s.is_set_piece,s.xg,coalesce(g.n,0)+1 as action_count,coalesce(g.pre,0) as pre_shot_xt,coalesce(g.pre,0)+s.xg as threat,s.clock_s,s.type_c,s.x,s.y,s.end_x,s.end_y,s.expanded_minute,g.* exclude (match_id,sidx,n,pre)
 from runs s left join g on g.match_id=s.match_id and g.sidx=s.event_index where s.is_shot""")


@query("w09_shot_sequences", "select match_id,event_index,team,action_count::int as action_count,pre_shot_xt,threat,is_set_piece from sseq")
def w09(t: Tables):
    return maps.shot_sequences(t.valued).select("match_id", "event_index", "team", "action_count", "pre_shot_xt", "threat", "is_set_piece")


_FAM = "case when {0}<18 or {0}>82 then 'wide' when {0}<38 or {0}>62 then 'half_space' else 'central' end"
cte("dtag", f"""with q as (select *, {_FAM.format('ly')} as sf, {_FAM.format('ley')} as ef, coalesce(nl,0)+(x is not null and end_x is not null)::int as tl, coalesce(nc,0)+(x is not null and end_x is not null and end_y>=18 and end_y<=82)::int as tc2 from sseq)
 select match_id,event_index,team,case when is_set_piece or coalesce(anyset,false) then 'Set piece' when coalesce(sb,false) or regexp_matches(type_c,'rebound|block|clearance|aerial') then 'Second ball' when lt is not null and regexp_matches(lt,'carry|dribble|takeon|run') then 'Individual carry'
  when lt like '%cross%' and sf='wide' then 'Cross from wide' when lt is not null and sf in ('wide','half_space') and ef='central' and lex>=83 then 'Cutback or low cross' when lt is not null and lex-lx>=30 then 'Direct ball' when tl>0 and tc2>=greatest(1,tl/2.0) then 'Central access'
  when action_count<=4 and clock_s-coalesce(c0,clock_s)<=10 then 'Transition' when lt is not null and sf='wide' then 'Wide overload' else 'Other' end as tag from q""")


@query("p48_danger_tags", "select * from dtag")
def p48(t: Tables):
    return maps.danger_tags(maps.shot_sequences(t.valued)).select("match_id", "event_index", "team", "tag")


@query("k03_ordered_sequences", """select match_id,event_index,team,is_goal,threat,pos from (select *, row_number() over (partition by match_id order by is_goal desc,round(threat,9) desc,expanded_minute,event_index)::int as pos from sseq)""")
def k03(t: Tables):
    df = maps.shot_sequences(t.valued)
    order = [F.desc("is_goal"), F.round("threat", 9).desc(), F.col("expanded_minute"), F.col("event_index")]
    return top_per_group(df, ["match_id"], order).select("match_id", "event_index", "team", "is_goal", "threat", "pos")


cte("hlayers", """select match_id,team,'shots' as layer,x as hx,y as hy,xg as weight from pv where is_shot and x is not null union all
 select match_id,team,'box_shots',x,y,xg from pv where is_shot and start_in_box union all select match_id,team,'goals',x,y,xg from pv where is_goal and x is not null union all
 select match_id,team,'chance_origins',coalesce(ox,x),coalesce(oy,y),pre_shot_xt from sseq where coalesce(ox,x) is not null union all select match_id,team,'box_entries',end_x,end_y,positive_xt from bea""")


@query("a63_danger_heat", _grid("hlayers", "match_id,team,layer", "hx", "hy", "weight"))
def a63(t: Tables):
    return maps.visible_heat(t.valued, maps.shot_sequences(t.valued))


# ------------------------------------------------------------------ set pieces

_TX = "(type_c||outcome_c||qual_c)"
cte("rest", f"""select *, case when is_penalty then true when is_corner then not is_shot and ((is_pass or is_cross or is_carry) or {_TX} like '%corner%') when is_free_kick then true when is_throw_in then not is_shot and ((is_pass or is_cross or is_carry) or {_TX} like '%throw%') else false end as is_restart,
 case when is_penalty then 'Penalty' when is_corner then 'Corner' when is_free_kick then case when is_shot or {_TX} like '%direct%' or {_TX} like '%shot%' then 'Direct free kick' when x>=55 then 'Wide free kick' else 'Free kick' end when is_throw_in then case when x>=66.67 then 'Final third throw in' else 'Throw in' end else 'Set piece' end as restart_type from pvp""")


@query("p46_restart_type", "select match_id,event_index,is_restart,restart_type from rest")
def p46(t: Tables):
    return setpieces.with_restarts(t.prep).select("match_id", "event_index", "is_restart", "restart_type")


cte("sprow", """with h as (select *, regexp_matches(type_c||outcome_c,'start|end|substitution|formation|card|foul|offside|period') and not is_set_piece as halt from rest),
 j as (select s.pos as sp,s.event_index as sidx,s.team as steam,s.clock_s as sc,s.period as sper,n.*, n.pos-s.pos+1 as step from h s join h n on n.match_id=s.match_id and n.period=s.period and n.pos>=s.pos and n.clock_s-s.clock_s<=20 and n.pos<=s.pos+13 where s.is_restart)
 select j.* from j where not exists(select 1 from h z where z.match_id=j.match_id and z.pos>j.sp and z.pos<=j.pos and z.is_restart) and not exists(select 1 from h z where z.match_id=j.match_id and z.pos>j.sp and z.pos<j.pos and z.halt)""")
cte("spseq", """with m as (select *, step>1 and (is_touch or is_pass or is_cross or is_carry or is_shot or is_defensive_action) as meant from sprow),
 r as (select *, row_number() over (partition by match_id,sidx,meant order by pos) as mn from m),
 g as (select match_id,sidx,any_value(steam) as team,any_value(sper) as period,arg_min(opponent,pos) as opponent,arg_min(player,pos) as taker,arg_min(restart_type,pos) as restart_type,
  any_value(x) filter (step=1) as start_x,any_value(y) filter (step=1) as start_y,any_value(end_x) filter (step=1) as end_x,any_value(end_y) filter (step=1) as end_y,
  max(team) filter (meant and mn=1) as fct,max(player) filter (meant and mn=1) as fcp,max(team) filter (meant and mn=2) as sbt,arg_min(player,pos) filter (team=steam and is_shot) as shp,bool_or(team=steam and is_shot) as led_to_shot,bool_or(team=steam and is_goal) as led_to_goal,
  bool_or(team<>steam and (is_defensive_action or regexp_matches(type_c||outcome_c||qual_c,'clearance|block'))) as cleared_or_blocked,count(*) as action_count,arg_max(type,pos) as final_type,
  arg_min(player,pos) filter (team<>steam and type_c like '%clearance%') as clp,arg_min(player,pos) filter (team<>steam and type_c like '%block%') as blp from r group by 1,2)
 select *, coalesce(fct=team,false) as first_contact_won, coalesce(sbt=team,false) as second_ball_retained from g""")


@query("w10_set_piece_sequences", "select match_id,sidx as event_index,team,taker,restart_type,first_contact_won,second_ball_retained,led_to_shot,led_to_goal,cleared_or_blocked,action_count,final_type from spseq")
def w10(t: Tables):
    return setpieces.sequences_(t.prep).select("match_id", "event_index", "team", "taker", "restart_type", "first_contact_won", "second_ball_retained", "led_to_shot", "led_to_goal", "cleared_or_blocked", "action_count", "final_type")


_ZL = f"""case when end_x is null or end_y is null then 'Unknown zone' when end_x>=83 and end_y between 21.1 and 78.9 then case when end_y<18 or end_y>82 then 'Wide box' when end_y<38 or end_y>62 then 'Half space box' else 'Central box' end
 when end_x>=66.67 then 'Final third '||replace({_L5.format('end_y')},'_',' ') when end_x>=33.33 then 'Middle third '||replace({_L5.format('end_y')},'_',' ') else 'Deep '||replace({_L5.format('end_y')},'_',' ') end"""
cte("rout", f"""with b as (select *, coalesce(end_x>=83 and end_y between 21.1 and 78.9,false) as bx, case when start_x is null or start_y is null then 0 else sqrt(power(coalesce(end_x,start_x)-start_x,2)+power(coalesce(end_y,start_y)-start_y,2)) end as distance, {_ZL} as target_zone from spseq),
 p as (select *, case when start_y is null or end_x is null or end_y is null then 'unknown' when not bx then 'outside box' when end_y between 39 and 61 then 'central box' when start_y<=50 then case when end_y<=39 then 'near post' else 'far post' end else case when end_y>=61 then 'near post' else 'far post' end end as post_target from b)
 select *, case restart_type when 'Penalty' then 'Penalty' when 'Direct free kick' then 'Direct free kick shot' when 'Corner' then case when distance<=12 then 'Short corner' when bx then 'Corner to '||post_target else 'Corner recycled outside box' end
  when 'Wide free kick' then case when bx then 'Wide free kick to '||post_target when distance<=10 then 'Short wide free kick' else 'Wide free kick recycled outside box' end
  when 'Final third throw in' then case when bx and distance>=16 then 'Long throw into box' when distance<=8 then 'Short throw routine' else 'Final third throw continuation' end when 'Throw in' then 'Throw in continuation' when 'Free kick' then 'Free kick continuation' else 'Set piece continuation' end as routine,
  case when restart_type in ('Penalty','Direct free kick') then restart_type when restart_type='Corner' then case when distance<=12 then 'Short corner' when not first_contact_won and not led_to_shot then 'Cleared first contact' when second_ball_retained and led_to_shot then 'Second ball' when bx and end_y between 38 and 62 then 'Central crowd' when coalesce(end_y,start_y,0)<=33 or coalesce(end_y,start_y,0)>=67 then 'Near or far post delivery' else 'Central delivery' end
  when restart_type='Final third throw in' then case when led_to_shot then 'Long throw' else 'Final third throw' end when restart_type in ('Throw in','Set piece') then 'Set piece sequence' else case when fct is null and not led_to_shot then 'Poor delivery' when second_ball_retained then 'Second ball' when restart_type='Wide free kick' then 'Wide free kick delivery' else 'Free kick delivery' end end as tag,
  coalesce(nullif(concat_ws(', ',case when led_to_goal then 'goal' when led_to_shot then 'shot' end,case when first_contact_won then 'first contact won' end,case when second_ball_retained then 'second ball retained' end),''),'no shot') as outcome from p""")


@query("p47_set_piece_routines", "select match_id,sidx as event_index,distance,post_target,target_zone,routine,tag,outcome from rout")
def p47(t: Tables):
    return setpieces.routines(setpieces.sequences_(t.prep)).select("match_id", "event_index", "distance", "post_target", "target_zone", "routine", "tag", "outcome")


@query("a34_set_piece_summary", """with o as (select match_id,team,count(*) as set_pieces,count(*) filter (restart_type='Corner') as corners,count(*) filter (restart_type like '%ree kick') as free_kicks,count(*) filter (restart_type like '%hrow in') as throw_ins,count(*) filter (restart_type='Penalty') as penalties,
 count(*) filter (led_to_shot) as shots,count(*) filter (led_to_goal) as goals,count(*) filter (first_contact_won) as first_contacts,count(*) filter (second_ball_retained) as second_balls from spseq group by 1,2),
 a as (select match_id,opponent as team,count(*) as set_pieces_against,count(*) filter (led_to_shot) as shots_against,count(*) filter (led_to_goal) as goals_against from spseq group by 1,2),
 j as (select match_id,team,coalesce(set_pieces,0) as set_pieces,coalesce(corners,0) as corners,coalesce(free_kicks,0) as free_kicks,coalesce(throw_ins,0) as throw_ins,coalesce(penalties,0) as penalties,coalesce(shots,0) as shots,coalesce(goals,0) as goals,coalesce(first_contacts,0) as first_contacts,coalesce(second_balls,0) as second_balls,coalesce(set_pieces_against,0) as set_pieces_against,coalesce(shots_against,0) as shots_against,coalesce(goals_against,0) as goals_against from o full join a using(match_id,team))
 select *, case when set_pieces>0 then 100.0*first_contacts/set_pieces else 0 end as first_contact_rate,case when set_pieces>0 then 100.0*second_balls/set_pieces else 0 end as second_ball_rate from j""")
def a34(t: Tables):
    return setpieces.summary(setpieces.sequences_(t.prep))


cte("spinv", """with u as (select match_id,team,'taker' as role,taker as player from spseq union all select match_id,team,'first_contact',case when first_contact_won then fcp end from spseq union all select match_id,team,'shot',shp from spseq
 union all select match_id,opponent,'clearer',clp from spseq union all select match_id,opponent,'blocker',blp from spseq) select match_id,team,role,player,count(*) as count from u where player is not null group by all""")


@query("a35_set_piece_involvement", "select * from spinv")
def a35(t: Tables):
    return setpieces.involvement(setpieces.sequences_(t.prep))


cte("spend", "select match_id,team,end_x,end_y from spseq")


@query("a35_delivery_heat", _grid("spend", "match_id,team", "end_x", "end_y"))
def a35b(t: Tables):
    return maps.data_grid(setpieces.sequences_(t.prep), ["match_id", "team"], "end_x", "end_y")


@query("a36_routine_groups", "select team,routine,count(*) as count,count(*) filter (led_to_shot) as shots,count(*) filter (led_to_goal) as goals,count(*) filter (first_contact_won) as first_contacts,avg(distance) as mean_distance,100.0*count(*) filter (led_to_shot)/count(*) as shot_rate from rout group by 1,2")
def a36(t: Tables):
    return setpieces.routine_groups(setpieces.sequences_(t.prep))


@query("a36_routine_zones", "select * from (select *, row_number() over (partition by team,routine order by count desc,target_zone)::int as pos from (select team,routine,target_zone,count(*) as count from rout group by all))")
def a36b(t: Tables):
    return setpieces.routine_zones(setpieces.sequences_(t.prep))
