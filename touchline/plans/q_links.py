"""Links between events of a match.  The checks use self joins; the plans use frames."""

from pyspark.sql import functions as F

from touchline.operators import links
from touchline.plans.oracle_base import cte
from touchline.plans.registry import Tables, query

cte("pvp", "select *, row_number() over (partition by match_id order by period,expanded_minute,event_index) as pos from pv")
cte("runs", """with a as (select *, lag(period) over w as pp, lag(team) over w as pt from pvp window w as (partition by match_id order by pos))
 select * exclude (pp,pt), sum(case when pp is null or pp<>period or pt<>team then 1 else 0 end) over (partition by match_id order by pos) as run_id from a""")


@query("j11_first_following", """select c.match_id,c.event_index,min(n.event_index) as shot_index from fc c join fc n on n.match_id=c.match_id and n.period=c.period
 and n.team=c.team and n.is_shot and n.clock_s>c.clock_s and n.clock_s<=c.clock_s+15 where c.is_defensive_action group by 1,2""")
def j11(t: Tables):
    df = links.following(t.c, {"shot": ("is_shot", "own", 15)}, [], strict=True)
    return df.where("is_defensive_action and shot is not null").selectExpr("match_id", "event_index", "shot.event_index as shot_index")


@query("j11_first_following_in_blocks", """select c.match_id,c.event_index,min(n.event_index) as shot_index from fc c join fc n on n.match_id=c.match_id and n.period=c.period
 and n.team=c.team and n.is_shot and n.clock_s>c.clock_s and n.clock_s<=c.clock_s+15 where c.is_defensive_action group by 1,2""")
def j11b(t: Tables):
    df = links.following_in_blocks(t.c, {"shot": ("is_shot", "own", 15)}, [], strict=True)
    return df.where("is_defensive_action and shot is not null").selectExpr("match_id", "event_index", "shot.event_index as shot_index")


cte("recv", """with c as (select a.match_id,a.event_index,b.player,b.pos,row_number() over (partition by a.match_id,a.event_index order by b.pos) as rn
 from runs a join runs b on b.match_id=a.match_id and b.run_id=a.run_id and b.pos>a.pos and b.pos<=a.pos+8 and b.clock_s-a.clock_s between 0 and 12
 where (a.is_pass or a.is_cross) and a.end_x is not null and b.player<>a.player and b.type_c not in ('substitution','formationchange','card','start','end','offsidegiven'))
 select match_id,event_index,player as receiver from c where rn=1""")


@query("j12_receivers", "select * from recv")
def j12(t: Tables):
    return links.receivers(t.prep).select("match_id", "event_index", "receiver")


cte("press", """
with pr as (select * from pvp where is_defensive_action and x>=45),
o as (select p.match_id,p.team,p.event_index as pi,p.x as px,n.*, row_number() over (partition by p.match_id,p.event_index order by n.pos) as rn,
   (n.is_success and (n.is_pass or n.is_cross or n.is_carry) and n.x is not null and n.end_x is not null and (n.final_third_entry or n.box_entry or n.end_x-n.x>=12)) as esc
   from pr p join pvp n on n.match_id=p.match_id and n.period=p.period and n.pos>p.pos and n.team<>p.team and n.clock_s-p.clock_s<=8),
e as (select match_id,pi,bool_or(coalesce(esc,false)) as escaped from o group by all),
w as (select p.match_id,p.event_index as pi, arg_min((n.is_defensive_action or n.is_touch or n.is_pass),n.pos) as okk from pr p join pvp n on n.match_id=p.match_id and n.period=p.period and n.pos>p.pos and n.team=p.team and n.clock_s-p.clock_s<=10 group by all),
s as (select p.match_id,p.event_index as pi, min(n.event_index) as si from pr p join pvp n on n.match_id=p.match_id and n.period=p.period and n.pos>p.pos and n.team=p.team and n.is_shot and n.clock_s-p.clock_s<=15 group by all),
j as (select p.match_id,p.team,p.x as px,p.event_index as pi,o.event_index as ni,o.x as nx,o.y as ny,o.end_x as nex,o.end_y as ney,o.type_c as nt,(o.is_pass or o.is_cross) as np,o.is_carry as nc,o.is_success as ns,o.esc,e.escaped,w.okk,s.si
 from pr p left join o on o.match_id=p.match_id and o.pi=p.event_index and o.rn=1 left join e on e.match_id=p.match_id and e.pi=p.event_index left join w on w.match_id=p.match_id and w.pi=p.event_index left join s on s.match_id=p.match_id and s.pi=p.event_index),
g as (select match_id,team,count(*) as presses,count(*) filter (px>=66.67) as high_presses,count(*) filter (px<66.67) as middle_presses,
 count(distinct ni) filter (np and nex<=nx-6) as forced_back, count(distinct ni) filter (np and abs(nex-nx)<6 and abs(ney-ny)>=10) as forced_lateral,
 count(distinct ni) filter (nt like '%clear%' or (np and nex-nx>=35 and nx<66.67)) as forced_long,
 count(distinct ni) filter (((np or nc) and not ns) or regexp_matches(nt,'out|throw|blockedpass|badtouch|balltouch')) as forced_out,
 count(distinct ni) filter (esc) as escapes, count(distinct pi) filter (ni is not null and not escaped and okk) as failed_build_ups,
 count(distinct si) filter (ni is not null) as press_to_shot from j group by all)
select *, forced_back+forced_lateral+forced_long+forced_out as forced_total, 100.0*(forced_back+forced_lateral+forced_long+forced_out)/presses as forced_rate, 100.0*escapes/presses as escape_rate from g""")


@query("j13_pressing_effect", "select * from press")
def j13(t: Tables):
    return links.pressing_effect(t.prep)


@query("j14_season_pressing", """
with pr as (select * from fe where e_regain or (e_defensive and ex>=55)),
o as (select p.season,p.nation,p.tier,p.team,p.event_id as pid,n.ex,n.ey,n.eex,n.eey,n.e_final_third,n.e_box,n.e_shot,n.outcome_c,row_number() over (partition by p.event_id order by n.clock_s,n.event_index) as rn
 from pr p join fe n on n.match_id=p.match_id and n.period=p.period and n.team<>p.team and n.clock_s>p.clock_s and n.clock_s<=p.clock_s+15),
g as (select nation,tier,season,team,count(*) filter (eex-ex<-8) as forced_back,count(*) filter (sqrt(power(eex-ex,2)+power(eey-ey,2))>45) as forced_long,
 count(*) filter (regexp_matches(outcome_c,'out|throw|corner')) as forced_out,count(*) filter (e_final_third or e_box) as escaped,count(*) filter (e_shot) as shots_after,count(*) filter (e_box) as box_after from o where rn<=3 group by all),
b as (select nation,tier,season,team,count(*) as pressures from pr group by all)
select b.*,coalesce(forced_back,0) as forced_back,coalesce(forced_long,0) as forced_long,coalesce(forced_out,0) as forced_out,coalesce(escaped,0) as escaped,coalesce(shots_after,0) as shots_after,coalesce(box_after,0) as box_after from b left join g using(nation,tier,season,team)""")
def j14(t: Tables):
    return links.season_pressing(t.e)


cte("ral", """with r as (select distinct a.match_id,a.team,a.event_index from pvp a join pvp b on b.match_id=a.match_id and b.team=a.team and b.pos<a.pos and b.pos>=a.pos-11 and a.clock_s-b.clock_s<=5
  and (b.is_pass or b.is_cross or b.is_carry) and not b.is_success where a.is_defensive_action)
 select t.match_id,t.team,coalesce(c,0) as regains_after_loss from (select distinct match_id,team from pvp) t left join (select match_id,team,count(*) as c from r group by all) using(match_id,team)""")


@query("j15_regains_after_loss", "select * from ral")
def j15(t: Tables):
    return links.regains_after_loss(t.prep)


@query("j16_fast_attacks", """select nation,tier,season,team,count(*) filter (e_regain) as high_regains, count(*) filter (e_regain and exists(select 1 from fe n where n.match_id=f.match_id and n.period=f.period and n.team=f.team
 and (n.e_shot or n.e_box or n.e_final_third) and n.clock_s>f.clock_s and n.clock_s<=f.clock_s+15)) as fast_attacks from fe f group by 1,2,3,4""")
def j16(t: Tables):
    return links.fast_attacks(t.e)


cte("orig", """with c as (select s.match_id,s.event_index,s.clock_s as sc,b.event_index as oi,b.clock_s as oc,b.player as op,b.x as ox,b.y as oy,b.end_x as oex,b.end_y as oey,row_number() over (partition by s.match_id,s.event_index order by b.pos desc) as rn
 from runs s join runs b on b.match_id=s.match_id and b.run_id=s.run_id and b.pos<s.pos and b.pos>=s.pos-10
 where s.is_shot and (b.is_pass or b.is_cross or b.is_carry or b.is_take_on) and (b.x is not null or b.end_x is not null))
 select match_id,event_index,oi as origin_index,op as origin_player,ox,oy,oex,oey from c where rn=1 and sc-oc<=15""")


@query("j18_shot_origins", "select match_id,event_index,origin_index,origin_player from orig")
def j18(t: Tables):
    return links.shot_origins(t.prep).where("origin is not null").selectExpr(
        "match_id", "event_index", "origin.event_index as origin_index", "origin.player as origin_player")


_PROG = "(is_pass or is_cross or is_carry) and is_success and x is not null and y is not null and end_x is not null and end_y is not null"
cte("bea", f"""with e as (select * from ochains where box_entry and {_PROG}),
 s as (select e.match_id,e.event_index,e.team_key,e.attack_chain_id,min(o.event_index) as si from e join ochains o on o.match_id=e.match_id and o.team_key=e.team_key and o.attack_chain_id=e.attack_chain_id and o.is_shot and o.event_index>=e.event_index and o.clock_s-e.clock_s<=10 group by all),
 v as (select s.match_id,s.event_index,sum(o.positive_xt) as xs from s join ochains o on o.match_id=s.match_id and o.team_key=s.team_key and o.attack_chain_id=s.attack_chain_id and o.event_index between s.event_index and s.si group by all)
 select e.match_id,e.event_index,e.team,e.x,e.y,e.end_x,e.end_y,e.is_set_piece,e.period,v.xs is not null as led_to_shot,coalesce(v.xs,0) as xt_to_shot,e.positive_xt from e left join v using(match_id,event_index)""")


@query("j19_box_entry_to_shot", "select match_id,event_index,team,led_to_shot,xt_to_shot,positive_xt from bea")
def j19(t: Tables):
    return links.box_entry_arrows(t.valued).select("match_id", "event_index", "team", "led_to_shot", "xt_to_shot", "positive_xt")


_L5 = "case when {0} is null then 'unknown' when {0}<18 then 'left_wide' when {0}<38 then 'left_half_space' when {0}<=62 then 'central' when {0}<=82 then 'right_half_space' else 'right_wide' end"
cte("progl", f"""with o as (select *, row_number() over (partition by match_id,team_key,attack_chain_id order by period,expanded_minute,event_index) as cp, {_L5.format('end_y')} as lane from ochains),
 p as (select * from o where {_PROG} and (final_third_entry or box_entry or lane in ('left_half_space','central','right_half_space') or end_x-x>=10))
 select p.match_id,p.event_index,p.team,p.lane,p.final_third_entry,p.box_entry,
  exists(select 1 from o s where s.match_id=p.match_id and s.team_key=p.team_key and s.attack_chain_id=p.attack_chain_id and s.is_shot and s.cp>p.cp and (s.clock_s-p.clock_s<=10 or s.cp-p.cp<=5)) as led_to_shot from p""")


@query("j20_progression_to_shot", "select * from progl")
def j20(t: Tables):
    return links.progression_links(t.prep).select("match_id", "event_index", "team", "lane", "final_third_entry", "box_entry", "led_to_shot")


_DG = "(({0}>=83 and {1} between 21.1 and 78.9) or ({0}>=78 and {1} between 24 and 76))"
cte("ftp", f"""with r as (select *, coalesce({_DG.format('x','y')},false) or coalesce({_DG.format('coalesce(end_x,x)','coalesce(end_y,y)')},false) as dg, coalesce((is_pass or is_cross) and end_x<=x-5,false) as bk,
   coalesce(x is not null and not start_in_box and coalesce(end_x,x)>=83 and coalesce(end_y,y) between 21.1 and 78.9,false) as bx from runs),
 a as (select p.match_id,p.event_index, bool_or(n.is_goal) as g,bool_or(n.is_shot) as s,bool_or(n.is_carry and n.dg) as c,bool_or(n.is_take_on and n.dg) as tk,bool_or(n.bk) as b from r p join r n on n.match_id=p.match_id and n.run_id=p.run_id and n.pos>p.pos and n.pos<=p.pos+8 and n.clock_s-p.clock_s<=20 group by all)
 select p.match_id,p.event_index,p.team,p.x,p.y,p.end_x,p.end_y,p.is_success, case when coalesce(g,false) then 'goal_chain' when coalesce(s,false) then 'shot_chain' when coalesce(c,false) then 'carry_into_danger' when coalesce(tk,false) then 'take_on_in_danger' when bx then 'box_entry'
  when bk or coalesce(b,false) then 'backward_recycle' when not is_success then 'incomplete' else 'completed' end as outcome_class
 from r p left join a using(match_id,event_index) where (p.is_pass or p.is_cross) and p.x is not null and (p.x>=66.67 or p.end_x>=66.67)""")


@query("j21_final_third_pass_outcomes", "select match_id,event_index,team,outcome_class from ftp")
def j21(t: Tables):
    return links.final_third_passes(t.prep).select("match_id", "event_index", "team", "outcome_class")


@query("j22_season_final_third_passes", """
with a as (select *, lag(team_key) over (partition by match_id order by period,expanded_minute,event_index) as pt from fe),
c as (select *, sum(case when pt is null or pt<>team_key then 1 else 0 end) over (partition by match_id order by period,expanded_minute,event_index) as ch from a),
p as (select * from c where e_pass and (ex>=80 or eex>=80)),
l as (select p.event_id,bool_or(n.e_shot) as s,bool_or(n.e_goal) as g,bool_or(n.e_box) as b,bool_or(n.e_shot or n.e_goal or n.e_box) as d from p join c n on n.match_id=p.match_id and n.ch=p.ch and n.event_index>p.event_index and n.event_index<=p.event_index+8 group by all)
select nation,tier,season,team,count(*) as all_passes,count(*) filter (not e_set_piece) as open_play,count(*) filter (d) as danger,count(*) filter (b) as box_entry,count(*) filter (s) as shot_chain,count(*) filter (g) as goal_chain,count(*) filter (eex<ex) as backwards,count(*) filter (not e_success) as incomplete
from p left join l using(event_id) group by 1,2,3,4""")
def j22(t: Tables):
    return links.season_final_third_passes(t.e)


def _foll(name: str, mask: str, own: str) -> str:
    return f"exists(select 1 from prep n where n.match_id=p.match_id and n.period=p.period and n.team{own}p.team and {mask} and n.clock_s>p.clock_s and n.clock_s<=p.clock_s+15) as {name}"


cte("trans", f"""with p as (select *, {_foll('os','n.is_shot','=')}, {_foll('ob','n.box_entry','=')}, {_foll('op','(n.is_pass or n.is_cross)','=')}, {_foll('xs','n.is_shot','<>')}, {_foll('xb','n.box_entry','<>')},
  ((is_pass or is_cross or is_carry or is_take_on) and not is_success) as is_loss from prep p where is_defensive_action or ((is_pass or is_cross or is_carry or is_take_on) and not is_success))
 select match_id,team,count(*) filter (is_defensive_action) as regains,count(*) filter (is_defensive_action and x>=60) as high_regains,count(*) filter (is_defensive_action and os) as regains_to_shot,count(*) filter (is_defensive_action and ob) as regains_to_box,
 count(*) filter (is_defensive_action and (os or ob)) as counter_attacks,count(*) filter (is_defensive_action and op) as first_passes,count(*) filter (is_loss) as losses,count(*) filter (is_loss and xs) as losses_to_shot,count(*) filter (is_loss and xb) as losses_to_box,count(*) filter (is_loss and (xs or xb)) as counter_attacks_against from p group by all""")


@query("j23_transition_outcomes", "select * from trans")
def j23(t: Tables):
    return links.transition_outcomes(t.prep)


@query("j23_transition_outcomes_in_blocks", "select * from trans")
def j23c(t: Tables):
    return links.transition_outcomes(t.prep, in_blocks=True)


@query("j23_transition_players", """with g as (select match_id,team,player,count(*) filter (is_defensive_action) as regains,count(*) filter (is_defensive_action and x>=60) as high_regains,
 count(*) filter ((is_pass or is_cross or is_carry or is_take_on) and not is_success) as losses from prep group by all)
 select *, (regains+0.75*high_regains-0.35*losses)::double as transition_score from g where regains>0 or losses>0""")
def j23b(t: Tables):
    return links.transition_players(t.prep)


@query("j30_player_snapshot_value", """with a as (select *, row_number() over (partition by match_id,team,player order by period desc,expanded_minute desc,event_index desc) as rn from fc where expanded_minute<=60 and x is not null and (is_touch or is_pass or is_carry)),
 z as (select nation,tier,season,match_id,team,player,x,y,(least(floor(y*12/100),11)*16+least(floor(x*16/100),15))::int as zone from a where rn=1),
 c as (select match_id,team,player,count(*) as touches from fc where expanded_minute<=60 and is_touch group by all)
 select z.match_id,z.team,z.player,z.x,z.y,z.zone, m.xt, coalesce(c.touches,0) as touches from z left join xtm m using(nation,tier,season,zone) left join c using(match_id,team,player)""")
def j30(t: Tables):
    from touchline.functions import geometry

    spots = links.latest_locations(t.c, 60, links.SEASON).withColumn("zone", geometry.value_zone("x", "y"))
    touches = t.c.where("expanded_minute <= 60 and is_touch").groupBy("match_id", "team", "player").agg(F.count(F.lit(1)).alias("touches"))
    df = spots.join(t.grid, [*links.SEASON, "zone"], "left").join(touches, ["match_id", "team", "player"], "left")
    return df.select("match_id", "team", "player", "x", "y", "zone", "xt", F.coalesce("touches", F.lit(0)).alias("touches"))


@query("j31_control_cells", """with a as (select *, row_number() over (partition by match_id,team,player order by period desc,expanded_minute desc,event_index desc) as rn from fc where expanded_minute<=60 and x is not null and (is_touch or is_pass or is_carry)),
 g as (select unnest(range(384))::int as cell), d as (select match_id,team,player,cell,sqrt(power(x*1.2-(cell%24+0.5)*120/24,2)+power(y*0.8-(cell//24+0.5)*80/16,2)) as distance from a, g where rn=1),
 r as (select *, row_number() over (partition by match_id,cell order by round(distance,9),player) as k from d) select match_id,cell,player,team,distance from r where k=1""")
def j31(t: Tables):
    return links.control_cells(links.latest_locations(t.c, 60))
