"""League and season queries."""

from pyspark.sql import functions as F

from touchline.functions import flags
from touchline.operators import facts, league, links, models, players, sequences, shot_models, value
from touchline.plans.oracle_base import cte
from touchline.plans.registry import Tables, query

_K = "nation,tier,season"


def _rows(t: Tables):
    return league.team_rows(t.e, t.valued)


def _matches(t: Tables):
    return facts.season_match_facts(t.e)


cte("lrow", """with m as (select nation,tier,season,team,match_id,count(*) as rows,count(*) filter (e_pass) as passes,count(*) filter (e_pass and e_success) as good,count(*) filter (e_carry) as carries,count(*) filter (e_cross) as crosses,count(*) filter (e_shot) as shots,count(*) filter (e_goal) as goals,
 count(*) filter (e_final_third) as ft,count(*) filter (e_box) as bx,count(*) filter (e_final_third or e_box) as prog,count(*) filter (e_defensive) as dfn,count(*) filter (e_regain) as reg,count(*) filter (e_move) as moves,count(*) filter (e_wide) as wide,count(*) filter (e_central) as central,count(*) filter (e_set_piece) as sp,
 count(*) filter (e_set_piece and e_shot) as sps,count(*) filter (e_corner) as corners,count(*) filter (e_free_kick) as fk,count(*) filter (e_throw_in) as ti,count(*) filter (e_move and e_success) as gm,coalesce(sum(eex-ex) filter (e_move and e_success),0) as gain,coalesce(sum(ex) filter (e_defensive),0) as dx from fe group by all),
 s as (select *, sum(rows) over (partition by match_id) as scope_rows from m),
 t as (select nation,tier,season,team,count(*) as matches,sum(rows) as rows,sum(passes) as passes,sum(good) as good,sum(carries) as carries,sum(crosses) as crosses,sum(shots) as shots,sum(goals) as goals,sum(ft) as ft,sum(bx) as bx,sum(prog) as prog,sum(dfn) as dfn,sum(reg) as reg,sum(moves) as moves,sum(wide) as wide,sum(central) as central,sum(sp) as sp,sum(sps) as sps,sum(corners) as corners,sum(fk) as fk,sum(ti) as ti,sum(gm) as gm,sum(gain) as gain,sum(dx) as dx,sum(scope_rows) as scope_rows from s group by 1,2,3,4),
 v as (select nation,tier,season,team,sum(xg) as xg,sum(positive_league_xt) as xt from pv group by 1,2,3,4)
 select t.nation,t.tier,t.season,t.team,t.matches,t.rows::bigint as rows,v.xg,v.xt,t.rows/t.matches as events_per_match,passes/t.matches as passes_per_match,carries/t.matches as carries_per_match,crosses/t.matches as crosses_per_match,shots/t.matches as shots_per_match,goals/t.matches as goals_per_match,v.xg/t.matches as xg_per_match,v.xt/t.matches as xt_per_match,
 ft/t.matches as final_third_entries_per_match,bx/t.matches as box_entries_per_match,prog/t.matches as progressive_actions_per_match,dfn/t.matches as defensive_actions_per_match,reg/t.matches as high_regains_per_match,sps/t.matches as set_piece_shots_per_match,corners/t.matches as corners_per_match,fk/t.matches as free_kicks_per_match,ti/t.matches as throw_ins_per_match,
 100.0*t.rows/scope_rows as event_share,case when passes>0 then 100.0*good/passes else 0 end as pass_success_pct,v.xg/greatest(shots,1) as xg_per_shot,case when gm>0 then gain/gm else 0 end as directness,case when dfn>0 then dx/dfn else 0 end as defensive_height,case when moves>0 then 100.0*wide/moves else 0 end as wide_action_share,case when moves>0 then 100.0*central/moves else 0 end as central_action_share,100.0*sp/t.rows as set_piece_share
 from t left join v using(nation,tier,season,team)""")


@query("a38_league_rows", "select * from lrow", trained=True)
def a38(t: Tables):
    return _rows(t)


cte("lz", f"""with l as (select nation,tier,season,team,metric,value from (unpivot (select nation,tier,season,team,{','.join(f'{m}::double as {m}' for m in league.METRICS)} from lrow) on {','.join(league.METRICS)} into name metric value value)),
 w as (select *, avg(value) over p as mean,stddev_pop(value) over p as std,count(value) over p as n,min(value) over p as lo,max(value) over p as hi from l window p as (partition by nation,tier,season,metric))
 select nation,tier,season,team,metric,value,mean,std,(value-mean)/std as z from w where n>=3 and hi>lo""")


@query("a39_z_scores", "select * from lz")
def a39(t: Tables):
    return league.z_scores(_rows(t))


_DIMS = ",".join(f"('{d}','{m}')" for d, ms in league.DIMENSIONS.items() for m in ms)
cte("ldim", f"""with d as (select nation,tier,season,team,x.dimension,avg(z) as z from lz join (values {_DIMS}) x(dimension,m) on x.m=lz.metric group by all),
 s as (select nation,tier,season,team,dimension,least(greatest(50+16*z,0),100) as score from d)
 select *, avg(score) over (partition by nation,tier,season,dimension) as league_mean,row_number() over (partition by nation,tier,season,dimension order by round(score,8) desc,team)::int as rank,avg(score) over (partition by nation,tier,season,team) as overall from s""")


@query("a40_style_dimensions", "select * from ldim")
def a40(t: Tables):
    return league.dimension_scores(_rows(t))


def _hi(m: str, k: float = 0.6) -> str:
    p = f"over (partition by {_K})"
    return f"(stddev_pop({m}) {p}>0 and round({m}-avg({m}) {p}-stddev_pop({m}) {p}*{k},9)>=0)"


@query("a41_style_tags", f"""with g as (select nation,tier,season,team,list_filter([case when {_hi('event_share')} and {_hi('passes_per_match',0.35)} then 'possession and circulation heavy' end,case when {_hi('directness')} or {_hi('box_entries_per_match')} then 'vertical territory focused' end,
 case when {_hi('high_regains_per_match')} and {_hi('defensive_height',0.35)} then 'high press and regain focused' end,case when {_hi('wide_action_share')} or {_hi('crosses_per_match')} then 'wide and crossing orientated' end,case when {_hi('set_piece_share')} or {_hi('set_piece_shots_per_match')} then 'set piece leaning' end,
 case when {_hi('shots_per_match')} and {_hi('xg_per_match',0.35)} then 'high shot and chance volume' end], lambda z: z is not null) as l from lrow) select nation,tier,season,team,case when len(l)>0 then array_to_string(l,'; ') else 'balanced profile' end as tags from g""")
def a41(t: Tables):
    return league.style_tags(_rows(t))


cte("lcor", "select a.nation,a.tier,a.season,a.metric as x,b.metric as y,corr(a.value,b.value) as value from lz a join lz b using(nation,tier,season,team) group by all")


@query("a42_correlation_pearson", "select * from lcor")
def a42(t: Tables):
    return league.correlation(_rows(t))


@query("a42_correlation_spearman", """with r as (select *, rank() over (partition by nation,tier,season,metric order by value)+(count(*) over (partition by nation,tier,season,metric,value)-1)/2.0 as rk from lz)
 select a.nation,a.tier,a.season,a.metric as x,b.metric as y,corr(a.rk,b.rk) as value from r a join r b using(nation,tier,season,team) group by all""")
def a42b(t: Tables):
    return league.correlation(_rows(t), "spearman")


@query("a42_correlation_kendall", """with p as (select a.nation,a.tier,a.season,a.metric,a.team as t1,b.team as t2,sign(a.value-b.value)::double as s from lz a join lz b on a.nation=b.nation and a.tier=b.tier and a.season=b.season and a.metric=b.metric and a.team<b.team)
 select a.nation,a.tier,a.season,a.metric as x,b.metric as y,sum(a.s*b.s)/nullif(sqrt(sum(a.s*a.s)*sum(b.s*b.s)),0) as value from p a join p b using(nation,tier,season,t1,t2) group by all""")
def a42c(t: Tables):
    return league.correlation(_rows(t), "kendall")


@query("a42_strongest_pairs", """with c as (select *, case when value>0 then 'positive' else 'negative' end as direction,case when abs(value)>=0.7 then 'strong' when abs(value)>=0.45 then 'moderate' else 'weak' end as strength from lcor where x<y and value is not null and value<>0)
 select * from (select *, row_number() over (partition by nation,tier,season,direction order by round(abs(value),8) desc,x,y)::int as pos from c)""")
def a42d(t: Tables):
    return league.strongest_pairs(league.correlation(_rows(t)))


@query("a43_outliers", """select * from (select *, case when z>0 then 'above league norm' else 'below league norm' end as direction,row_number() over (partition by nation,tier,season order by round(abs(z),8) desc,team,metric)::int as pos from lz where round(abs(z),9)>=1.8)""")
def a43(t: Tables):
    return league.outliers(_rows(t))


@query("a44_findings", """with c as (select nation,tier,season,case when count(*)>=4 and corr(directness,event_share)<=-0.35 then 'trade off' when count(*)>=4 and corr(directness,event_share)>=0.35 then 'combined' else 'none' end as directness_vs_control from lrow group by 1,2,3)
 select d.nation,d.tier,d.season,d.dimension,d.rank,d.team,d.score,c.directness_vs_control from ldim d join c using(nation,tier,season) where d.rank<=3""")
def a44(t: Tables):
    return league.findings(_rows(t))


cte("radr", """with p as (select nation,tier,season,team,opponent,match_id,count(*) filter (e_goal) as g,count(*) filter (e_shot) as s,count(*) filter (e_box) as b,count(*) filter (e_final_third) as f,count(*) filter (e_set_piece and e_shot) as ss,count(*) filter (e_regain) as r,count(*) filter (e_defensive) as d from fe group by all),
 o as (select nation,tier,season,team,count(*) as matches,sum(g) as g,sum(s) as s,sum(b) as b,sum(f) as f,sum(ss) as ss,sum(r) as r,sum(d) as d from p group by 1,2,3,4), a as (select nation,tier,season,opponent as team,sum(g) as ag,sum(s) as as_,sum(b) as ab,sum(f) as af,sum(ss) as ass from p group by 1,2,3,4),
 x as (select nation,tier,season,team,sum(xg) as xg,sum(league_xt_added) as xt from pv group by 1,2,3,4), y as (select nation,tier,season,opponent as team,sum(xg) as axg from pv group by 1,2,3,4), z as (select nation,tier,season,team,sum(xg) as xa from assist where role='assist' group by 1,2,3,4)
 select nation,tier,season,team,matches,g/matches as goals_for,coalesce(ag,0)/matches as goals_against,s/matches as shots_for,coalesce(as_,0)/matches as shots_against,coalesce(xg,0)/matches as xg_for,coalesce(axg,0)/matches as xg_against,coalesce(xa,0)/matches as xa,coalesce(xt,0)/matches as xt,b/matches as box_for,coalesce(ab,0)/matches as box_against,f/matches as final_third_for,coalesce(af,0)/matches as final_third_against,
 100.0*f/greatest(f+coalesce(af,0),1) as field_tilt,r/matches as regains,d/matches as defensive_actions,ss/matches as set_piece_shots_for,coalesce(ass,0)/matches as set_piece_shots_against from o left join a using(nation,tier,season,team) left join x using(nation,tier,season,team) left join y using(nation,tier,season,team) left join z using(nation,tier,season,team)""")
_UP = ",".join(f"'{k}'" for k, up in league.RADAR.items() if up)
cte("rad", f"""with l as (select nation,tier,season,team,metric,value,metric in ({_UP}) as higher_is_better from (unpivot (select nation,tier,season,team,{','.join(f'{m}::double as {m}' for m in league.RADAR)} from radr) on {','.join(league.RADAR)} into name metric value value)),
 w as (select *, rank() over (partition by nation,tier,season,metric order by round(case when higher_is_better then -value else value end,8))::int as rank,count(*) over p as teams,min(value) over p as league_min,max(value) over p as league_max,avg(value) over p as league_mean from l window p as (partition by nation,tier,season,metric))
 select *, case when teams>1 then 100.0*(teams-rank)/(teams-1) else 100 end as percentile from w""")


def _radar(t: Tables, valued=None):
    return league.radar(league.radar_rows(t.e, t.valued if valued is None else valued, t.credits))


@query("a45_league_radar", "select * from rad", trained=True)
def a45(t: Tables):
    return _radar(t)


@query("a46_pair_radar", """with r as (select match_id,team,(final_third_entries+progressive_carries+carry_final_third_entries)::double as progression,(final_third_entries+0.35*attacking_third_touches)::double as final_third,(box_entries+2*shots+7.5*xg)::double as box_threat,(0.12*passes+0.55*pass_completion_pct+0.35*average_x)::double as control,(2.4*high_regains+defensive_actions+1.2*interceptions)::double as counter_pressure,(0.6*corners+0.25*free_kicks+2.5*set_piece_shots+5*set_piece_goals)::double as set_pieces from ts)
 select a.match_id,a.team,""" + ",".join(f"least(greatest(a.{k}/greatest(abs(a.{k}),abs(o.{k}),1)*100,0),100) as {k}" for k in ("progression", "final_third", "box_threat", "control", "counter_pressure", "set_pieces")) + """,
 case when o.box_threat<=0 then 100 when a.box_threat>0 then least(a.box_threat,o.box_threat)/o.box_threat*100 else 100 end as box_defending from r a join r o on o.match_id=a.match_id and o.team<>a.team""")
def a46(t: Tables):
    return league.pair_radar(facts.team_summary(t.d))


@query("a48_schedule_overview", "select s.nation,s.tier,s.season,count(*) as matches,count(distinct home_team) as home_teams,sum(n)::bigint as events,sum(n)/count(*) as events_per_match from sched s left join (select match_id,count(*) as n from log group by 1) using(match_id) group by 1,2,3")
def a48(t: Tables):
    per = t.log.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    return t.schedule.join(per, "match_id", "left").groupBy("nation", "tier", "season").agg(
        F.count(F.lit(1)).alias("matches"), F.count_distinct("home_team").alias("home_teams"), F.sum("n").alias("events"), (F.sum("n") / F.count(F.lit(1))).alias("events_per_match"))


cte("dang", """with o as (select nation,tier,season,team,match_id,opponent,team_side,kickoff,(3*shots+2*box_entries+final_third_entries+0.7*regains)::double as danger,goals from smf)
 select a.*, coalesce(b.danger,0) as danger_against,coalesce(b.goals,0) as goals_against from o a left join o b on b.match_id=a.match_id and b.team=a.opponent""")


@query("j07_match_danger", "select * from dang")
def j07(t: Tables):
    return league.match_danger(_matches(t))


@query("w08_rolling_five", """select *, avg(danger) over w as rolling_for,avg(danger_against) over w as rolling_against,count(*) over w as window_matches from dang window w as (partition by nation,tier,season,team order by kickoff,match_id rows between 4 preceding and current row)""")
def w08(t: Tables):
    return league.rolling_five(league.match_danger(_matches(t)))


@query("a54_season_momentum", """with k as (select *, row_number() over (partition by nation,tier,season,team order by kickoff desc,match_id desc) as k from dang)
 select nation,tier,season,team,avg(danger-danger_against) filter (k<=5) as recent,avg(danger-danger_against) filter (k>5 and k<=10) as previous,avg(danger) filter (team_side='home') as home_mean,avg(danger) filter (team_side='away') as away_mean from k group by 1,2,3,4""")
def a54(t: Tables):
    return league.recent_vs_previous(league.match_danger(_matches(t)))


@query("a54_interval_momentum", """with i as (select nation,tier,season,team,opponent,least(floor(expanded_minute/15),5)::int as interval_no,(3*e_shot::int+2*e_box::int+e_final_third::int+0.7*e_regain::int)::double as w from fe)
 select nation,tier,season,team,interval_no,coalesce(danger,0) as danger,coalesce(danger_against,0) as danger_against from (select nation,tier,season,team,interval_no,sum(w) as danger from i group by all) full join (select nation,tier,season,opponent as team,interval_no,sum(w) as danger_against from i group by all) using(nation,tier,season,team,interval_no)""")
def a54b(t: Tables):
    return league.interval_momentum(t.e)


@query("a33_previous_five", """with d as (select a.*, a.passes/(a.passes+coalesce(b.passes,0))::double as pass_share,b.shots as opp_shots from smf a left join smf b on b.match_id=a.match_id and b.team=a.opponent)
 select team,match_id,count(*) over w as matches_used,avg(passes) over w as passes_mean,avg(shots) over w as shots_mean,avg(goals) over w as goals_mean,avg(box_entries) over w as box_entries_mean,avg(final_third_entries) over w as final_third_entries_mean,avg(regains) over w as regains_mean,avg(set_pieces) over w as set_pieces_mean,avg(pass_share) over w as pass_share_mean,avg(opp_shots) over w as opp_shots_mean from d window w as (partition by nation,tier,team order by kickoff,match_id rows between 5 preceding and 1 preceding)""")
def a33(t: Tables):
    return league.previous_five(_matches(t))


@query("w13_previous_matches", """select m.team,m.match_id,p.match_id as previous_match,p.k::int as pos from smf m join lateral (select s.match_id,row_number() over (order by s.kickoff desc,s.match_id desc) as k from smf s where s.team=m.team and s.nation=m.nation and s.tier=m.tier and s.kickoff<m.kickoff) p on true where p.k<=5""")
def w13(t: Tables):
    from pyspark.sql import Window

    m = _matches(t).select("nation", "tier", "team", "match_id", "kickoff")
    w = Window.partitionBy("nation", "tier", "team").orderBy("kickoff", "match_id").rowsBetween(-5, -1)
    df = m.withColumn("p", F.reverse(F.collect_list("match_id").over(w)))
    return df.select("team", "match_id", F.posexplode("p").alias("k", "previous_match")).selectExpr("team", "match_id", "previous_match", "k + 1 as pos")


_PAN = """with p as (select nation,tier,season,team,metric,value,higher_is_better,rank,teams,percentile,league_min,league_max,league_mean,lag(value) over (partition by nation,tier,team,metric order by season) as previous from rad),
 s as (select *, case when previous is null or abs(value-previous)<0.001 then 'flat' when (value>previous)=higher_is_better then 'up' else 'down' end as trend,case when coalesce(previous,0)=0 then 50 else least(greatest(50+50*(value/previous-1),0),100) end as s from p)
 select * exclude (s), case when higher_is_better then s else 100-s end as previous_score from s"""


@query("a53_seasonal_panel", _PAN)
def a53(t: Tables):
    return league.season_panel(_radar(t))


@query("j29_previous_season", "select team,metric,season,value,previous from (" + "select team,metric,season,value,lag(value) over (partition by nation,tier,team,metric order by season) as previous from rad)")
def j29(t: Tables):
    return league.season_panel(_radar(t)).select("team", "metric", "season", "value", "previous")


@query("j06_match_log", """select nation,tier,season,team,f.match_id,opponent,case when team=s.home_team then 'home' else 'away' end as venue,case when team=s.home_team then home_score else away_score end as goals_for,case when team=s.home_team then away_score else home_score end as goals_against,
 case when (home_score>away_score)=(team=s.home_team) and home_score<>away_score then 'W' when home_score=away_score then 'D' else 'L' end as result,passes,shots,box_entries,regains from smf f join (select match_id,home_team,home_score,away_score from sched) s using(match_id)""")
def j06(t: Tables):
    return league.match_log(_matches(t), t.schedule)


@query("j05_opponent_rows", "select nation,tier,season,opponent as team,count(*) as opponent_rows,count(distinct match_id) as matches_with_rows,count(*) filter (e_shot) as shots_conceded from fe group by 1,2,3,4")
def j05(t: Tables):
    return t.e.groupBy("nation", "tier", "season", F.col("opponent").alias("team")).agg(
        F.count(F.lit(1)).alias("opponent_rows"), F.count_distinct("match_id").alias("matches_with_rows"), F.count_if("e_shot").alias("shots_conceded"))


_W14 = ["passes", "shots", "goals", "box_entries", "final_third_entries", "regains", "set_pieces", "crosses", "defensive_actions"]


@query("w14_metric_ranks", "select nation,tier,season,team," + ",".join(f"rank() over (partition by nation,tier,season order by {c} desc)::int as {c}_rank" for c in _W14) + " from stf")
def w14(t: Tables):
    from pyspark.sql import Window

    df = facts.season_team_facts(_matches(t))
    w = Window.partitionBy("nation", "tier", "season")
    return df.select("nation", "tier", "season", "team", *[F.rank().over(w.orderBy(F.desc(c))).alias(f"{c}_rank") for c in _W14])


@query("j25_team_metric_lookup", """select s.nation,s.tier,s.season,s.team,s.shots,coalesce(x.xg,0) as xg_sum,coalesce(x.xt,0) as xt_sum,coalesce(a.xa,0) as xa_sum from stf s left join (select nation,tier,season,team,sum(xg) as xg,sum(positive_league_xt) as xt from pv group by 1,2,3,4) x using(nation,tier,season,team)
 left join (select nation,tier,season,team,sum(xg) as xa from assist where role='assist' group by 1,2,3,4) a using(nation,tier,season,team)""", trained=True)
def j25(t: Tables):
    k = league.TEAM
    x = t.valued.groupBy(*k).agg(F.sum("xg").alias("xg_sum"), F.sum("positive_league_xt").alias("xt_sum"))
    a = t.credits.where("role = 'assist'").groupBy(*k).agg(F.sum("xg").alias("xa_sum"))
    return facts.season_team_facts(_matches(t)).select(*k, "shots").join(x, k, "left").join(a, k, "left").na.fill(0.0, ["xg_sum", "xt_sum", "xa_sum"])


@query("w23_team_ranking", "select nation,tier,season,team,score,row_number() over (partition by nation,tier,season order by round(score,6) desc,team)::int as rank from (select nation,tier,season,team,sum(score) as score from pinv group by all)")
def w23(t: Tables):
    from pyspark.sql import Window

    df = t.involvement.groupBy(*league.TEAM).agg(F.sum("score").alias("score"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("nation", "tier", "season").orderBy(F.round("score", 6).desc(), "team")))


@query("f09_minimum_matches", "select * from stf where matches>=9")
def f09(t: Tables):
    return facts.season_team_facts(_matches(t)).where("matches >= 9")


@query("m05_pca_map")
def m05(t: Tables):
    return models.pca_map(_rows(t))


@query("m06_team_clusters")
def m06(t: Tables):
    return models.team_clusters(league.dimension_scores(_rows(t)))


@query("m05_pca_loadings")
def m05_loadings(t: Tables):
    return models.pca_loadings(_rows(t))


@query("m06_cluster_centroids")
def m06_centroids(t: Tables):
    return models.cluster_centroids(models.team_clusters(league.dimension_scores(_rows(t))))


@query("m01_shot_models")
def m01(t: Tables):
    return shot_models.model_rows(value.shot_features(t.runs))


@query("m02_shot_scores")
def m02(t: Tables):
    return shot_models.trained_scores(value.shot_features(t.runs))


@query("m07_model_context", "with g as (select shot_family,count(*) as shots,sum(goal)::bigint as goals from feat group by 1) select shot_family,shots,goals,goals/shots::double as goal_rate,case when shot_family='penalty' then case when shots>=10 then 'own rate' else 'default rate' end when shots>=120 and goals>=12 then 'trained' else 'base rate' end as status from g")
def m07(t: Tables):
    return models.model_status(value.shot_features(t.runs))


cte("mq", """with l as (select nation,tier,season,count(*) as events from log group by 1,2,3),
 s as (select g.nation,g.tier,g.season,count(*) as shots_used,sum(f.goal)::bigint as goals_seen,case when count(*) filter (shot_family='penalty')>=10 then avg(f.goal) filter (shot_family='penalty') else 0.76 end as penalty_rate from feat f join log g using(event_id) group by 1,2,3),
 a as (select nation,tier,season,count(distinct (match_id,shot_index)) as linked from assist group by 1,2,3), m as (select nation,tier,season,count(*) as moves from pv where f_move group by 1,2,3)
 select l.nation,l.tier,l.season,coalesce(shots_used,0) as shots_used,coalesce(goals_seen,0) as goals_seen,coalesce(penalty_rate,0.76)::double as penalty_rate,coalesce(linked,0) as linked,coalesce(moves,0) as moves from l left join s using(nation,tier,season) left join a using(nation,tier,season) left join m using(nation,tier,season)""")


@query("m07_model_quality", """select nation,tier,season,'xG' as model,case when shots_used>0 then 'trained' else 'limited' end as status,shots_used as sample,goals_seen,penalty_rate from mq
 union all select nation,tier,season,'xA',case when linked>0 then 'applied' else 'limited' end,linked,null,null from mq union all select nation,tier,season,'xT','trained',moves,null,null from mq""")
def m07_quality(t: Tables):
    quality = shot_models.model_quality(t.log, value.shot_features(t.runs), t.credits, t.moves)
    return shot_models.with_fixtures(quality, t.schedule)
