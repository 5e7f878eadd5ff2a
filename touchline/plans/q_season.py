"""Season profiles and streaming."""

from pyspark.sql import functions as F

from touchline.operators import facts, league, links, season, sequences, value
from touchline.plans.oracle_base import cte
from touchline.plans.q_league import _radar
from touchline.plans.registry import ORACLES, Tables, query
from touchline.streaming import pipelines

_K = "nation,tier,season,team"

_E2 = """(select *, coalesce(x,0)*1.2::double as ex,coalesce(y,0)*0.8::double as ey,coalesce(end_x,0)*1.2::double as eex,coalesce(end_y,0)*0.8::double as eey,(is_goal or type_c='goal') as e_goal,(type_c like '%pass%' or type_c='cross') as e_pass,(type_c like '%cross%' or qual_c like '%cross%') as e_cross,regexp_matches(type_c,'carry|dribble|takeon|run') as e_carry,
 (qual_c like '%corner%' or type_c like '%corner%') as e_corner,(qual_c like '%freekick%' or type_c like '%freekick%') as e_free_kick,(qual_c like '%throwin%' or type_c like '%throwin%') as e_throw_in from pv where not is_inferred_carry)"""
cte("spp0", f"""with a as (select *, (ex>=100 and ey between 18 and 62) as sb,(eex>=100 and eey between 18 and 62) as eb,(is_shot or e_goal or type_c like '%shot%') as e_shot,(e_pass or e_cross or e_carry) as mv from {_E2}),
 b as (select *, least(greatest(0.08,positive_league_xt,xg)+0.22*eb::int+0.16*(mv and eex>=80 and ex<80)::int+0.24*(mv and eb and not sb)::int+0.35*e_shot::int,1.4) as th,case when ey<80/3.0::double then 'left' when ey<=160/3.0::double then 'central' else 'right' end as lane,(e_pass or e_cross) as dl from a),
 c as (select *, unnest(list_filter([case when e_corner then 'corner' end,case when e_free_kick then 'free_kick' end,case when e_throw_in then 'throw_in' end], lambda z: z is not null)) as family from b)
 select nation,tier,season,team,opponent,family,count(*) as events,count(*) filter (dl) as deliveries,count(*) filter (dl and round(th,9)>=0.35) as high_threat,count(*) filter (e_shot) as shots,count(*) filter (e_goal) as goals,sum(xg) as xg,count(*) filter (dl and lane='left') as ld,count(*) filter (dl and lane='central') as cd,count(*) filter (dl and lane='right') as rd from c group by all""")
_SS = "sum(events)::bigint as events,sum(deliveries)::bigint as deliveries,sum(high_threat)::bigint as high_threat,sum(shots)::bigint as shots,sum(goals)::bigint as goals,sum(xg) as xg,sum(ld)::bigint as left_deliveries,sum(cd)::bigint as central_deliveries,sum(rd)::bigint as right_deliveries"
cte("spp", f"select nation,tier,season,team,family,{_SS},'for' as direction from spp0 group by 1,2,3,4,5 union all select nation,tier,season,opponent,family,{_SS},'against' from spp0 group by 1,2,3,4,5")


@query("a37_set_piece_profile", "select * from spp")
def a37(t: Tables):
    return season.set_piece_profile(t.valued)


_C = {"passes": "e_pass", "good_passes": "e_pass and e_success", "shots": "e_shot", "on_target": "e_on_target", "goals": "e_goal", "final_third_entries": "e_final_third", "box_entries": "e_box", "crosses": "e_cross", "good_crosses": "e_cross and e_success", "high_regains": "e_regain", "defensive_actions": "e_defensive", "set_piece_shots": "e_set_piece and e_shot", "central_entries": "e_box and e_central", "wide_entries": "e_box and e_wide"}
_A = ",".join(f"count(*) filter ({r}) as {k}" for k, r in _C.items())
_AA = ",".join(f"count(*) filter ({r}) as {k}_against" for k, r in _C.items())
cte("dash", f"""with o as (select {_K},count(distinct match_id) as matches,count(*) as events,{_A} from fe group by all), a as (select nation,tier,season,opponent as team,count(*) as events_against,{_AA} from fe group by all),
 v as (select {_K},sum(xg) as xg,sum(case when is_penalty then 0 else xg end) as np_xg,sum(positive_league_xt) as xt,sum(case when is_set_piece then positive_league_xt else 0 end) as set_piece_xt from pv group by all), w as (select nation,tier,season,opponent as team,sum(xg) as xg_against,sum(case when is_penalty then 0 else xg end) as np_xg_against,sum(positive_league_xt) as xt_against from pv group by all)
 select *, case when passes>0 then 100.0*good_passes/passes else 0 end as pass_pct,case when crosses>0 then 100.0*good_crosses/crosses else 0 end as cross_pct,case when box_entries_against>0 then 100-100.0*central_entries_against/box_entries_against else 100 end as central_protection,100.0*events/(events+events_against) as event_share,xg/greatest(shots,1) as xg_per_shot,xg-xg_against as xg_difference
 from o left join a using({_K}) left join v using({_K}) left join w using({_K})""")


@query("a59_season_dashboard", "select * from dash", trained=True)
def a59(t: Tables):
    return season.dashboard(t.e, t.valued)


cte("fast_", """select nation,tier,season,team,count(*) filter (e_regain and exists(select 1 from fe n where n.match_id=f.match_id and n.period=f.period and n.team=f.team and (n.e_shot or n.e_box or n.e_final_third) and n.clock_s>f.clock_s and n.clock_s<=f.clock_s+15)) as fast_attacks from fe f group by 1,2,3,4""")


def _cap(c: str, k: float) -> str:
    return f"least(100,{c}*{k})"


_PH = {
    "in_possession": "greatest(field_tilt,event_share)+final_third_for*2+event_share+xt", "chance_creation": "shots_for+xg_for+xa*2+box_for", "box_threat": "final_third_for+box_for+xg_for*2+xt",
    "defensive_control": "shots_against+xg_against+regains+defensive_actions+box_against", "transitions": f"regains+{_cap('ca',8)}+{_cap('rs',10)}+{_cap('fa',8)}+100-{_cap('ls',3)}",
    "set_pieces": f"{_cap('spc',3)}+{_cap('spf',2)}+{_cap('spt',1.2)}+{_cap('spx',25)}+100-{_cap('spa',25)}", "player_influence": f"{_cap('depth',6)}+{_cap('shooters',15)}+{_cap('prog',12)}+{_cap('dfs',8)}+{_cap('spec',16)}",
}
_PV = ",".join(f"max(percentile) filter (metric='{m}') as {m}" for m in ["field_tilt", "final_third_for", "xt", "shots_for", "xg_for", "xa", "box_for", "shots_against", "xg_against", "regains", "defensive_actions", "box_against"])
cte("phw", f"""with p as (select {_K},{_PV} from rad group by all), k as (select distinct {_K},match_id from prep), tr as (select {_K},sum(counter_attacks)::double as ca,sum(regains_to_shot)::double as rs,sum(losses_to_shot)::double as ls from trans join k using(match_id,team) group by all),
 sp as (select {_K},sum(case when direction='for' and family='corner' then events else 0 end)::double as spc,sum(case when direction='for' and family='free_kick' then events else 0 end)::double as spf,sum(case when direction='for' and family='throw_in' then events else 0 end)::double as spt,sum(case when direction='for' then xg else 0 end) as spx,sum(case when direction='against' then xg else 0 end) as spa from spp group by all),
 pl as (select {_K},count(*) filter (score>0) as depth,count(*) filter (shots>0) as shooters,count(*) filter (final_third_entries>0) as prog,count(*) filter (defensive_actions>0) as dfs,count(*) filter (set_pieces>0) as spec from pinv group by all)
 select p.*,d.event_share,tr.ca,tr.rs,tr.ls,f.fast_attacks as fa,sp.spc,sp.spf,sp.spt,sp.spx,sp.spa,pl.depth,pl.shooters,pl.prog,pl.dfs,pl.spec from p join dash d using({_K}) left join tr using({_K}) left join fast_ f using({_K}) left join sp using({_K}) left join pl using({_K})""")


@query("a60_phase_percentiles", "select *, case when score>=72 then 'Strong' when score>=48 then 'Competitive' else 'Needs work' end as strength from (" + " union all ".join(f"select {_K},'{k}' as phase,(({e})/5)::double as score from phw" for k, e in _PH.items()) + ")", trained=True)
def a60(t: Tables):
    keys = t.log.select(*league.TEAM, "match_id").distinct()
    tr = links.transition_outcomes(t.valued).join(keys, ["match_id", "team"]).withColumn("fast_attacks", F.lit(0).cast("bigint"))
    fast = links.fast_attacks(t.e).select(*league.TEAM, F.lit(0).cast("bigint").alias("counter_attacks"), F.lit(0).cast("bigint").alias("regains_to_shot"), "fast_attacks", F.lit(0).cast("bigint").alias("losses_to_shot"))
    cols = [*league.TEAM, "counter_attacks", "regains_to_shot", "fast_attacks", "losses_to_shot"]
    return season.phase_percentiles(_radar(t, t.valued), season.dashboard(t.e, t.valued), tr.select(*cols).unionByName(fast.select(*cols)), season.set_piece_profile(t.valued), t.involvement)


for _n, _q in (("b20", "a20_chain_funnel"), ("b23", "a23_disruption"), ("b24", "a24_height_profile"), ("b22", "a22_duel_control")):
    cte(_n, ORACLES[_q])


@query("a66_defensive_bundle", """select a.match_id,a.team,o.attacks as opp_attacks,o.reached_final as opp_reached_final,o.entered_box as opp_entered_box,o.chains_with_shots as opp_chains_with_shots,p.presses,p.forced_total,p.escapes,h.mean_x,h.block_label,d.duels,d.won as duels_won,s.high,s.middle,s.low,s.forced_back,s.regains_after_loss,l.player as leader,l.score as leader_score
 from b20 a join b20 o on o.match_id=a.match_id and o.team<>a.team left join press p on p.match_id=a.match_id and p.team=a.team left join b24 h on h.match_id=a.match_id and h.team=a.team left join b22 d on d.match_id=a.match_id and d.team=a.team left join b23 s on s.match_id=a.match_id and s.team=a.team left join dlead l on l.match_id=a.match_id and l.team=a.team and l.pos=1""")
def a66(t: Tables):
    return season.defensive_bundle(t.valued)


@query("j04_chain_metric_lookup", """with a as (select *, lag(team_key) over (partition by match_id order by period,expanded_minute,event_index) as pt from log), c as (select *, sum(case when pt is null or pt<>team_key then 1 else 0 end) over (partition by match_id order by period,expanded_minute,event_index)::bigint as chain_id from a)
 select c.match_id,c.chain_id,count(*) as rows,sum(coalesce(v.xg,0)) as xg,sum(coalesce(v.league_xt_added,0)) as xt from c left join (select match_id,event_index,xg,league_xt_added from pv) v using(match_id,event_index) group by 1,2""")
def j04(t: Tables):
    m = t.valued.select("match_id", "event_index", "xg", "league_xt_added")
    df = sequences.season_chains(t.log).join(m, ["match_id", "event_index"], "left").na.fill(0.0, ["xg", "league_xt_added"])
    return df.groupBy("match_id", "chain_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("xg").alias("xg"), F.sum("league_xt_added").alias("xt"))


# ------------------------------------------------------------------ streaming

@query("t01_stream_ingest", "select season,match_id,count(*) as rows,count(*) filter (is_shot) as shots,count(*) filter (box_entry) as box_entries from fb group by 1,2")
def t01(t: Tables):
    df = pipelines.ingest_by_match(t.spark, t.sf_dir)
    return df.groupBy("season", "match_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_shot").alias("shots"), F.count_if("box_entry").alias("box_entries"))


@query("t02_stream_momentum", """with w as (select to_timestamp(floor(epoch(e.ts)/600)*600)::timestamp as window_start,f.* from fb f join events e using(event_id)), m as (select max(ts)-interval 10 minute as wm from events)
 select window_start,window_start+interval 10 minute as window_end,match_id,team,count(*) as event_count,count(*) filter (is_shot) as shots,count(*) filter (box_entry) as box_entries from w,m where window_start+interval 10 minute<=date_trunc('millisecond',wm) group by all""")
def t02(t: Tables):
    return pipelines.run_to_table(pipelines.momentum_windows(pipelines.event_stream(t.spark, t.sf_dir)), "momentum")


@query("t03_stream_chains", """with a as (select e.ts,l.match_id,l.team_side,l.is_shot,lag(e.ts) over (partition by l.match_id,l.team_side order by e.ts) as pt from log l join events e using(event_id)),
 c as (select *, sum(case when pt is null or ts-pt>=interval 5 minute then 1 else 0 end) over (partition by match_id,team_side order by ts) as ch from a), g as (select min(ts) as chain_start,max(ts)+interval 5 minute as chain_end,match_id,team_side,count(*) as actions,count(*) filter (is_shot) as shots from c group by match_id,team_side,ch)
 select g.* from g,(select max(ts)-interval 10 minute as wm from events) where chain_end<=date_trunc('millisecond',wm)""")
def t03(t: Tables):
    return pipelines.run_to_table(pipelines.gap_chains(pipelines.event_stream(t.spark, t.sf_dir)), "chains")


@query("t04_stream_dedupe", "select event_id,user_id,event_type from events")
def t04(t: Tables):
    ev = pipelines.event_stream(t.spark, t.sf_dir)
    again = ev.unionByName(pipelines.event_stream(t.spark, t.sf_dir).where("event_type = 'click'"))
    return pipelines.run_to_table(pipelines.deduplicated(again), "dedupe").select("event_id", "user_id", "event_type")


@query("t05_stream_score", "select s.match_id,s.event_index,s.home_after,s.away_after from score s join fc f using(match_id,event_index) where f.is_goal")
def t05(t: Tables):
    return pipelines.latest_scores(pipelines.run_to_table(pipelines.score_state(pipelines.event_stream(t.spark, t.sf_dir)), "score"))


@query("t03_stream_attack_chains", "select match_id,event_index::double as event_index,attack_chain_id from chains")
def t03_chains(t: Tables):
    return pipelines.latest_values(pipelines.run_to_table(pipelines.attack_chains(pipelines.event_stream(t.spark, t.sf_dir)), "stream-chains"))


@query("t05_stream_score_at_events", "select match_id,event_index::double as event_index,home_after,away_after from score")
def t05_events(t: Tables):
    return pipelines.latest_values(pipelines.run_to_table(pipelines.score_at_every_event(pipelines.event_stream(t.spark, t.sf_dir)), "stream-event-scores"))


@query("t06_refresh_trigger", "select 1::int as run,count(*) as rows from events union all select 2,0")
def t06(t: Tables):
    return pipelines.refresh_runs(t.spark, t.sf_dir)
