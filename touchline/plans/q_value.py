"""Value grid, shot features, assists."""

from pyspark.sql import functions as F

from touchline.operators import sequences as seq
from touchline.operators import value
from touchline.plans.oracle_base import cte
from touchline.plans.registry import Tables, query
from touchline.functions import flags


@query("a49_zone_counts", """select nation,tier,season,zone_start,actions::bigint as actions,moves::bigint as moves,shots::bigint as shots,goals::bigint as goals,
 moves/actions as move_p, shots/actions as shot_p, case when shots>0 then goals/shots else 0 end as goal_p from zrow""")
def a49(t: Tables):
    return value.zone_model(value.zone_cells(t.f, value.LEAGUE), value.LEAGUE)


@query("a49_zone_transitions", "select nation,tier,season,zone_start,zone_end,moves from zcell where zone_end>=0")
def a49b(t: Tables):
    return value.zone_cells(t.f, value.LEAGUE).where("zone_end >= 0").select(*value.LEAGUE, "zone_start", "zone_end", "moves")


@query("m03_zone_values", "select * from xtm")
def m03(t: Tables):
    return t.grid


@query("m03_match_grids", "select match_id,zone,xt from mxt")
def m03_match(t: Tables):
    return value.solve_zones(value.zone_cells(t.f, value.MATCH), value.MATCH)


@query("j03_match_values", "select match_id,event_index,xt_added,positive_xt from mpv")
def j03_match(t: Tables):
    return t.match_valued.select("match_id", "event_index", "xt_added", "positive_xt")


@query("m04_action_values", """select p.match_id,p.event_index,p.action_type,s.xt as xt_start,e.xt as xt_end,e.xt-s.xt as xt_added
 from pf p join xtm s on s.zone=p.zone_start and s.nation=p.nation and s.tier=p.tier and s.season=p.season join xtm e on e.zone=p.zone_end and e.nation=p.nation and e.tier=p.tier and e.season=p.season where f_move""")
def m04(t: Tables):
    return value.value_actions(flags.flags_f(t.prep), t.grid).select("match_id", "event_index", "action_type", "xt_start", "xt_end", "xt_added")


@query("j03_attach_values", "select match_id,event_index,xt_added,positive_xt,xg from pv")
def j03(t: Tables):
    return t.valued.select("match_id", "event_index", "xt_added", "positive_xt", "xg")


@query("a09_player_xt", """select season,nation,tier,team,player,count(*) as actions,sum(league_xt_added) as xt,sum(case when not f_set_piece then league_xt_added else 0 end) as open_play_xt,
 sum(case when f_set_piece then league_xt_added else 0 end) as set_piece_xt,sum(case when action_type='pass' then league_xt_added else 0 end) as pass_xt,
 sum(case when action_type='cross' then league_xt_added else 0 end) as cross_xt,sum(case when action_type='carry' then league_xt_added else 0 end) as carry_xt
 from pv where f_move group by 1,2,3,4,5""")
def a09(t: Tables):
    from touchline.operators.players import player_xt

    return player_xt(value.value_actions(flags.flags_f(t.prep), t.grid))


@query("k04_top_actions", """with a as (select match_id,event_index,team,player,action_type,xt_added,row_number() over (partition by match_id order by round(xt_added,9) desc,event_index)::int as pos from pv where f_move)
 select * from a""")
def k04(t: Tables):
    from touchline.operators.topk import top_per_group

    df = t.valued.where("(f_pass or f_carry) and f_success and zone_start >= 0 and zone_end >= 0")
    return top_per_group(df, ["match_id"], [F.round("xt_added", 9).desc(), F.col("event_index")]).select(
        "match_id", "event_index", "team", "player", "action_type", "xt_added", "pos")


cte("feat", """with s as (select *, x*1.05 as x_105, y*0.68 as y_68 from poss where f_shot),
 g as (select *, sqrt(power(105-x_105,2)+power(34-y_68,2)) as d, sqrt(power(105-x_105,2)+power(30.34-y_68,2)) as pa, sqrt(power(105-x_105,2)+power(37.66-y_68,2)) as pb from s)
 select event_id,coalesce(x_105,0) as shot_x,coalesce(y_68,0) as shot_y,coalesce(abs(y_68-34),0) as y_from_centre,coalesce(d,0) as distance,coalesce(d*d,0) as distance_sq,
 case when x is null or y is null or pa*pb=0 then 0 else acos(least(greatest((pa*pa+pb*pb-7.32*7.32)/(2*pa*pb),-1::double),1::double)) end as angle,
 coalesce(x_105>=88 and y_68 between 13.84 and 54.16,false)::int as inside_box,coalesce(y_68 between 24 and 44,false)::int as central_lane,
 f_big_chance::int as big_chance,f_header::int as header,f_first_time::int as first_time,f_rebound::int as rebound,f_fast_break::int as fast_break,
 prev_through::int as through_ball_assist,prev_cross::int as cross_assist,prev_cutback::int as cutback_assist,coalesce(prev_carry and prev_player=player,false)::int as carry_before_shot,
 prev_pass::int as prev_pass,prev_carry::int as prev_carry_i,least(greatest(coalesce(expanded_minute-prev_minute,99)*60,0),99) as prev_seconds,possession_action::double as action_number,
 f_goal::int as goal, case when f_penalty then 'penalty' when f_direct_fk then 'direct_free_kick' when f_header then 'header' when f_set_piece then 'set_piece' else 'open_play' end as shot_family from g""")


@query("p39_shot_features", "select * exclude (shot_family) from feat")
def p39(t: Tables):
    return value.shot_features(seq.possessions(t.f)).select(
        "event_id", *value.FEATURES[:-3],
        F.expr("cast(prev_carry as int)").alias("prev_carry_i"), "prev_seconds", "action_number", "goal",
    ).withColumn("prev_pass", F.col("prev_pass").cast("int"))


@query("p40_shot_family", "select event_id,shot_family from feat")
def p40(t: Tables):
    return value.shot_features(seq.possessions(t.f)).select("event_id", "shot_family")


cte("assist", """with s as (select p.*, l.xg as sxg from poss p join logx l using(event_id) where p.f_shot),
 pr as (select s.match_id,s.event_index as shot_index,s.sxg,s.f_set_piece as sp,s.f_goal as sg,s.season,s.nation,s.tier,q.player,q.player_id,q.team,q.event_index as qi,
   (q.f_success and q.f_pass) as ok_pass,(q.f_success and q.f_carry) as ok_carry
   from s join poss q on q.match_id=s.match_id and q.possession_id=s.possession_id and q.event_index<s.event_index),
 r as (select *, row_number() over (partition by match_id,shot_index order by qi desc) as rn, 'p' as kind from pr where ok_pass
   union all select *, row_number() over (partition by match_id,shot_index order by qi desc) as rn, 'c' as kind from pr where ok_carry)
 select season,nation,tier,match_id,shot_index,sxg as xg,sp as f_set_piece,sg as f_goal,case when kind='c' then 'carry' when rn=1 then 'assist' else 'secondary' end as role,player,player_id,team
 from r where (kind='p' and rn<=2) or (kind='c' and rn=1)""")


@query("j17_shot_assists", "select * from assist")
def j17(t: Tables):
    return t.credits


@query("a07_player_xg", """with s as (select ff.*, l.xg, f.shot_family as fam from ff join logx l using(event_id) join feat f using(event_id) where ff.f_shot)
 select season,nation,tier,team,player,player_id,count(*) as shots,count(*) filter (f_goal) as goals,sum(xg) as xg,count(*) filter (f_goal)-sum(xg) as goals_minus_xg,sum(xg)/count(*) as xg_per_shot,
 sum(case when fam='open_play' then xg else 0 end) as open_play_xg,sum(case when fam='set_piece' then xg else 0 end) as set_piece_xg,sum(case when fam='header' then xg else 0 end) as header_xg,
 sum(case when fam='direct_free_kick' then xg else 0 end) as direct_free_kick_xg,sum(case when fam='penalty' then xg else 0 end) as penalty_xg,sum(case when fam<>'penalty' then xg else 0 end) as non_penalty_xg,
 count(*) filter (f_big_chance) as big_chances from s group by 1,2,3,4,5,6""", trained=True)
def a07(t: Tables):
    from touchline.operators.players import player_xg

    return player_xg(t.shots)


@query("a08_player_xa", """select season,nation,tier,team,player,player_id,sum(case when role='assist' then xg else 0 end) as xa,
 sum(case when role='assist' and not f_set_piece then xg else 0 end) as open_play_xa,sum(case when role='assist' and f_set_piece then xg else 0 end) as set_piece_xa,
 sum(case when role='secondary' then xg else 0 end) as secondary_xa,sum(case when role='carry' then xg else 0 end) as carry_to_shot_xg,count(*) filter (role='assist') as shot_assists,
 count(*) filter (role='assist' and f_goal) as goal_assists,case when count(*) filter (role='assist')>0 then sum(case when role='assist' then xg else 0 end)/count(*) filter (role='assist') else 0 end as xa_per_shot_assist
 from assist group by 1,2,3,4,5,6""", trained=True)
def a08(t: Tables):
    from touchline.operators.players import player_xa

    return player_xa(t.credits)
