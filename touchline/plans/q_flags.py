"""Projections: flag sets, text cleaning, geometry, rule values."""

from pyspark.sql import functions as F

from touchline.functions import flags, geometry, shots, text
from touchline.plans.oracle_base import cte
from touchline.plans.registry import Tables, query

_A = "successful,is_pass_like,is_carry,is_shot_event,is_defensive_action,is_final_third_pass"
_B = ("is_goal,is_shot,is_touch,is_pass,is_cross,is_carry,is_defensive_action,is_card,is_yellow_card,is_second_yellow,"
      "is_red_card,is_corner_awarded,is_corner_taken,is_from_corner,is_free_kick_taken,is_from_free_kick,is_throw_in,"
      "is_from_throw_in,is_penalty,is_corner,is_free_kick,is_set_piece_restart,is_set_piece,final_third_entry,box_entry,"
      "attacking_third_touch,high_regain,is_success")
_C = ("is_goal,is_shot,is_touch,is_pass,is_cross,is_take_on,is_carry,is_defensive_action,is_card,is_yellow_card,"
      "is_second_yellow,is_red_card,is_corner,is_free_kick,is_penalty,is_throw_in,is_set_piece,is_success,"
      "final_third_entry,box_entry,attacking_third_touch,high_regain,shirt_no")
_D = ("d_goal,d_shot,d_on_target,d_pass,d_cross,d_take_on,d_carry,d_inferred,d_progressive_carry,d_carry_final_third,"
      "d_carry_box,d_defensive,d_foul,d_interception,d_card,d_yellow,d_red,d_second_yellow,d_corner_awarded,"
      "d_corner_taken,d_free_kick,d_throw_in,d_penalty,d_penalty_awarded,d_set_piece,d_final_third,d_box,d_regain")
_E = ("ex,ey,eex,eey,e_goal,e_shot,e_on_target,e_pass,e_cross,e_carry,e_move,e_success,e_defensive,e_set_piece,e_corner,"
      "e_free_kick,e_throw_in,e_final_third,e_box,e_regain,e_wide,e_central,e_start_box,e_end_box")
_F = ("f_goal,f_pass,f_carry,f_cross,f_big_chance,f_header,f_first_time,f_rebound,f_fast_break,f_through,f_cutback,"
      "f_penalty,f_direct_fk,f_success,f_shot,f_set_piece")


def pick(df, names: str, *extra: str):
    return df.select("event_id", *extra, *names.split(","))


@query("p02_base_projection", f"select event_id,x_120,y_80,end_x_120,end_y_80,{_A} from fa")
def p02(t: Tables):
    return pick(t.a, "x_120,y_80,end_x_120,end_y_80," + _A)


@query("p13_store_flags", f"select event_id,{_B} from fb")
def p13(t: Tables):
    return pick(t.b, _B)


@query("p14_match_flags", f"select event_id,{_C} from fc")
def p14(t: Tables):
    return pick(t.c, _C)


@query("p15_strict_masks", f"select match_id,event_index,{_D} from fd")
def p15(t: Tables):
    return t.d.select("match_id", "event_index", *_D.split(","))


@query("p16_season_masks", f"select event_id,{_E} from fe")
def p16(t: Tables):
    return pick(t.e, _E)


@query("p17_value_flags", f"select event_id,{_F} from ff")
def p17(t: Tables):
    return pick(t.f, _F)


# ------------------------------------------------------------------ cleaning

@query(
    "p01_alias_columns",
    "select e.event_id as match_id, e.user_id as player_id, e.event_type as type, e.value as provider_xg from events e",
)
def p01(t: Tables):
    raw = t.events.selectExpr("event_id as gameId", "user_id as playerId", "event_type as eventType", "value as expectedGoals")
    return text.alias_columns(
        raw,
        {
            "match_id": ["match_id", "matchid", "matchId", "game_id", "gameId", "id"],
            "player_id": ["player_id", "playerId"],
            "type": ["type", "event_type", "eventType"],
            "provider_xg": ["xg", "expected_goals", "expectedGoals"],
        },
    )


@query(
    "p03_qualifier_parse",
    """select event_id, list_sort(list_distinct(list_transform(q, lambda z: z.t))) as tag_names,
       (list_filter(q, lambda z: z.t='Zone'))[-1].v as zone, len(list_distinct(list_transform(q, lambda z: z.t))) as n_tags
       from (select event_id, [{t:'Kind',v:event_type},{t:'Zone',v:(k%5)::varchar}] ||
             case when k%3=0 then [{t:'Zone',v:'last'}] else [] end ||
             case when k%4=0 then [{t:'Flag',v:'true'}] else [] end as q
             from (select event_id,event_type,cast(json_extract_string(props,'$.k') as int) as k from events))""",
)
def p03(t: Tables):
    from touchline.sources.documents import parse_qualifiers

    raw = t.events.selectExpr("event_id", "event_type", "try_cast(get_json_object(props,'$.k') as int) as k").selectExpr(
        "event_id",
        "case when k % 2 = 0 then concat('[{\"type\":\"Kind\",\"value\":\"', event_type, '\"},{\"type\":\"Zone\",\"value\":\"', k % 5, '\"}',"
        " if(k % 3 = 0, ',{\"type\":\"Zone\",\"value\":\"last\"}', ''), if(k % 4 = 0, ',{\"type\":{\"displayName\":\"Flag\"}}', ''), ']')"
        " else concat('[{\\'type\\': \\'Kind\\', \\'value\\': \\'', event_type, '\\'}, {\\'type\\': \\'Zone\\', \\'value\\': ', k % 5, '}',"
        " if(k % 3 = 0, ', {\\'type\\': \\'Zone\\', \\'value\\': \\'last\\'}', ''), ']') end as qualifiers",
    )
    return parse_qualifiers(raw).selectExpr(
        "event_id", "array_sort(map_keys(qual_map)) as tag_names", "qual_map['Zone'] as zone",
        "cast(size(qual_map) as bigint) as n_tags",
    )


@query(
    "p04_end_from_qualifiers",
    """select event_id, coalesce(end_x, case when event_id%3=0 then event_id%100 end::double) as end_x,
       coalesce(end_y, case when event_id%3=0 then 100-event_id%100 end::double) as end_y from log""",
)
def p04(t: Tables):
    from touchline.operators.normalise import end_point_from_qualifiers

    df = t.log.withColumn(
        "qual_map",
        F.expr("if(event_id % 3 = 0, map('PassEndX', string(event_id % 100), 'PassEndY', string(100 - event_id % 100)),"
               " map('PassEndX', 'n/a'))"),
    )
    return end_point_from_qualifiers(df).select("event_id", "end_x", "end_y")


@query(
    "p05_numeric_coercion",
    """select o_orderkey, try_cast(replace(o_orderpriority,'-','.') as double) as priority_number,
       try_cast(substr(o_orderpriority,1,1) as double) as priority_rank from orders""",
)
def p05(t: Tables):
    df = t.table("orders").selectExpr(
        "o_orderkey", "replace(o_orderpriority,'-','.') as priority_number", "substr(o_orderpriority,1,1) as priority_rank"
    )
    return df.select("o_orderkey", text.number("priority_number").alias("priority_number"),
                     text.number("priority_rank").alias("priority_rank"))


_PTXT = "(['FirstHalf','SecondHalf','2h','ET1','penalties','','1','2.0','Extra Time Second Half','whatever'])[event_id%10+1]"


@query(
    "p06_period_number",
    f"""select event_id, case {_PTXT} when 'SecondHalf' then 2 when '2h' then 2 when '2.0' then 2 when 'ET1' then 3
        when 'Extra Time Second Half' then 4 when 'penalties' then 5 else 1 end as period from events""",
)
def p06(t: Tables):
    df = t.events.selectExpr(
        "event_id",
        "element_at(array('FirstHalf','SecondHalf','2h','ET1','penalties','','1','2.0','Extra Time Second Half','whatever'),"
        " cast(event_id % 10 as int) + 1) as p",
    )
    return df.select("event_id", text.period_number(F.col("p")).alias("period"))


@query(
    "p07_unit_rescale",
    """with m as (select season,nation,tier,max(x)/100 as mx, max(y) as my from log group by all)
       select event_id, case when mx<=1.5 then (x/100)*100 else x/100 end as x, case when my<=1.5 then y*100 else y end as y
       from log join m using(season,nation,tier)""",
)
def p07(t: Tables):
    from touchline.operators.normalise import rescale_unit_coordinates

    df = t.log.withColumn("x", F.expr("x / 100D"))
    return rescale_unit_coordinates(df, ["x", "y"], ["season", "nation", "tier"]).select("event_id", "x", "y")


@query(
    "p08_expanded_minute",
    """select event_id, coalesce(case when event_id%4=0 then null else minute end, minute)::double + coalesce(second,0)/60.0 as expanded_minute from log""",
)
def p08(t: Tables):
    from touchline.operators.normalise import expanded_minute

    df = t.log.withColumn("expanded_minute", F.expr("if(event_id % 4 = 0, null, cast(minute as double))"))
    return expanded_minute(df).select("event_id", "expanded_minute")


_BLANK = "case event_id%5 when 0 then ' ' when 1 then 'nan' when 2 then 'None' when 3 then null else team end"


@query(
    "p09_first_non_blank",
    "select event_id, case when event_id%5=4 then team when event_id%2=0 then player else opponent end as label from log",
)
def p09(t: Tables):
    df = t.log.selectExpr("event_id", f"{_BLANK} as a", "if(event_id % 2 = 0, player, 'null') as b", "opponent as c")
    return df.select("event_id", text.first_non_blank(F.col("a"), F.col("b"), F.col("c")).alias("label"))


@query("p10_truthy_text", "select event_id, coalesce(event_id%6 in (0,1,2,3),false) as flag from events")
def p10(t: Tables):
    df = t.events.selectExpr(
        "event_id", "element_at(array('TRUE',' 1','yes','Y','0',null), cast(event_id % 6 as int) + 1) as raw"
    )
    return df.select("event_id", text.truthy(F.col("raw")).alias("flag"))


@query(
    "p11_pitch_rescale",
    """select event_id, x*1.2 as x_120, y*0.8 as y_80,
       case when x is not null then least(greatest(case when m.mx<=1.5 then x*1.2*100 when m.mx>105 then x*1.2/1.2 else x*1.2 end,0),100) end as x_pct
       from log cross join (select max(x*1.2) as mx from log) m""",
)
def p11(t: Tables):
    from touchline.operators.normalise import to_percent

    df = t.log.select("event_id", (F.col("x") * 1.2).alias("x_120"), (F.col("y") * 0.8).alias("y_80"))
    return to_percent(df, "x_120", 1.2, "x_pct")


@query("p12_match_order", "select event_id, row_number() over (partition by match_id order by period,expanded_minute,event_index) as pos from log")
def p12(t: Tables):
    from touchline.operators.ordering import match_window

    return t.log.select("event_id", F.row_number().over(match_window()).cast("bigint").alias("pos"))


@query("p18_compact_text", "select doc_id, length(c) as n, md5(c) as digest from (select doc_id, regexp_replace(lower(text),'[^a-z0-9]+','','g') as c from documents)")
def p18(t: Tables):
    df = t.table("documents").select("doc_id", text.compact(F.col("text")).alias("c"))
    return df.selectExpr("doc_id", "cast(length(c) as bigint) as n", "md5(c) as digest")


@query("p19_null_words", "select event_id, case when event_id%5=4 then team end as team from log")
def p19(t: Tables):
    return t.log.selectExpr("event_id", f"{_BLANK} as raw").select("event_id", text.clean(F.col("raw")).alias("team"))


@query(
    "p20_team_key",
    f"""select doc_id, length(k) as n, md5(k) as digest from (select doc_id, regexp_replace(replace(lower(translate(text||' & Co','{text.ACCENTED}','{text.PLAIN.replace(chr(39), chr(39) * 2)}')),'&','and'),'[^a-z0-9]+','','g') as k from documents)""",
)
def p20(t: Tables):
    df = t.table("documents").select("doc_id", text.team_key(F.concat("text", F.lit(" & Co"))).alias("k"))
    return df.selectExpr("doc_id", "cast(length(k) as bigint) as n", "md5(k) as digest")


@query(
    "p21_slug",
    "select page_id, regexp_replace(regexp_replace(coalesce(url,''),'[^A-Za-z0-9_.]','_','g'),'^_+|_+$','','g') as slug from pages",
)
def p21(t: Tables):
    return t.table("pages").select("page_id", text.slug(F.col("url")).alias("slug"))


# ------------------------------------------------------------------ geometry

@query(
    "p30_lanes",
    """select event_id, case when y is null then 'unknown' when y<33.333 then 'left' when y<66.667 then 'central' else 'right' end as lane3,
       case when y is null then 'unknown' when y<18 then 'left_wide' when y<38 then 'left_half_space' when y<=62 then 'central' when y<=82 then 'right_half_space' else 'right_wide' end as lane5,
       case when y is null then 'unknown' when y<18 or y>82 then 'wide' when y<38 or y>62 then 'half_space' else 'central' end as family,
       case when ey<80/3.0::double then 'left' when ey<=160/3.0::double then 'central' else 'right' end as lane_wide_pitch from fe""",
)
def p30(t: Tables):
    df = t.e.select("event_id", geometry.lane3("y").alias("lane3"), geometry.lane5("y").alias("lane5"),
                    geometry.lane_120("ey").alias("lane_wide_pitch"))
    return df.withColumn("family", geometry.lane_family("lane5"))


@query(
    "p31_zones",
    """select event_id, coalesce(x>=83 and y between 21.1 and 78.9,false) as in_box,
       coalesce((x>=83 and y between 21.1 and 78.9) or (x>=78 and y between 24 and 76),false) as in_danger,
       case when x is null then null else least(floor(x*7/100),6)::int end as threat_col,
       case when y is null then null else least(floor(y*3/100),2)::int end as threat_row,
       (case when goal_mouth_z<33.333 then 'low' when goal_mouth_z<66.667 then 'middle' else 'high' end)||' '||
       (case when y<33.333 then 'left' when y<66.667 then 'centre' else 'right' end) as goal_zone from log""",
)
def p31(t: Tables):
    return t.log.select(
        "event_id", geometry.in_box("x", "y").alias("in_box"), geometry.in_danger("x", "y").alias("in_danger"),
        geometry.grid_cell("x", 7).alias("threat_col"), geometry.grid_cell("y", 3).alias("threat_row"),
        geometry.goal_zone("y", "goal_mouth_z").alias("goal_zone"),
    )


@query(
    "p41_value_zone",
    """select event_id, case when x is null or y is null then -1 else (least(greatest(floor(y*12/100),0),11)*16+least(greatest(floor(x*16/100),0),15))::int end as zone_start,
       case when end_x is null or end_y is null then -1 else (least(greatest(floor(end_y*12/100),0),11)*16+least(greatest(floor(end_x*16/100),0),15))::int end as zone_end,
       case when f_carry then 'carry' when f_cross then 'cross' when f_pass then 'pass' else 'other' end as action_type from ff""",
)
def p41(t: Tables):
    from touchline.operators.value import with_zones

    return with_zones(t.f).select("event_id", "zone_start", "zone_end", "action_type")


@query(
    "p42_grid_edges",
    """select match_id, list_transform(range(0,17), lambda i: i*120.0/16) as x_edges, list_transform(range(0,13), lambda i: i*80.0/12) as y_edges,
       list_transform(range(0,16), lambda i: (i+0.5)*120.0/16) as x_centres from sched""",
)
def p42(t: Tables):
    return t.schedule.select(
        "match_id", geometry.grid_edges(120, 16).alias("x_edges"), geometry.grid_edges(80, 12).alias("y_edges"),
        geometry.grid_centres(120, 16).alias("x_centres"),
    )


@query("p44_flip", "select event_id,100-x as x,100-y as y,100-end_x as end_x,100-end_y as end_y from log")
def p44(t: Tables):
    from touchline.operators.normalise import flip

    return flip(t.log, ["x", "y", "end_x", "end_y"]).select("event_id", "x", "y", "end_x", "end_y")


@query("p57_event_clock", "select event_id, expanded_minute*60 as clock_s, expanded_minute*60+(period-1)*2700 as staggered_s from log")
def p57(t: Tables):
    return t.log.selectExpr("event_id", "expanded_minute * 60 as clock_s", "expanded_minute * 60 + (period - 1) * 2700 as staggered_s")


# ------------------------------------------------------------------ shot values

@query("p35_rule_xg_match", "select event_id, xg from logx where is_shot")
def p35(t: Tables):
    return t.log.where("is_shot").select("event_id", shots.rule_xg_match().alias("xg"))


@query("p34_rule_xg_strict", "select event_id, xg_strict as xg from logs where is_shot")
def p34(t: Tables):
    return t.log.where("is_shot").select("event_id", shots.rule_xg_strict().alias("xg"))


XSE = """least(greatest(least(greatest(1-sqrt(power(120-ex,2)+power(40-ey,2))/92.0,0.02::double),0.38::double)
  + (case when e_start_box then 0.07 else 0 end)::double + (case when e_goal then 0.18 else 0 end)::double,0.01::double),0.78::double)"""


@query("p36_rule_xg_season", f"select event_id, {XSE} as xg from fe where e_shot")
def p36(t: Tables):
    return t.e.where("e_shot").select("event_id", shots.rule_xg_season().alias("xg"))


@query(
    "p37_provider_xg",
    """select match_id, team, count(*) as shots, count(provider_xg) as provider_values,
       case when count(provider_xg)>0 then sum(case when provider_xg is not null then least(greatest(provider_xg,0),1) end) else sum(xg_strict) end as xg,
       case when count(provider_xg)>0 then 'provider' else 'fallback' end as xg_source
       from logs where is_shot group by 1,2""",
)
def p37(t: Tables):
    from touchline.operators.facts import shot_value_by_source

    return shot_value_by_source(t.log.where("is_shot"))


@query(
    "p38_shot_geometry",
    """select event_id, d as goal_distance, case when x is not null and y is not null then case when a*b>0 then acos(least(greatest((a*a+b*b-7.32*7.32)/(2*a*b),-1::double),1::double)) else 0 end end as goal_angle from (
       select event_id,x,y,sqrt(power(105-x*1.05,2)+power(34-y*0.68,2)) as d, sqrt(power(105-x*1.05,2)+power(30.34-y*0.68,2)) as a, sqrt(power(105-x*1.05,2)+power(37.66-y*0.68,2)) as b
       from log where is_shot)""",
)
def p38(t: Tables):
    return shots.shot_geometry(t.log.where("is_shot")).select("event_id", "goal_distance", "goal_angle")


_GM = """
with s as (select *, coalesce(goal_mouth_y,blocked_y,end_y,y) as t0, list_transform(qual_tags, lambda z: lower(z)) as tags, type_c||outcome_c||qual_c as full_, type_c||outcome_c as txt from fc where is_shot),
h as (select *, case when t0>0 and t0<=1.5 then t0*100 else t0 end as target_y,
  case when goal_mouth_z is not null then case when goal_mouth_z>0 and goal_mouth_z<=1.5 then goal_mouth_z*100 else goal_mouth_z end
   when full_ like '%over%' or full_ like '%high%' then 108 when full_ like '%low%' then 18 when full_ like '%top%' then 82 when full_ like '%block%' then 35 else 50 end::double as vertical from s),
g as (select *, (target_y-44.618)/(55.382-44.618)*100 as horizontal from h),
f as (select *, (list_has_any(tags,['high','over','overbar']) or vertical>100) as off_high, horizontal<0 as off_left, horizontal>100 as off_right,
  txt like '%save%' as saved, txt like '%missed%' as missed, txt like '%block%' as blocked, txt like '%shotonpost%' as woodwork from g where horizontal is not null),
k as (select *, case when is_goal then 'goal' when blocked then 'blocked' when woodwork then 'woodwork' when off_high and off_left then 'over and left'
   when off_high and off_right then 'over and right' when off_high then 'over the bar' when off_left then 'wide left' when off_right then 'wide right'
   when saved then 'saved on target' when missed then 'missed' else 'on target plane' end as status from f)
select match_id,event_index,horizontal,vertical,status,
  case when status in ('goal','saved on target') then true when status in ('blocked','woodwork','missed') then false else not (off_high or off_left or off_right or missed) end as on_plane,
  case when off_left then least(horizontal,-8) when off_right then greatest(horizontal,108) else horizontal end::double as plot_x,
  case when off_high then greatest(vertical,108) else vertical end::double as plot_y from k"""
cte("gm", _GM)


@query("p32_goal_mouth", "select * from gm")
def p32(t: Tables):
    return shots.goal_mouth(t.c.where("is_shot")).select(
        "match_id", "event_index", "horizontal", "vertical", "status", "on_plane", "plot_x", "plot_y"
    )


@query("p33_shot_contact", "select event_id, case when regexp_matches(type_c||outcome_c||qual_c,'header|headed|headshot|aerial') then 'headed' else 'ground' end as contact from log where is_shot")
def p33(t: Tables):
    return t.log.where("is_shot").selectExpr(
        "event_id",
        "case when concat(type_c,outcome_c,qual_c) rlike 'header|headed|headshot|aerial' then 'headed' else 'ground' end as contact",
    )
