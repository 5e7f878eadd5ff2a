"""Common table expressions for the DuckDB checks, and the builder that joins them."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    CTES[name] = text.strip()


def _needs(text: str) -> list[str]:
    """Tables a statement reads: names after FROM, JOIN or FROM a, ..."""
    found = re.findall(r"(?:\bfrom|\bjoin)\s+(\w+)", text, re.I)
    found += re.findall(r"\bfrom\s+\w+\s*,\s*(\w+)", text, re.I)
    return [n for n in dict.fromkeys(found) if n in CTES]


def sql(body: str) -> str:
    """Prefix a statement with every table expression it uses, dependencies first."""
    body = body.strip()
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in _needs(CTES[name]):
            if other != name:
                visit(other)
        order.append(name)

    for name in _needs(body):
        visit(name)
    if not order:
        return body
    lead = "WITH RECURSIVE " if {"xtit", "mit"} & set(order) else "WITH "
    parts = [f"{n} AS {'MATERIALIZED ' if n in MATERIALISED else ''}({CTES[n]})" for n in order]
    tail = ", " + body[5:] if body[:5].upper() == "WITH " else "\n" + body
    return lead + ",\n".join(parts) + tail


MATERIALISED = {"log", "fc", "prep", "xtm", "mxt", "mpv", "pv", "pvp", "runs", "ochains"}

_SHOTS = "('Goal','SavedShot','MissedShots','BlockedShot','ShotOnPost')"

cte("raw0", """
select event_id as e, user_id as u, event_type as kind, value as v,
       cast(json_extract_string(props, '$.k') as bigint) as k,
       event_id // 200 as m, event_id % 200 as p
from events
""")
cte("raw1", """
select *, (e*7+k)%100 as q, (e*11+k*3)%100 as q2,
  m+1 as match_id, m//240 as league_no, (m//30)%8 as season_no, m%30 as match_round
from raw0
""")
cte("raw2", f"""
select *, match_round%6 as home_no, (match_round+1+match_round//6)%6 as away_no,
  (p//8)*216 + (p%8)*8 + k%8 as clock,
  case when (p//8+m)%2=0 then u%4<>0 else u%4=0 end as at_home,
  case when u%3=0 then (p//8+m)%14 else u%14 end+1 as shirt,
  case kind when 'view' then 'Pass'
    when 'click' then case when k%4=0 then 'TakeOn' when k%4=1 and k%3=0 then 'Carry' else 'Pass' end
    when 'purchase' then case when k%2=1 then 'Pass' when v>=100 then 'Goal' when k%10=8 then 'ShotOnPost'
         when k%3=0 then 'SavedShot' when k%3=1 then 'MissedShots' else 'BlockedShot' end
    when 'error' then (['Tackle','Tackle','Interception','Clearance','Foul','Card','Aerial','Challenge','Dispossessed','BlockedPass'])[k%10+1]
    else (['BallRecovery','BallRecovery','BallRecovery','BallTouch','BallTouch','BallTouch','CornerAwarded','SubstitutionOff','SubstitutionOn','KeeperPickup'])[k%10+1] end as type
from raw1
""")
cte("raw3", f"""
select *,
  'N'||(league_no//2) as nation, 'T'||(league_no%2+1) as tier,
  (2016+season_no)||'-'||(2017+season_no) as season,
  'Club '||substr('ABCDEF',cast(home_no+1 as int),1)||' '||league_no as home_team,
  'Club '||substr('ABCDEF',cast(away_no+1 as int),1)||' '||league_no as away_team,
  league_no*6+home_no as home_id, league_no*6+away_no as away_id,
  make_timestamp(2016+season_no,8,1,15,0,0) + to_days(cast(match_round*7 as int)) as kickoff,
  type in {_SHOTS} as is_shot,
  type in ('Pass','Carry','Goal','SavedShot','MissedShots','BlockedShot','ShotOnPost') as has_end,
  case when q<4 and type='Pass' then 'CornerTaken' when q<8 and type='Pass' then 'FreekickTaken'
    when q<12 and type='Pass' then 'ThrowinSetPiece' when q<20 and type='Pass' then 'Cross'
    when q<20 and type in {_SHOTS} then 'FromCorner' when q<23 and type in {_SHOTS} then 'Penalty'
    when q<30 and type='Pass' then 'Longball' when q<34 and type in {_SHOTS} then 'Freekick'
    when q<40 and type='Goal' then 'OwnGoal' when q<44 and type='Card' then 'VoidYellowCard'
    when q<50 and type='Pass' then 'Throughball' when q<53 then 'FastBreak' end as tag1,
  case when q2<12 then 'Head' when q2<20 and type in {_SHOTS} then 'BigChance' when q2<26 then 'FirstTime'
    when q2<30 and type in {_SHOTS} then 'Rebound' when q2<34 and type in {_SHOTS} then 'High'
    when q2<38 and type in {_SHOTS} then 'LowLeft' when q2<42 and type='Pass' then 'Cutback' when q2<46 and type='Pass' then 'Corner' end as tag2
from raw2
""")
cte("raw4", """
select *, case when at_home then home_team else away_team end as team,
  case when at_home then away_team else home_team end as opponent,
  case when at_home then home_id else away_id end as team_id
from raw3
""")
cte("log", """
select e as event_id, season, nation, tier, match_id, cast(p as double) as event_index,
  cast(case when clock<2700 then 1 else 2 end as int) as period,
  cast(clock//60 as int) as minute, cast(clock%60 as int) as second,
  clock/cast(60 as double) as expanded_minute, cast(clock as double) as clock_s,
  team, regexp_replace(lower(team),'[^a-z0-9]+','','g') as team_key, team_id,
  case when at_home then 'home' else 'away' end as team_side, opponent,
  'P'||team_id||'.'||shirt as player, team_id*100+shirt as player_id, cast(shirt as int) as shirt_no,
  (['GK','DR','DL','DC','DC','DMC','MR','MC','FW','AMC','AML','Sub','Sub','Sub'])[shirt] as position,
  shirt<=11 as is_starter, type, lower(type) as type_c,
  case when (e+k)%4<>0 then 'Successful' else 'Unsuccessful' end as outcome,
  case when (e+k)%4<>0 then 'successful' else 'unsuccessful' end as outcome_c,
  case when type='Card' then case when (k//10)%5=3 then 'SecondYellow' when (k//10)%5=4 then 'Red' else 'Yellow' end end as card_type,
  list_filter([tag1,tag2], lambda t: t is not null) as qual_tags,
  lower(coalesce(tag1,'')||coalesce(tag2,'')) as qual_c,
  case when e%97<>0 then ((e*37+k*11)%1000)/cast(10 as double) end as x,
  case when e%97<>0 then ((e*91+13+k*29)%1000)/cast(10 as double) end as y,
  case when has_end then ((e*53+k*7)%1000)/cast(10 as double) end as end_x,
  case when has_end then ((e*71+k*3)%1000)/cast(10 as double) end as end_y,
  case when is_shot and k%7<>0 then 40+((e*13)%200)/cast(10 as double) end as goal_mouth_y,
  case when is_shot and k%6<>0 then ((e*17)%600)/cast(10 as double) end as goal_mouth_z,
  case when type='BlockedShot' then ((e*19)%1000)/cast(10 as double) end as blocked_y,
  case when is_shot and k%5=0 then (k%40)/cast(100 as double) end as provider_xg,
  type not in ('Card','Foul','CornerAwarded','SubstitutionOff','SubstitutionOn') as is_touch,
  is_shot, type='Goal' as is_goal, home_team, away_team, home_id, away_id, kickoff
from raw4
""")
cte("sched", """
select nation,tier,season,match_id,match_round,home_team,away_team,home_id,away_id,kickoff,
  regexp_replace(lower(home_team),'[^a-z0-9]+','','g') as home_key,
  regexp_replace(lower(away_team),'[^a-z0-9]+','','g') as away_key,
  case when k%10=0 then null when k%10=1 then '1' else '6' end as status,
  case when k%10=0 then 'FT' when k%20=1 then 'HT' end as elapsed,
  cast(k%4 as int) as home_score, cast(k%3 as int) as away_score
from (select *, row_number() over (partition by m order by e) as first_ from raw3) where first_=1
""")

OK_ = "('successful','success','won','complete','completed','accurate')"
_DEF = "tackle|interception|clearance|block|recovery|challenge|aerial|duel"
_STRICT = "('goal','missedshots','savedshot','shotonpost','blockedshot','attemptsaved')"
_SB = "coalesce(x>=83 and y between 21.1 and 78.9,false)"
_EB = "coalesce(end_x>=83 and end_y between 21.1 and 78.9,false)"
_CARDC = "regexp_replace(lower(coalesce(card_type,'')),'[^a-z0-9]+','','g')"

cte("fa", f"""
select *, x*1.2 as x_120, y*0.8 as y_80, end_x*1.2 as end_x_120, end_y*0.8 as end_y_80,
 (outcome_c in {OK_} or is_goal) as successful,
 (type_c like '%pass%' or type_c='cross') as is_pass_like,
 type_c in ('carry','dribble','takeon','run') as is_carry,
 (is_shot or is_goal or type_c like '%shot%') as is_shot_event,
 regexp_matches(type_c,'challenge$|^challenge|aerial|duel|recovery|tackle|interception|clearance|block|foul') as is_defensive_action,
 coalesce((type_c like '%pass%' or type_c='cross') and (outcome_c in {OK_} or is_goal) and x*1.2>=80,false) as is_final_third_pass
from log""")

cte("fb", f"""
with a as (select * exclude (is_goal,is_touch,is_shot), {_CARDC} as card_c, {_SB} as start_in_box, {_EB} as end_in_box,
  (is_goal or type_c='goal') as is_goal, (is_goal or type_c in {_STRICT}) as is_shot,
  (is_touch or type_c like '%touch%') as is_touch, type_c='pass' as is_pass,
  (type_c like '%cross%' or qual_c like '%cross%') as is_cross,
  regexp_matches(type_c,'carry|dribble|takeon|run') as is_carry,
  regexp_matches(type_c,'{_DEF}') as is_defensive_action,
  regexp_matches(qual_c,'voidyellowcard|voidredcard|voidsecondyellow') as void_card,
  type_c='cornerawarded' as is_corner_awarded,
  (type_c in ('cornertaken','corner') or regexp_matches(qual_c,'cornertaken|cornerkick')) as is_corner_taken,
  qual_c like '%fromcorner%' as is_from_corner,
  (type_c in ('freekicktaken','directfreekick','indirectfreekicktaken','freekick') or regexp_matches(qual_c,'freekicktaken|directfreekick')) as is_free_kick_taken,
  qual_c like '%fromfreekick%' as is_from_free_kick,
  (type_c in ('throwin','throwintaken','throwinsetpiece') or regexp_matches(qual_c,'throwintaken|throwinsetpiece')) as is_throw_in,
  qual_c like '%fromthrowin%' as is_from_throw_in,
  (type_c like '%penalty%' or regexp_matches(qual_c,'penalty(taken|awarded|scored|missed|saved)')) as is_penalty
 from log),
b as (select *, (outcome_c in {OK_} or is_goal) as is_success,
  ((type_c='card' or card_c in ('yellow','secondyellow','red') or qual_c like '%secondyellow%' or qual_c like 'yellow%' or qual_c like 'red%') and not void_card) as is_card,
  ((card_c in ('yellow','secondyellow') or qual_c like '%yellow%') and not void_card) as is_yellow_card,
  ((card_c='secondyellow' or qual_c like '%secondyellow%') and not void_card) as is_second_yellow,
  ((card_c in ('red','secondyellow') or qual_c like '%secondyellow%' or qual_c like 'red%') and not void_card) as is_red_card,
  (is_corner_awarded or is_corner_taken or is_from_corner) as is_corner,
  (is_free_kick_taken or is_from_free_kick) as is_free_kick,
  (is_corner_awarded or is_corner_taken or is_free_kick_taken or is_throw_in or is_penalty) as is_set_piece_restart,
  coalesce((is_pass or is_cross or is_carry) and x<66.67 and end_x>=66.67,false) as final_third_entry,
  ((is_pass or is_cross or is_carry) and not start_in_box and end_in_box) as box_entry,
  coalesce(is_touch and x>=66.67,false) as attacking_third_touch,
  coalesce(is_defensive_action and x>=60,false) as high_regain from a)
select *, (is_corner or is_free_kick or is_penalty or is_throw_in or is_from_throw_in) as is_set_piece from b""")

_CARDS = "('yellow','yellowcard','red','redcard','secondyellow','secondyellowcard','secondyellowred','secondyellowredcard')"
cte("fc", f"""
with a as (select * exclude (is_goal,is_touch,is_shot), {_CARDC} as card_c, {_SB} as start_in_box, {_EB} as end_in_box,
  (is_goal or type_c='goal' or outcome_c like '%goal%') as is_goal,
  (is_shot or is_goal or type_c='goal' or outcome_c like '%goal%' or type_c like '%shot%') as is_shot,
  (is_touch or type_c like '%touch%') as is_touch,
  (type_c like '%pass%' and type_c not like '%cross%') as is_pass,
  (type_c like '%cross%' or qual_c like '%cross%') as is_cross,
  type_c in ('takeon','dribble') as is_take_on, type_c='inferredcarry' as is_inferred_carry,
  regexp_matches(type_c,'{_DEF}') as is_defensive_action,
  (type_c like '%corner%' or qual_c like '%corner%') as is_corner,
  (type_c like '%freekick%' or qual_c like '%freekick%') as is_free_kick,
  qual_c like '%penalty%' as is_penalty,
  (type_c like '%throw%' or qual_c like '%throw%') as is_throw_in,
  regexp_matches(type_c||qual_c||{_CARDC},'voidyellowcard|voidredcard|voidsecondyellow|voidedcard') as void_card
 from log),
b as (select *, (regexp_matches(type_c,'carry|run') and not is_take_on) as is_carry,
  (outcome_c in {OK_} or is_goal) as is_success,
  (is_corner or is_free_kick or is_penalty or is_throw_in) as is_set_piece,
  ((type_c='card' or card_c in {_CARDS}) and not void_card) as is_card,
  coalesce(is_touch and x>=66.67,false) as attacking_third_touch,
  coalesce(is_defensive_action and x>=60,false) as high_regain from a)
select *, (card_c in ('yellow','yellowcard') and is_card) as is_yellow_card,
  (card_c like 'secondyellow%' and is_card) as is_second_yellow,
  ((card_c in ('red','redcard') or card_c like 'secondyellow%') and is_card) as is_red_card,
  coalesce((is_pass or is_cross or is_carry) and x<66.67 and end_x>=66.67,false) as final_third_entry,
  ((is_pass or is_cross or is_carry) and not start_in_box and end_in_box) as box_entry,
  (is_pass or is_cross or is_carry or is_take_on or is_shot) as is_chain_action
from b""")

cte("fe", f"""
with a as (select *, coalesce(x,0)*1.2::double as ex, coalesce(y,0)*0.8::double as ey, coalesce(end_x,0)*1.2::double as eex, coalesce(end_y,0)*0.8::double as eey,
  (is_goal or type_c='goal' or outcome_c like '%goal%') as e_goal,
  (type_c like '%pass%' or type_c='cross') as e_pass,
  (type_c like '%cross%' or qual_c like '%cross%') as e_cross,
  regexp_matches(type_c,'carry|dribble|takeon|run') as e_carry,
  regexp_matches(type_c,'{_DEF}|foul') as e_defensive,
  (regexp_matches(qual_c,'corner|freekick|throwin|penalty') or regexp_matches(type_c,'corner|freekick|penalty')) as e_set_piece,
  (qual_c like '%corner%' or type_c like '%corner%') as e_corner,
  (qual_c like '%freekick%' or type_c like '%freekick%') as e_free_kick,
  (qual_c like '%throwin%' or type_c like '%throwin%') as e_throw_in from log),
b as (select *, (ex>=100 and ey between 18 and 62) as e_start_box, (eex>=100 and eey between 18 and 62) as e_end_box,
  (is_shot or e_goal or type_c like '%shot%') as e_shot, (e_pass or e_cross or e_carry) as e_move,
  (outcome_c in {OK_} or e_goal) as e_success, (e_defensive and ex>=72) as e_regain from a)
select *, (e_shot and (e_goal or type_c like '%saved%' or regexp_matches(outcome_c,'ontarget|save'))) as e_on_target,
  (e_move and eex>=80 and ex<80) as e_final_third, (e_move and e_end_box and not e_start_box) as e_box,
  (e_move and (ey<=80/3.0::double or ey>=160/3.0::double)) as e_wide,
  (e_move and ey between 80/3.0::double and 160/3.0::double) as e_central from b""")

_FEXPR = f"""
  (is_goal or type_c='goal') as f_goal, (type_c like '%pass%' or type_c='cross') as f_pass,
  type_c in ('carry','dribble','takeon','run','inferredcarry') as f_carry,
  (list_contains(tc,'cross') or type_c='cross') as f_cross, list_contains(tc,'bigchance') as f_big_chance,
  list_has_any(tc,['header','headed','head']) as f_header, list_has_any(tc,['firsttime','firsttimefinish']) as f_first_time,
  list_contains(tc,'rebound') as f_rebound, list_has_any(tc,['fastbreak','counterattack']) as f_fast_break,
  list_has_any(tc,['throughball','through']) as f_through, list_has_any(tc,['cutback','lowcentre','boxcentre']) as f_cutback,
  list_has_any(tc,['penalty','pen']) as f_penalty,
  (list_contains(tc,'freekick') and not list_has_any(tc,['cross','cornercrossed','freekickcrossed','indirect'])) as f_direct_fk,
  outcome_c in {OK_} as f_success, (is_shot or type_c like '%shot%' or type_c='goal') as f_shot,
  list_has_any(tc,['penalty','pen','corner','freekick','throwin','throw']) as f_set_piece"""
cte("ff", f"select *, {_FEXPR} from (select *, list_transform(qual_tags, lambda t: lower(t)) as tc from log)")

# take-on ends by self join (row positions are the event index), then inferred carries
cte("tk", """
with n as (select c.event_id as cid, b.event_index as bi,
   (b.period<>c.period or b.clock_s-c.clock_s>10 or regexp_matches(b.type_c,'substitution|formation|card|start|end|offsidegiven|foul')
     or b.outcome_c like '%offside%' or b.team<>c.team) as stop,
   (b.player=c.player and b.x is not null and b.y is not null and sqrt(power(b.x-c.x,2)+power(b.y-c.y,2)) between 1 and 60) as hit,
   b.x as bx, b.y as by_, b.clock_s-c.clock_s as gap
  from fc c join fc b on b.match_id=c.match_id and b.event_index>c.event_index and b.event_index<=c.event_index+8
  where c.is_take_on and c.x is not null),
s as (select cid, min(bi) filter (stop) as st from n group by cid),
h as (select n.cid, arg_min(bx,bi) as hx, arg_min(by_,bi) as hy, arg_min(gap,bi) as hg from n join s using(cid) where hit and bi<coalesce(st,1e9) group by n.cid)
select fc.* replace (coalesce(hx,end_x) as end_x, coalesce(hy,end_y) as end_y), hx is not null as take_on_end_inferred, coalesce(hg,0) as take_on_seconds
from fc left join h on h.cid=fc.event_id
""")
cte("carr", """
select c.*, n.type as n_type, n.x as nx, n.y as ny, n.clock_s-c.clock_s as gap, sqrt(power(n.x-c.x,2)+power(n.y-c.y,2)) as dist
from tk c join tk n on n.match_id=c.match_id and n.event_index=c.event_index+1
where c.type_c in ('ballrecovery','balltouch','takeon') and (n.type_c in ('pass','takeon','savedshot','missedshots','shotonpost','blockedshot','goal','dispossessed','balltouch','blockedpass') or n.is_pass or n.is_cross or n.is_shot or n.is_take_on)
 and not regexp_matches(c.type_c,'substitution|card|foul') and not regexp_matches(n.type_c,'substitution|card|foul')
 and c.outcome='Successful' and n.outcome='Successful' and c.period=n.period and c.team=n.team and c.player=n.player
 and n.clock_s-c.clock_s between 0 and 10 and sqrt(power(n.x-c.x,2)+power(n.y-c.y,2)) between 3 and 60
""")
cte("prep", """
select *, null::double as carry_distance, null::double as carry_seconds, null::varchar as carry_end_type from tk
union all by name
select * exclude (n_type,nx,ny,gap,dist) replace (event_index+0.001 as event_index,'InferredCarry' as type,'inferredcarry' as type_c,
  'Successful' as outcome,'successful' as outcome_c, nx as end_x, ny as end_y, true as is_carry, true as is_inferred_carry,
  false as is_take_on,false as is_pass,false as is_cross,false as is_shot,false as is_goal,true as is_success,false as is_touch,
  false as attacking_third_touch, true as is_chain_action, (nx>=83 and ny between 21.1 and 78.9) as end_in_box,
  (x<66.67 and nx>=66.67) as final_third_entry, (not start_in_box and nx>=83 and ny between 21.1 and 78.9) as box_entry),
  dist as carry_distance, gap as carry_seconds, n_type as carry_end_type
from carr
""")
cte("fd", f"""
with a as (select *, (type_c||outcome_c||qual_c) like '%owngoal%' as own_goal, type_c='pass' as d_pass,
  is_take_on as d_take_on, is_inferred_carry as d_inferred, is_defensive_action as d_defensive,
  type_c in ('foul','foulcommitted') as d_foul, type_c='interception' as d_interception,
  regexp_matches(type_c||outcome_c||qual_c||card_c,'voidyellowcard|voidredcard|voidsecondyellow|voidedcard') as d_void,
  type_c='cornerawarded' as d_corner_awarded, regexp_matches(qual_c,'cornertaken|cornerkick') as d_corner_taken,
  regexp_matches(qual_c,'freekicktaken|directfreekick') as d_free_kick, regexp_matches(qual_c,'throwintaken|throwinsetpiece') as d_throw_in,
  qual_c like '%penaltyawarded%' as d_penalty_awarded from prep),
b as (select *, (is_goal and not own_goal) as d_goal, (d_pass and qual_c like '%cross%') as d_cross,
  (d_inferred or (is_carry and not d_take_on)) as d_carry, ((type_c='card' or card_c<>'') and not d_void) as d_card from a),
c as (select *, (d_goal or type_c in {_STRICT}) as d_shot, (card_c='yellow' and d_card) as d_yellow, (card_c='secondyellow' and d_card) as d_second_yellow,
  (card_c in ('red','secondyellow') and d_card) as d_red from b),
d as (select *, (d_shot and (d_goal or type_c='savedshot')) as d_on_target, (d_shot and qual_c like '%penalty%') as d_penalty,
  (final_third_entry or coalesce((d_pass or d_cross or d_carry) and x<66.67 and end_x>=66.67,false)) as d_final_third,
  (box_entry or ((d_pass or d_cross or d_carry) and not start_in_box and end_in_box)) as d_box,
  coalesce(d_carry and x<66.67 and end_x>=66.67,false) as d_carry_final_third, (d_carry and not start_in_box and end_in_box) as d_carry_box,
  coalesce(d_carry and end_x-x>=10,false) as d_progressive_carry, (high_regain or coalesce(d_defensive and x>=60,false)) as d_regain from c)
select *, (d_corner_awarded or d_corner_taken or qual_c like '%fromcorner%' or d_free_kick or d_throw_in or d_penalty or d_penalty_awarded
  or (d_shot and regexp_matches(qual_c,'corner|freekick|penalty'))) as d_set_piece from d
""")
XGM = """coalesce(provider_xg, case when qual_c like '%penalty%' then 0.76::double else greatest(0.005::double, least(
  case when (type_c||outcome_c||qual_c) like '%freekick%' then least(xb,0.08::double) else xb end, 0.80::double)) end)"""
_XB = """(case when (type_c||outcome_c||qual_c) like '%bigchance%' then greatest(b0,0.32::double) else b0 end)
  * case when (type_c||outcome_c||qual_c) like '%header%' or (type_c||outcome_c||qual_c) like '%headed%' then 0.78::double else 1::double end"""
_B0 = """(case when coalesce(x,0)>=83 and coalesce(y,50) between 21.1 and 78.9 then
  case when 100-coalesce(x,0)<=7 and abs(coalesce(y,50)-50)<=12 then 0.28 when 100-coalesce(x,0)<=13 and abs(coalesce(y,50)-50)<=20 then 0.20
       when abs(coalesce(y,50)-50)>=26 then 0.08 else 0.14 end when coalesce(x,0)>=76 then 0.045 else 0.025 end)::double"""
cte("logx", f"select * exclude (b0,xb), {XGM} as xg from (select *, {_XB} as xb from (select *, {_B0} as b0 from log))")
_XS = """case when type_c like '%penalty%' or qual_c like '%penalty%' then 0.76::double else greatest(0.005::double, least(
 (case when al like '%bigchance%' then greatest(b0,0.26::double) else b0 end) * (case when al like '%header%' or al like '%headed%' then 0.78::double else 1::double end)
 * (case when al like '%blocked%' then 0.85::double else 1::double end), 0.76::double)) end"""
_S0 = """(case when qual_c like '%freekick%' or type_c like '%directfreekick%' then 0.055 when coalesce(x,0)>=83 and coalesce(y,50) between 21.1 and 78.9 then
  case when 100-coalesce(x,0)<=7 and abs(coalesce(y,50)-50)<=12 then 0.28 when 100-coalesce(x,0)<=13 and abs(coalesce(y,50)-50)<=20 then 0.19
       when abs(coalesce(y,50)-50)>=26 then 0.065 else 0.11 end when coalesce(x,0)>=76 then 0.04 else 0.02 end)::double"""
cte("logs", f"select * exclude (b0,al), {_XS} as xg_strict from (select *, type_c||outcome_c||qual_c as al, {_S0} as b0 from log)")
_ZS = "case when x is null or y is null then -1 else (least(greatest(floor(y*12/100),0),11)*16+least(greatest(floor(x*16/100),0),15))::int end"
_ZE = "case when end_x is null or end_y is null then -1 else (least(greatest(floor(end_y*12/100),0),11)*16+least(greatest(floor(end_x*16/100),0),15))::int end"
cte("pf", f"""select *, case when f_carry then 'carry' when f_cross then 'cross' when f_pass then 'pass' else 'other' end as action_type,
  coalesce((f_pass or f_carry) and f_success and end_x is not null and end_y is not null and zone_start>=0 and zone_end>=0,false) as f_move
  from (select *, {_FEXPR}, {_ZS} as zone_start, {_ZE} as zone_end from (select *, list_transform(qual_tags, lambda t: lower(t)) as tc from prep))""")
cte("zf", f"""select *, coalesce((f_pass or f_carry) and f_success and end_x is not null and end_y is not null and zone_start>=0 and zone_end>=0,false) as f_move from (select *, {_ZS} as zone_start, {_ZE} as zone_end from ff)""")
_L3 = "{a}.nation={b}.nation and {a}.tier={b}.tier and {a}.season={b}.season"
ZCELL = """select nation, tier, season, zone_start, case when f_move then zone_end else -1 end as zone_end, count(*) as actions,
  count(*) filter (f_move) as moves, count(*) filter (f_shot) as shots, count(*) filter (f_goal) as goals
  from zf where zone_start>=0 and not f_set_piece group by all"""
cte("zcell", ZCELL)
cte("zrow", """select nation, tier, season, zone_start, sum(actions)::double as actions, sum(moves)::double as moves, sum(shots)::double as shots, sum(goals)::double as goals from zcell group by 1,2,3,4""")
cte("zall", f"""select l.nation, l.tier, l.season, list({{p:case when r.shots>0 then r.shots/r.actions*(r.goals/r.shots) else 0 end, e:coalesce(g.e,[]), w:coalesce(g.w,[])}} order by i.i) as zs
  from (select distinct nation,tier,season from zrow) l cross join (select unnest(range(192))::int as i) i
  left join zrow r on r.zone_start=i.i and {_L3.format(a='r', b='l')}
  left join (select c.nation,c.tier,c.season,c.zone_start, list(c.zone_end order by c.zone_end) as e, list(c.moves/r.actions order by c.zone_end) as w
   from zcell c join zrow r using(nation,tier,season,zone_start) where c.zone_end>=0 group by 1,2,3,4) g on g.zone_start=i.i and {_L3.format(a='g', b='l')} group by 1,2,3""")
cte("xtit", """select nation,tier,season,0 as it, list_transform(range(192), lambda i: 0::double) as v from zall
  union all select x.nation,x.tier,x.season,it+1, list_transform(a.zs, lambda z: z.p + coalesce(list_sum(list_transform(list_zip(z.e,z.w), lambda q: q[2]*x.v[q[1]+1])),0)) from xtit x join zall a using(nation,tier,season) where it<60""")
cte("xtm", "select nation,tier,season,(i-1)::int as zone, least(greatest(v[i],0),1) as xt from xtit, (select unnest(range(1,193)) as i) where it=60")
cte("pv", f"""select *, case when f_set_piece then 0 else league_xt_added end as xt_added, case when f_set_piece then 0 else positive_league_xt end as positive_xt from (
  select p.*, case when f_move then e.xt-s.xt else 0 end as league_xt_added, case when f_move then greatest(e.xt-s.xt,0) else 0 end as positive_league_xt,
  case when p.is_shot then l.xg else 0 end as xg
  from pf p left join xtm s on s.zone=p.zone_start and {_L3.format(a='s', b='p')} left join xtm e on e.zone=p.zone_end and {_L3.format(a='e', b='p')} left join logx l on l.event_id=p.event_id)""")
# The same grids with the match as their scope; matches are short, so play may go round for long: more rounds.
_OWN = lambda text: text.replace("nation, tier, season, zone_start", "match_id, zone_start")
cte("mcell", _OWN(ZCELL))
cte("mrow", """select match_id, zone_start, sum(actions)::double as actions, sum(moves)::double as moves, sum(shots)::double as shots, sum(goals)::double as goals from mcell group by 1,2""")
cte("mall", """select l.match_id, list({p:case when r.shots>0 then r.shots/r.actions*(r.goals/r.shots) else 0 end, e:coalesce(g.e,[]), w:coalesce(g.w,[])} order by i.i) as zs
  from (select distinct match_id from mrow) l cross join (select unnest(range(192))::int as i) i left join mrow r on r.zone_start=i.i and r.match_id=l.match_id
  left join (select c.match_id,c.zone_start,list(c.zone_end order by c.zone_end) as e,list(c.moves/r.actions order by c.zone_end) as w from mcell c join mrow r using(match_id,zone_start) where c.zone_end>=0 group by 1,2) g on g.zone_start=i.i and g.match_id=l.match_id group by 1""")
cte("mit", """select match_id,0 as it, list_transform(range(192), lambda i: 0::double) as v from mall
  union all select x.match_id,it+1, list_transform(a.zs, lambda z: z.p + coalesce(list_sum(list_transform(list_zip(z.e,z.w), lambda q: q[2]*x.v[q[1]+1])),0)) from mit x join mall a using(match_id) where it<120""")
cte("mxt", "select match_id,(i-1)::int as zone, least(greatest(v[i],0),1) as xt from mit, (select unnest(range(1,193)) as i) where it=120")
cte("mpv", """select *, case when f_set_piece then 0 else added end as xt_added, case when f_set_piece then 0 else greatest(added,0) end as positive_xt from (
  select p.*, case when f_move then coalesce(e.xt,0)-coalesce(s.xt,0) else 0 end as added from pf p left join mxt s on s.zone=p.zone_start and s.match_id=p.match_id left join mxt e on e.zone=p.zone_end and e.match_id=p.match_id)""")
