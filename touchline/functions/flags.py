"""Event flags.  The same word (shot, carry, regain ...) has six meanings in this domain,
so each meaning is its own column set and none is merged with another:

====  =======================================  ==================
set   used for                                 space
====  =======================================  ==================
a     the base projection                      120 x 80 and raw
b     the stored event table and its facts     0-100
c     match sections (maps, chains, links)     0-100
d     strict team statistics                   0-100
e     season and league facts                  120 x 80
f     shot, assist and ball-movement values    120 x 80
====  =======================================  ==================

Every function is a projection; missing values make a flag false.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Outcome words that count as success, shot types, and pitch limits.
SUCCESS = "('successful','success','won','complete','completed','accurate')"
STRICT_SHOTS = "('goal','missedshots','savedshot','shotonpost','blockedshot','attemptsaved')"
FINAL_THIRD_X = 66.67
BOX_X = 83.0
BOX_Y_MIN = 21.1
BOX_Y_MAX = 78.9
DEFENSIVE = "tackle|interception|clearance|block|recovery|challenge|aerial|duel"
VOID_CARDS = "voidyellowcard|voidredcard|voidsecondyellow"


_WORDS = re.compile(r"(\w+) rlike '([a-z]+(?:\|[a-z]+)*)'")


def substring_tests(rule: str) -> str:
    """A list of plain words needs no regular expression: substring tests are cheaper per row."""
    return _WORDS.sub(lambda m: "(" + " or ".join(f"contains({m[1]},'{w}')" for w in m[2].split("|")) + ")", rule)


def with_flags(df: DataFrame, **rules: str) -> DataFrame:
    """Add boolean columns; a rule that evaluates to null is false."""
    return df.withColumns({n: F.coalesce(F.expr(substring_tests(r)), F.lit(False)) for n, r in rules.items()})


def _pitch(df: DataFrame) -> DataFrame:
    return with_flags(
        df.withColumn("card_c", F.expr("regexp_replace(lower(coalesce(card_type,'')),'[^a-z0-9]+','')")),
        start_in_box=f"x >= {BOX_X} and y between {BOX_Y_MIN} and {BOX_Y_MAX}",
        end_in_box=f"end_x >= {BOX_X} and end_y between {BOX_Y_MIN} and {BOX_Y_MAX}",
    )


def flags_a(log: DataFrame) -> DataFrame:
    return with_flags(
        log.withColumns(
            {
                "x_120": F.col("x") * 1.2,
                "y_80": F.col("y") * 0.8,
                "end_x_120": F.col("end_x") * 1.2,
                "end_y_80": F.col("end_y") * 0.8,
            }
        ),
        successful=f"outcome_c in {SUCCESS} or is_goal",
        is_pass_like="contains(type_c,'pass') or type_c = 'cross'",
        is_carry="type_c in ('carry','dribble','takeon','run')",
        is_shot_event="is_shot or is_goal or contains(type_c,'shot') or type_c = 'goal'",
        is_defensive_action="type_c in ('tackle','challenge','interception','clearance','block','ballrecovery','recovery')"
        " or type_c rlike 'aerial|duel|recovery|tackle|interception|clearance|block|foul'",
    ).withColumn(
        "is_final_third_pass",
        F.coalesce(F.expr("is_pass_like and successful and x_120 >= 80"), F.lit(False)),
    )


def flags_b(log: DataFrame) -> DataFrame:
    df = with_flags(
        _pitch(log),
        is_goal="is_goal or type_c = 'goal'",
        is_touch="is_touch or contains(type_c,'touch')",
        is_pass="type_c = 'pass'",
        is_cross="contains(type_c,'cross') or contains(qual_c,'cross')",
        is_carry="type_c rlike 'carry|dribble|takeon|run'",
        is_defensive_action=f"type_c rlike '{DEFENSIVE}'",
        void_card=f"qual_c rlike '{VOID_CARDS}'",
        is_corner_awarded="type_c = 'cornerawarded'",
        is_corner_taken="type_c in ('cornertaken','corner') or qual_c rlike 'cornertaken|cornerkick'",
        is_from_corner="contains(qual_c,'fromcorner')",
        is_free_kick_taken="type_c in ('freekicktaken','directfreekick','indirectfreekicktaken','freekick')"
        " or qual_c rlike 'freekicktaken|indirectfreekicktaken|directfreekick'",
        is_from_free_kick="contains(qual_c,'fromfreekick')",
        is_throw_in="type_c in ('throwin','throwintaken','throwinsetpiece') or qual_c rlike 'throwintaken|throwinsetpiece'",
        is_from_throw_in="contains(qual_c,'fromthrowin')",
        is_penalty="contains(type_c,'penalty') or qual_c rlike"
        " 'penaltytaken|penaltyawarded|penaltyscored|penaltymissed|penaltysaved'",
    )
    df = with_flags(
        df,
        is_shot=f"is_goal or type_c in {STRICT_SHOTS}",
        is_success=f"outcome_c in {SUCCESS} or is_goal",
        is_card="(type_c = 'card' or card_c in ('yellow','secondyellow','red')"
        " or qual_c rlike '(?:^|[^a-z])yellow|secondyellow|(?:^|[^a-z])red') and not void_card",
        is_yellow_card="(card_c in ('yellow','secondyellow') or contains(qual_c,'yellow')) and not void_card",
        is_second_yellow="(card_c = 'secondyellow' or contains(qual_c,'secondyellow')) and not void_card",
        is_red_card="(card_c in ('red','secondyellow') or qual_c rlike '(?:^|[^a-z])red|secondyellow') and not void_card",
        is_corner="is_corner_awarded or is_corner_taken or is_from_corner",
        is_free_kick="is_free_kick_taken or is_from_free_kick",
        is_set_piece_restart="is_corner_awarded or is_corner_taken or is_free_kick_taken or is_throw_in or is_penalty",
        final_third_entry=f"(is_pass or is_cross or is_carry) and x < {FINAL_THIRD_X} and end_x >= {FINAL_THIRD_X}",
        box_entry="(is_pass or is_cross or is_carry) and not start_in_box and end_in_box",
        attacking_third_touch=f"is_touch and x >= {FINAL_THIRD_X}",
        high_regain="is_defensive_action and x >= 60",
    )
    return with_flags(df, is_set_piece="is_corner or is_free_kick or is_penalty or is_throw_in or is_from_throw_in")


def flags_c(log: DataFrame) -> DataFrame:
    df = with_flags(
        _pitch(log),
        is_goal="is_goal or type_c = 'goal' or contains(outcome_c,'goal')",
        is_touch="is_touch or contains(type_c,'touch')",
        is_pass="contains(type_c,'pass') and not contains(type_c,'cross')",
        is_cross="contains(type_c,'cross') or contains(qual_c,'cross')",
        is_take_on="type_c in ('takeon','dribble')",
        is_inferred_carry="type_c = 'inferredcarry'",
        is_defensive_action=f"type_c rlike '{DEFENSIVE}'",
        is_corner="contains(type_c,'corner') or contains(qual_c,'corner')",
        is_free_kick="type_c rlike 'free kick|freekick' or qual_c rlike 'free kick|freekick'",
        is_penalty="contains(qual_c,'penalty')",
        is_throw_in="contains(type_c,'throw') or contains(qual_c,'throw')",
        void_card=f"concat(type_c,qual_c,card_c) rlike '{VOID_CARDS}|voidedcard'",
    )
    df = with_flags(
        df,
        is_shot="is_shot or is_goal or contains(type_c,'shot')",
        is_carry="type_c rlike 'carry|ballcarry|run' and not is_take_on",
        is_success=f"outcome_c in {SUCCESS} or is_goal",
        is_set_piece="is_corner or is_free_kick or is_penalty or is_throw_in",
        is_card="(type_c = 'card' or card_c in ('yellow','yellowcard','red','redcard','secondyellow',"
        "'secondyellowcard','secondyellowred','secondyellowredcard')) and not void_card",
        attacking_third_touch=f"is_touch and x >= {FINAL_THIRD_X}",
        high_regain="is_defensive_action and x >= 60",
    )
    return with_flags(
        df,
        is_yellow_card="card_c in ('yellow','yellowcard') and is_card",
        is_second_yellow="card_c in ('secondyellow','secondyellowcard','secondyellowred','secondyellowredcard') and is_card",
        is_red_card="card_c in ('red','redcard','secondyellow','secondyellowcard','secondyellowred','secondyellowredcard')"
        " and is_card",
        final_third_entry=f"(is_pass or is_cross or is_carry) and x < {FINAL_THIRD_X} and end_x >= {FINAL_THIRD_X}",
        box_entry="(is_pass or is_cross or is_carry) and not start_in_box and end_in_box",
        is_chain_action="is_pass or is_cross or is_carry or is_take_on or is_shot",
    )


def flags_d(prepared: DataFrame) -> DataFrame:
    """Strict statistics on top of set c (whose entries and carries it ORs in)."""
    df = with_flags(
        prepared,
        own_goal="contains(concat(type_c,outcome_c,qual_c),'owngoal')",
        d_pass="type_c = 'pass'",
        d_take_on="is_take_on or type_c in ('takeon','dribble')",
        d_inferred="is_inferred_carry or type_c = 'inferredcarry'",
        d_defensive="is_defensive_action or type_c in ('tackle','challenge','clearance','block','ballrecovery',"
        "'recovery','interception') or type_c rlike 'aerial|duel'",
        d_foul="type_c in ('foul','foulcommitted')",
        d_interception="type_c = 'interception'",
        d_void=f"concat(type_c,outcome_c,qual_c,card_c) rlike '{VOID_CARDS}|voidedcard'",
        d_corner_awarded="type_c = 'cornerawarded'",
        d_corner_taken="type_c in ('cornertaken','corner') or qual_c rlike 'cornertaken|cornerkick'",
        d_free_kick="type_c in ('freekicktaken','directfreekick','indirectfreekicktaken','freekick')"
        " or qual_c rlike 'freekicktaken|directfreekick|indirectfreekicktaken'",
        d_throw_in="type_c in ('throwin','throwintaken','throwinsetpiece') or qual_c rlike 'throwintaken|throwinsetpiece'",
        d_penalty_awarded="type_c = 'penaltyawarded' or contains(qual_c,'penaltyawarded')",
    )
    df = with_flags(
        df,
        d_goal="(is_goal or type_c = 'goal') and not own_goal",
        d_cross="type_c = 'cross' or (d_pass and contains(qual_c,'cross'))",
        d_carry="d_inferred or (is_carry and type_c rlike 'carry|ballcarry|run' and not d_take_on)",
        d_card="(type_c = 'card' or card_c in ('yellow','red','secondyellow')) and not d_void",
    )
    df = with_flags(
        df,
        d_shot=f"d_goal or type_c in {STRICT_SHOTS}",
        d_yellow="card_c = 'yellow' and d_card",
        d_second_yellow="card_c = 'secondyellow' and d_card",
        d_red="card_c in ('red','secondyellow') and d_card",
    )
    df = with_flags(
        df,
        d_on_target="d_shot and (d_goal or type_c in ('savedshot','attemptsaved')) and"
        " type_c not in ('missedshots','shotonpost','blockedshot')",
        d_penalty="type_c in ('penalty','penaltymissed','penaltyscored','penaltysaved') or (d_shot and contains(qual_c,'penalty'))"
        " or qual_c rlike 'penaltytaken|penaltyscored|penaltymissed|penaltysaved'",
        d_final_third=f"final_third_entry or ((d_pass or d_cross or d_carry) and x < {FINAL_THIRD_X} and end_x >= {FINAL_THIRD_X})",
        d_box="box_entry or ((d_pass or d_cross or d_carry) and not start_in_box and end_in_box)",
        d_carry_final_third=f"d_carry and x < {FINAL_THIRD_X} and end_x >= {FINAL_THIRD_X}",
        d_carry_box="d_carry and not start_in_box and end_in_box",
        d_progressive_carry="d_carry and end_x - x >= 10",
        d_regain="high_regain or (d_defensive and x >= 60)",
    )
    return with_flags(
        df,
        d_set_piece="d_corner_awarded or d_corner_taken or contains(qual_c,'fromcorner') or d_free_kick"
        " or contains(qual_c,'fromfreekick') or d_throw_in or contains(qual_c,'fromthrowin') or d_penalty"
        " or d_penalty_awarded or (d_shot and qual_c rlike 'corner|freekick|penalty')",
    )


def flags_e(log: DataFrame) -> DataFrame:
    df = log.withColumns(
        {
            "ex": F.expr("coalesce(x,0) * 1.2D"),
            "ey": F.expr("coalesce(y,0) * 0.8D"),
            "eex": F.expr("coalesce(end_x,0) * 1.2D"),
            "eey": F.expr("coalesce(end_y,0) * 0.8D"),
        }
    )
    df = with_flags(
        df,
        e_goal="is_goal or type_c = 'goal' or contains(outcome_c,'goal')",
        e_pass="contains(type_c,'pass') or type_c = 'cross'",
        e_cross="contains(type_c,'cross') or contains(qual_c,'cross')",
        e_carry="type_c rlike 'carry|dribble|takeon|run'",
        e_defensive=f"type_c rlike '{DEFENSIVE}|foul'",
        e_set_piece="qual_c rlike 'corner|freekick|throwin|penalty' or type_c rlike 'corner|freekick|penalty'",
        e_corner="contains(qual_c,'corner') or contains(type_c,'corner')",
        e_free_kick="contains(qual_c,'freekick') or contains(type_c,'freekick')",
        e_throw_in="contains(qual_c,'throwin') or contains(type_c,'throwin')",
        e_start_box="ex >= 100 and ey between 18 and 62",
        e_end_box="eex >= 100 and eey between 18 and 62",
    )
    df = with_flags(
        df,
        e_shot="is_shot or e_goal or contains(type_c,'shot')",
        e_move="e_pass or e_cross or e_carry",
        e_success=f"outcome_c in {SUCCESS} or e_goal",
        e_regain="e_defensive and ex >= 72",
    )
    return with_flags(
        df,
        e_on_target="e_shot and (e_goal or contains(type_c,'saved') or outcome_c rlike 'ontarget|save')",
        e_final_third="e_move and eex >= 80 and ex < 80",
        e_box="e_move and e_end_box and not e_start_box",
        e_wide="e_move and (ey <= 80/3.0D or ey >= 160/3.0D)",
        e_central="e_move and ey between 80/3.0D and 160/3.0D",
    )


def flags_f(df: DataFrame) -> DataFrame:
    """Flags of the value models; names carry an ``f_`` prefix so they can sit on any set."""
    df = with_flags(
        df.withColumn("tags_c", F.expr("concat(',', lower(concat_ws(',', qual_tags)), ',')")),
        f_goal="is_goal or type_c = 'goal'",
        f_pass="contains(type_c,'pass') or type_c = 'cross'",
        f_carry="type_c in ('carry','dribble','takeon','run','inferredcarry')",
        f_cross="contains(tags_c,',cross,') or type_c = 'cross'",
        f_big_chance="contains(tags_c,',bigchance,')",
        f_header="(contains(tags_c,',header,') or contains(tags_c,',headed,') or contains(tags_c,',head,'))",
        f_first_time="(contains(tags_c,',firsttime,') or contains(tags_c,',firsttimefinish,'))",
        f_rebound="contains(tags_c,',rebound,')",
        f_fast_break="(contains(tags_c,',fastbreak,') or contains(tags_c,',counterattack,'))",
        f_through="(contains(tags_c,',throughball,') or contains(tags_c,',through,'))",
        f_cutback="(contains(tags_c,',cutback,') or contains(tags_c,',lowcentre,') or contains(tags_c,',boxcentre,'))",
        f_penalty="(contains(tags_c,',penalty,') or contains(tags_c,',pen,'))",
        f_direct_fk="contains(tags_c,',freekick,') and not"
        " (contains(tags_c,',cross,') or contains(tags_c,',cornercrossed,') or contains(tags_c,',freekickcrossed,') or contains(tags_c,',indirect,'))",
        f_success=f"outcome_c in {SUCCESS}",
    )
    return with_flags(
        df,
        f_shot="is_shot or contains(type_c,'shot') or type_c = 'goal'",
        f_set_piece="f_penalty or f_direct_fk or (contains(tags_c,',corner,') or contains(tags_c,',freekick,') or contains(tags_c,',throwin,') or contains(tags_c,',throw,'))",
    )
