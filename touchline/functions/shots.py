"""Shot values by rule, shot geometry and goal-mouth placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.flags import with_flags
from touchline.functions.geometry import LEFT_POST, RIGHT_POST


def rule_xg_strict(x: str = "x", y: str = "y", all_c: str = "concat(type_c,outcome_c,qual_c)") -> Column:
    """Coordinate rule used by the strict team statistics."""
    xx, dy = f"coalesce({x},0)", f"abs(coalesce({y},50) - 50)"
    base = f"""case when qual_c like '%freekick%' or type_c like '%directfreekick%' then 0.055D
        when {xx} >= 83 and coalesce({y},50) between 21.1 and 78.9 then
          case when 100 - {xx} <= 7 and {dy} <= 12 then 0.28D when 100 - {xx} <= 13 and {dy} <= 20 then 0.19D
               when {dy} >= 26 then 0.065D else 0.11D end
        when {xx} >= 76 then 0.04D else 0.02D end"""
    floor = f"case when {all_c} like '%bigchance%' then greatest({base}, 0.26D) else {base} end"
    scaled = (
        f"({floor}) * case when {all_c} like '%header%' or {all_c} like '%headed%' then 0.78D else 1D end"
        f" * case when {all_c} like '%blocked%' then 0.85D else 1D end"
    )
    return F.expr(
        f"case when type_c like '%penalty%' or qual_c like '%penalty%' then 0.76D"
        f" else greatest(0.005D, least({scaled}, 0.76D)) end"
    )


def rule_xg_match() -> Column:
    """Coordinate rule of the match sections; a provider value wins."""
    xx, dy = "coalesce(x,0)", "abs(coalesce(y,50) - 50)"
    text = "concat(type_c,outcome_c,qual_c)"
    base = f"""case when {xx} >= 83 and coalesce(y,50) between 21.1 and 78.9 then
          case when 100 - {xx} <= 7 and {dy} <= 12 then 0.28D when 100 - {xx} <= 13 and {dy} <= 20 then 0.20D
               when {dy} >= 26 then 0.08D else 0.14D end
        when {xx} >= 76 then 0.045D else 0.025D end"""
    floor = f"case when {text} like '%bigchance%' then greatest({base}, 0.32D) else {base} end"
    headed = f"({floor}) * case when {text} like '%header%' or {text} like '%headed%' then 0.78D else 1D end"
    capped = f"case when {text} like '%freekick%' then least({headed}, 0.08D) else {headed} end"
    return F.expr(
        f"coalesce(provider_xg, case when qual_c like '%penalty%' then 0.76D"
        f" else greatest(0.005D, least({capped}, 0.80D)) end)"
    )


def rule_xg_season() -> Column:
    """Distance rule of the season facts, 120 x 80 coordinates of flag set e."""
    d = "sqrt(power(120 - ex, 2) + power(40 - ey, 2))"
    return F.expr(
        f"least(greatest(least(greatest(1 - {d} / 92D, 0.02D), 0.38D) + case when e_start_box then 0.07D else 0D end"
        f" + case when e_goal then 0.18D else 0D end, 0.01D), 0.78D)"
    )


def shot_geometry(df: DataFrame) -> DataFrame:
    """Distance and angle to goal on the 105 x 68 pitch (posts at 34 +- 3.66)."""
    df = df.withColumns({"x_105": F.expr("x * 1.05D"), "y_68": F.expr("y * 0.68D")})
    df = df.withColumns(
        {
            "goal_distance": F.expr("sqrt(power(105 - x_105, 2) + power(34 - y_68, 2))"),
            "post_a": F.expr("sqrt(power(105 - x_105, 2) + power(30.34D - y_68, 2))"),
            "post_b": F.expr("sqrt(power(105 - x_105, 2) + power(37.66D - y_68, 2))"),
        }
    )
    cos = "(post_a * post_a + post_b * post_b - 7.32D * 7.32D) / nullif(2 * post_a * post_b, 0)"
    return df.withColumn(
        "goal_angle", F.expr(f"case when x is not null and y is not null then"
                             f" if(post_a * post_b > 0, acos(least(greatest({cos}, -1D), 1D)), 0D) end")
    ).drop("post_a", "post_b")


def goal_mouth(shots: DataFrame) -> DataFrame:
    """Where a shot crossed the goal plane, with status and display position."""
    def scaled(c: str) -> str:
        return f"case when {c} > 0 and {c} <= 1.5 then {c} * 100 else {c} end"

    text = "concat(type_c, outcome_c)"
    full = "concat(type_c, outcome_c, qual_c)"
    df = shots.withColumns(
        {
            "target_y": F.expr(scaled("coalesce(goal_mouth_y, blocked_y, end_y, y)")),
            "tags": F.expr("transform(qual_tags, t -> lower(t))"),
        }
    ).withColumns(
        {
            "horizontal": F.expr(f"(target_y - {LEFT_POST}D) / ({RIGHT_POST}D - {LEFT_POST}D) * 100"),
            "vertical": F.expr(
                f"""case when goal_mouth_z is not null then {scaled('goal_mouth_z')}
                when {full} like '%over%' or {full} like '%high%' then 108D when {full} like '%low%' then 18D
                when {full} like '%top%' or arrays_overlap(tags, array('upper','upperleft','upperright')) then 82D
                when {full} like '%block%' then 35D else 50D end"""
            ),
        }
    ).where("horizontal is not null")
    df = with_flags(
        df,
        off_high="arrays_overlap(tags, array('high','over','overbar')) or vertical > 100",
        off_left="arrays_overlap(tags, array('left','farwideleft','wideleft','missleft')) or horizontal < 0",
        off_right="arrays_overlap(tags, array('right','farwideright','wideright','missright')) or horizontal > 100",
        saved=f"{text} like '%save%'",
        missed=f"{text} like '%missed%' or {text} like '%offtarget%'",
        blocked=f"{text} like '%block%' or array_contains(tags,'blocked')",
        woodwork=f"arrays_overlap(tags, array('hitwoodwork','woodwork')) or {text} like '%shotonpost%'",
    )
    df = with_flags(
        df,
        plane="horizontal between 0 and 100 and vertical between 0 and 100 and not off_high and not off_left"
        " and not off_right and not missed",
    ).withColumns(
        {
            "status": F.expr(
                """case when is_goal then 'goal' when blocked then 'blocked' when woodwork then 'woodwork'
                when off_high and off_left then 'over and left' when off_high and off_right then 'over and right'
                when off_high then 'over the bar' when off_left then 'wide left' when off_right then 'wide right'
                when saved then 'saved on target' when missed then 'missed'
                when plane then 'on target plane' else 'off target' end"""
            ),
            "display_x": F.expr(
                "case when off_left then least(horizontal, -7D) when off_right then greatest(horizontal, 107D)"
                " else horizontal end"
            ),
            "display_y": F.expr("case when off_high then greatest(vertical, 108D) else vertical end"),
        }
    )
    return df.withColumns(
        {
            "on_plane": F.expr(
                "case when status in ('goal','saved on target') then true"
                " when status in ('blocked','woodwork','missed') then false else plane end"
            ),
            "plot_x": F.expr(
                "case when off_right then greatest(case when off_left then least(display_x, -8D) else display_x end, 108D)"
                " when off_left then least(display_x, -8D) else display_x end"
            ),
            "plot_y": F.expr("case when off_high then greatest(display_y, 108D) else display_y end"),
        }
    )
