"""Pitch geometry on 0-100 coordinates: lanes, zones, grids, goal mouth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The value grid and the posts in pitch width.
GRID_X, GRID_Y = 16, 12
ZONES = GRID_X * GRID_Y
LEFT_POST, RIGHT_POST = 44.618, 55.382


def lane3(y: str) -> Column:
    return F.expr(
        f"case when {y} is null then 'unknown' when {y} < 33.333 then 'left'"
        f" when {y} < 66.667 then 'central' else 'right' end"
    )


def lane5(y: str) -> Column:
    return F.expr(
        f"case when {y} is null then 'unknown' when {y} < 18 then 'left_wide' when {y} < 38 then 'left_half_space'"
        f" when {y} <= 62 then 'central' when {y} <= 82 then 'right_half_space' else 'right_wide' end"
    )


def lane_family(lane: str) -> Column:
    return F.expr(
        f"case when {lane} in ('left_wide','right_wide') then 'wide'"
        f" when {lane} in ('left_half_space','right_half_space') then 'half_space' else {lane} end"
    )


def lane_120(y: str) -> Column:
    """Thirds of the 80-wide pitch, the upper central bound inclusive."""
    return F.expr(f"case when {y} < 80/3.0D then 'left' when {y} <= 160/3.0D then 'central' else 'right' end")


def in_box(x: str, y: str) -> Column:
    return F.coalesce(F.expr(f"{x} >= 83 and {y} between 21.1 and 78.9"), F.lit(False))


def in_danger(x: str, y: str) -> Column:
    return F.coalesce(
        F.expr(f"({x} >= 83 and {y} between 21.1 and 78.9) or ({x} >= 78 and {y} between 24 and 76)"), F.lit(False)
    )


def value_zone(x: str, y: str) -> Column:
    """Zone of the 16 x 12 grid for 0-100 coordinates; -1 where a coordinate is missing."""
    return F.expr(
        f"case when {x} is null or {y} is null then -1 else cast(least(greatest(floor({y} * 12 / 100), 0), 11) * 16"
        f" + least(greatest(floor({x} * 16 / 100), 0), 15) as int) end"
    )


def grid_cell(value: str, bins: int, low: str = "0", high: str = "100") -> Column:
    return F.expr(f"case when {value} is not null then"
                  f" cast(greatest(least(floor(({value} - {low}) * {bins} / ({high} - {low})), {bins} - 1), 0) as int) end")


def grid_edges(limit: float, bins: int) -> Column:
    return F.expr(f"transform(sequence(0, {bins}), i -> i * {limit}D / {bins})")


def grid_centres(limit: float, bins: int) -> Column:
    return F.expr(f"transform(sequence(0, {bins - 1}), i -> (i + 0.5D) * {limit}D / {bins})")


def goal_zone(h: str, v: str) -> Column:
    return F.expr(
        f"concat(case when {v} < 33.333 then 'low' when {v} < 66.667 then 'middle' else 'high' end, ' ',"
        f" case when {h} < 33.333 then 'left' when {h} < 66.667 then 'centre' else 'right' end)"
    )
