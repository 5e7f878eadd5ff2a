"""Minute-by-minute series: momentum, possession share, peaks, phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _minutes(df: DataFrame) -> DataFrame:
    """One row per match and minute, 1 .. 90 or the last minute of the match."""
    last = df.groupBy("match_id").agg(F.expr("cast(greatest(ceil(max(expanded_minute)), 90) as int)").alias("_n"))
    return last.select("match_id", "_n", F.explode(F.expr("sequence(1, _n)")).alias("minute"))


def rolling_momentum(valued: DataFrame) -> DataFrame:
    """Ten-minute look-back with exponential decay.  Every weighted event is sent to the
    minutes it counts for, so the window is an aggregation with map-side combine."""
    weight = (
        "if(is_goal, 8D, 0D) + if(is_shot, 4D, 0D) + 6D * if(is_shot, coalesce(provider_xg, 0D), 0D) + if(box_entry, 3D, 0D)"
        " + if(final_third_entry, 1.35D, 0D) + if(is_cross, 0.65D, 0D) + if(high_regain, 0.9D, 0D) + if(attacking_third_touch, 0.12D, 0D)"
    )
    df = valued.withColumns({"_w": F.expr(weight), "_xt": F.expr("least(positive_xt, 0.12D)")}).where("_w > 0 or _xt > 0")
    df = df.withColumn(
        "minute", F.explode(F.expr("sequence(cast(greatest(ceil(expanded_minute), 1) as int), cast(floor(expanded_minute + 10) as int))"))
    )
    decay = "exp(-(minute - expanded_minute) / 4D)"
    sums = df.groupBy("match_id", "minute").agg(
        *[F.sum(F.expr(f"if(team_side = '{s}', _w * {decay}, 0D)")).alias(f"{s}_pressure") for s in ("home", "away")],
        *[F.sum(F.expr(f"if(team_side = '{s}', _xt * 34D * {decay}, 0D)")).alias(f"{s}_xt") for s in ("home", "away")],
    )
    names = ["home_pressure", "away_pressure", "home_xt", "away_xt"]
    out = _minutes(valued).drop("_n").join(sums, ["match_id", "minute"], "left").na.fill(0.0, names)
    return out.withColumns(
        {
            "home": F.expr("home_pressure + home_xt"), "away": F.expr("away_pressure + away_xt"),
            "net": F.expr("home_pressure + home_xt - away_pressure - away_xt"),
        }
    )


def rolling_possession(prepared: DataFrame) -> DataFrame:
    """Three-minute look-back shares; an empty window keeps the last known side."""
    df = prepared.where("is_touch or is_pass or is_cross or is_carry or is_take_on or is_shot")
    counted = df.withColumn(
        "minute", F.explode(F.expr("sequence(cast(greatest(ceil(expanded_minute), 1) as int), cast(floor(expanded_minute + 3) as int))"))
    ).groupBy("match_id", "minute").agg(
        F.count_if(F.expr("team_side = 'home'")).alias("home_events"), F.count_if(F.expr("team_side = 'away'")).alias("away_events")
    )
    latest = df.groupBy("match_id", F.expr("cast(greatest(ceil(expanded_minute), 1) as int)").alias("minute")).agg(
        F.max_by("team_side", F.struct("period", "expanded_minute", "event_index")).alias("_side")
    )
    w = Window.partitionBy("match_id").orderBy("minute")
    out = _minutes(df).drop("_n").join(counted, ["match_id", "minute"], "left").join(latest, ["match_id", "minute"], "left")
    out = out.na.fill(0, ["home_events", "away_events"]).withColumn("_known", F.last("_side", True).over(w))
    out = out.withColumn("_empty", F.expr("home_events + away_events = 0"))
    out = out.withColumn(
        "dominant_side",
        F.expr("case when _empty then coalesce(_known, 'none') when abs(home_events - away_events) <= 1 then 'even'"
               " when home_events > away_events then 'home' else 'away' end"),
    ).withColumns(
        {
            "home_events": F.expr("if(_empty, if(_known = 'home', 1L, 0L), home_events)"),
            "away_events": F.expr("if(_empty, if(_known = 'away', 1L, 0L), away_events)"),
        }
    )
    return out.withColumn(
        "home_share", F.expr("100D * home_events / greatest(home_events + away_events, 1)")
    ).drop("_side", "_known", "_empty")


def spaced_windows(series: DataFrame, value: str, keep: int = 3, gap: int = 6, trough: bool = False) -> DataFrame:
    """Best minutes of each match, at least ``gap`` apart: greedy over the ranked minutes
    (one array per match, as long as the match has minutes)."""
    sign = "" if trough else "-"
    df = series.groupBy("match_id").agg(
        F.expr(f"array_sort(collect_list(struct({sign}round({value}, 9) as k, minute, {value} as v)))").alias("ranked")
    )
    kept = (
        "aggregate(ranked, cast(array() as array<struct<k:double,minute:int,v:double>>), (a, r) ->"
        f" if(size(a) < {keep} and not exists(a, z -> abs(z.minute - r.minute) < {gap}), concat(a, array(r)), a))"
    )
    return df.select("match_id", F.posexplode(F.expr(kept)).alias("rank", "w")).selectExpr(
        "match_id", "rank + 1 as rank", "w.minute as minute", "w.v as value"
    )


def bucket(minute: str) -> str:
    return (
        f"case when {minute} is null then 'unknown' when {minute} <= 15 then '0-15' when {minute} <= 30 then '16-30'"
        f" when {minute} <= 45 then '31-45' when {minute} <= 60 then '46-60' when {minute} <= 75 then '61-75'"
        f" when {minute} <= 90 then '76-90' else '90+' end"
    )


def momentum_profile(series: DataFrame) -> DataFrame:
    """Control share, extremes and phase means of each side."""
    out = None
    aggs = []
    for side, sign in (("home", ""), ("away", "-")):
        aggs += [
            F.expr(f"100D * count_if({sign}net > 0) / count(1)").alias(f"{side}_control"),
            F.expr(f"max({sign}net)").alias(f"{side}_peak"), F.expr(f"min({sign}net)").alias(f"{side}_trough"),
            F.expr(f"avg(if(minute <= 30, {sign}net, null))").alias(f"{side}_early"),
            F.expr(f"avg(if(minute > 30 and minute <= 60, {sign}net, null))").alias(f"{side}_middle"),
            F.expr(f"avg(if(minute > 60, {sign}net, null))").alias(f"{side}_late"),
        ]
    out = series.groupBy("match_id").agg(*aggs)
    pick = lambda s: F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{n}").alias(n) for n in ("control", "peak", "trough", "early", "middle", "late")])
    return out.select("match_id", F.explode(F.array(pick("home"), pick("away"))).alias("p")).select("match_id", "p.*")


def momentum_buckets(series: DataFrame) -> DataFrame:
    df = series.withColumn("bucket", F.expr(bucket("minute")))
    return df.groupBy("match_id", "bucket").agg(
        F.avg("home").alias("home"), F.avg("away").alias("away"), F.avg("net").alias("net"), F.count(F.lit(1)).alias("minutes")
    )
