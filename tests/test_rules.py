"""Hand-made cases with results worked out from the rules."""

import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import geometry, text
from touchline.functions.flags import flags_b, flags_c, flags_d, flags_e, flags_f
from touchline.operators import facts, filters, league, links, momentum, normalise, sequences, value
from touchline.sources import tables


def rows(df, *cols, order=("event_index",)):
    return [tuple(r) for r in df.orderBy(*order).select(*cols).collect()]


def test_clock(spark):
    df = spark.createDataFrame([(10, 30, None)], "minute int, second int, expanded_minute double")
    assert normalise.expanded_minute(df).first().expanded_minute == 10.5


def test_period_text(spark):
    df = spark.createDataFrame([("SecondHalf",), ("2h",), ("ET1",), ("penalties",), ("",), (None,), ("2.0",)], "p string")
    assert [r[0] for r in df.select(text.period_number(F.col("p"))).collect()] == [2, 2, 3, 5, 1, 1, 2]


def test_unit_rescale(spark):
    df = spark.createDataFrame([("a", 0.9, 40.0), ("a", 0.1, 60.0)], "s string, x double, y double")
    out = normalise.rescale_unit_coordinates(df, ["x", "y"], ["s"]).orderBy("y").collect()
    assert [(round(r.x, 6), r.y) for r in out] == [(90.0, 40.0), (10.0, 60.0)]


def test_entries(make_log):
    log = make_log([
        {"x": 60.0, "end_x": 70.0, "end_y": 5.0}, {"x": 67.0, "end_x": 90.0, "end_y": 5.0}, {"x": 60.0, "end_x": 66.66, "end_y": 5.0},
        {"x": 80.0, "end_x": 84.0, "end_y": 50.0}, {"x": 84.0, "end_x": 90.0, "end_y": 50.0}, {"x": 84.0, "y": 10.0, "end_x": 84.0, "end_y": 10.0},
    ])
    got = rows(flags_b(log), "final_third_entry", "box_entry")
    assert [g[0] for g in got] == [True, False, False, False, False, False]
    assert [g[1] for g in got] == [False, False, False, True, False, False]


def test_missing_start_is_outside_the_box(make_log):
    log = make_log([{"x": None, "y": None, "end_x": 90.0, "end_y": 50.0}])
    assert rows(flags_c(log), "box_entry", "final_third_entry") == [(True, False)]


def test_cards(make_log):
    log = make_log([
        {"type": "Card", "card_type": "SecondYellow"}, {"type": "Card", "card_type": "Yellow", "qual_tags": ["VoidYellowCard"]}, {"type": "Pass", "card_type": None},
    ])
    got = rows(flags_d(sequences.prepare(flags_c(log))), "d_yellow", "d_second_yellow", "d_red", "d_card")
    assert got == [(False, True, True, True), (False, False, False, False), (False, False, False, False)]


def test_corners_prefer_awarded(make_log):
    log = make_log([{"type": "CornerAwarded"}] * 2 + [{"qual_tags": ["CornerTaken"], "end_x": 60.0, "end_y": 50.0}] * 3)
    assert facts.team_summary(flags_d(sequences.prepare(flags_c(log)))).first().corners == 2


def test_ppda(make_log):
    log = make_log(
        [{"team_side": "away", "x": 50.0, "end_x": 55.0, "end_y": 50.0}] * 12 + [{"type": "Tackle", "x": 50.0}] * 4
    )
    got = {r.team: r.ppda for r in facts.ppda_and_tilt(log, flags_e(log)).collect()}
    assert got == {"Home": 3.0, "Away": None}


def test_possessions(make_log):
    log = make_log([{}, {}, {"team_side": "away"}, {}])
    assert rows(sequences.possessions(flags_f(log)), "possession_id", "possession_action") == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_attack_chains(make_log):
    log = make_log([{"t": 0}, {"t": 10}, {"t": 26}, {"t": 30, "type": "Foul"}, {"t": 31}])
    assert rows(sequences.attack_chains(flags_c(log)), "attack_chain_id") == [(1,), (1,), (2,), (3,), (4,)]


@pytest.mark.parametrize(
    "second, expected",
    [
        ({"x": 50.0, "t": 4, "player": "A"}, [(40.0, 50.0, 10.0, 0.001)]),
        ({"x": 42.9, "t": 4, "player": "A"}, []), ({"x": 50.0, "t": 11, "player": "A"}, []), ({"x": 50.0, "t": 4, "player": "B"}, []),
    ],
)
def test_inferred_carry(make_log, second, expected):
    log = make_log([{"type": "BallRecovery", "x": 40.0, "t": 0, "player": "A"}, {**second, "end_x": 60.0, "end_y": 50.0}])
    got = sequences.prepare(flags_c(log)).where("is_inferred_carry")
    assert [(r.x, r.end_x, round(r.carry_distance, 6), r.event_index) for r in got.collect()] == expected


def test_take_on_end(make_log):
    log = make_log([
        {"type": "TakeOn", "x": 40.0, "player": "A", "t": 0}, {"player": "B", "t": 2}, {"player": "A", "x": 48.0, "t": 5, "end_x": 50.0, "end_y": 50.0},
    ])
    got = sequences.add_take_on_ends(flags_c(log)).where("is_take_on").first()
    assert (got.end_x, got.take_on_seconds) == (48.0, 5.0)
    broken = make_log([
        {"type": "TakeOn", "x": 40.0, "player": "A", "t": 0}, {"team_side": "away", "t": 2}, {"player": "A", "x": 48.0, "t": 5, "end_x": 50.0, "end_y": 50.0},
    ])
    assert sequences.add_take_on_ends(flags_c(broken)).where("is_take_on").first().end_x is None


def test_receiver_stops_at_team_change(make_log):
    passed = {"player": "P1", "end_x": 60.0, "end_y": 50.0, "t": 0}
    log = make_log([passed, {"player": "P1", "type": "BallTouch", "t": 3}, {"player": "P2", "type": "BallTouch", "t": 5}])
    assert rows(links.receivers(flags_c(log)), "receiver") == [("P2",)]
    log = make_log([passed, {"player": "X", "team_side": "away", "type": "BallTouch", "t": 3}, {"player": "P2", "type": "BallTouch", "t": 5}])
    assert rows(links.receivers(flags_c(log)), "receiver") == []


def test_assist_links(make_log):
    log = make_log([
        {"player": "P1", "end_x": 60.0, "end_y": 50.0}, {"player": "P2", "end_x": 60.0, "end_y": 50.0},
        {"player": "P3", "type": "SavedShot", "x": 90.0, "provider_xg": 0.3},
    ])
    got = {(r.role, r.player): r.xg for r in value.shot_assists(sequences.possessions(flags_f(log))).collect()}
    assert got == {("assist", "P2"): 0.3, ("secondary", "P1"): 0.3}


def test_score_and_game_state(make_log):
    log = make_log([{"t": 600, "type": "Goal"}, {"t": 900}, {"t": 1200, "type": "Goal", "team_side": "away"}, {"t": 1300}])
    scored = sequences.score_state(flags_c(log))
    assert rows(scored, "home_before", "away_before", "home_after", "away_after") == [(0, 0, 1, 0), (1, 0, 1, 0), (1, 0, 1, 1), (1, 1, 1, 1)]
    assert rows(filters.game_state(scored, "level_score"), "event_index") == [(0.0,), (3.0,)]
    assert rows(filters.game_state(scored, "before_first_goal"), "event_index") == []
    assert rows(filters.game_state(scored, "after_first_red_card"), "event_index") == [(0.0,), (1.0,), (2.0,), (3.0,)]


def test_transition_window(make_log):
    log = make_log([{"type": "Tackle", "t": 0}, {"type": "SavedShot", "t": 15}, {"type": "Tackle", "t": 20}, {"type": "SavedShot", "t": 35.1}])
    got = links.transition_outcomes(flags_c(log)).first()
    assert (got.regains, got.regains_to_shot) == (2, 1)


def test_momentum(make_log):
    log = make_log([{"t": 600, "type": "Goal", "x": 50.0, "is_touch": False}])
    prepared = flags_c(log).withColumns({"positive_xt": F.lit(0.0)})
    got = {r.minute: r.home for r in momentum.rolling_momentum(prepared).collect()}
    assert got[10] == pytest.approx(12.0) and got[14] == pytest.approx(12 * math.exp(-1)) and got[9] == 0 and got[21] == 0 and len(got) == 90


def test_two_zone_model(spark):
    cells = spark.createDataFrame(
        [(0, 1, 1, 1, 0, 0), (0, -1, 1, 0, 0, 0), (1, -1, 2, 0, 1, 1)],
        "zone_start int, zone_end int, actions long, moves long, shots long, goals long",
    )
    xt = {r.zone: r.xt for r in value.solve_zones(cells).collect()}
    assert xt[1] == pytest.approx(0.5) and xt[0] == pytest.approx(0.25) and len(xt) == 192


def test_percentile_and_z(spark):
    base = [("N", "T", "S", f"t{i}", *([float(v)] * len(league.RADAR))) for i, v in enumerate([4, 3, 2, 1])]
    df = spark.createDataFrame(base, ["nation", "tier", "season", "team", *league.RADAR])
    got = {r.team: r.percentile for r in league.radar(df).where("metric = 'goals_for'").collect()}
    assert got["t1"] == pytest.approx(66.6667, abs=1e-3)
    rows_ = [("N", "T", "S", f"t{i}", *([float(v)] * (len(league.METRICS) - 1)), 7.0) for i, v in enumerate([1, 2, 3])]
    z = league.z_scores(spark.createDataFrame(rows_, ["nation", "tier", "season", "team", *league.METRICS]))
    assert [round(r.z, 4) for r in z.where(f"metric = '{league.METRICS[0]}'").orderBy("team").collect()] == [-1.2247, 0.0, 1.2247]
    assert z.where(f"metric = '{league.METRICS[-1]}'").count() == 0


def test_spaced_peaks(spark):
    df = spark.createDataFrame([(1, 10, 9.0), (1, 13, 8.0), (1, 17, 7.0), (1, 30, 6.0)], "match_id long, minute int, net double")
    assert [r.minute for r in momentum.spaced_windows(df, "net").orderBy("rank").collect()] == [10, 17, 30]


def test_lanes(spark):
    df = spark.createDataFrame([(17.9,), (18.0,), (62.0,), (82.0,), (82.1,)], "y double")
    assert [r[0] for r in df.select(geometry.lane5("y")).collect()] == ["left_wide", "left_half_space", "central", "right_half_space", "right_wide"]


def test_zone_of_missing_coordinate(spark):
    df = spark.createDataFrame([(None, 5.0), (100.0, 100.0), (0.0, 0.0)], "x double, y double")
    assert [r[0] for r in df.select(geometry.value_zone("x", "y")).collect()] == [-1, 191, 0]


def test_upserts(spark):
    old = spark.createDataFrame([(7, "a"), (7, "b"), (7, "c"), (8, "d")], "match_id long, v string")
    new = spark.createDataFrame([(7, "x"), (7, "y")], "match_id long, v string")
    assert sorted((r.match_id, r.v) for r in tables.upsert_matches(old, new).collect()) == [(7, "x"), (7, "y"), (8, "d")]
    pos_old = spark.createDataFrame([(1, "T", "P", "DC")], "match_id long, team string, player string, player_position string")
    pos_new = spark.createDataFrame([(1, "T", "P", "Unknown")], "match_id long, team string, player string, player_position string")
    assert tables.upsert_positions(pos_old, pos_new).first().player_position == "DC"


def test_coverage(spark):
    s = spark.createDataFrame(
        [("N", "T", "S", 1, "A", "B", "a", "b", "6", None)],
        "nation string, tier string, season string, match_id long, home_team string, away_team string, home_key string, away_key string, status string, elapsed string",
    ).withColumn("kickoff", F.current_timestamp())
    saved = spark.createDataFrame([(1, "a")], "match_id long, team_key string")
    failed = spark.createDataFrame([], "match_id long, reason string")
    got = tables.coverage(s, saved, failed).first()
    assert (got.data_status, got.scrape_status) == ("partial", "to_complete")


def test_csv_repair(spark):
    lines = spark.createDataFrame([("1,a",), ("2,b,c,d,e",), ("",), ('3,"x,y",z',)], "value string")
    got = sorted(tuple(r) for r in tables.parse_lines(lines, "id,name,name").collect())
    assert got == [("1", "a", "", "repaired_field_count"), ("2", "b", "c", "repaired_field_count"), ("3", "x,y", "z", "normal")]
    assert tables.header_names("id,,id") == ["id", "unnamed_1", "id_1"]


def test_chain_funnel_is_monotone_in_goals(make_log):
    from touchline.operators import defence

    log = make_log([{"x": 30.0, "end_x": 90.0, "end_y": 50.0, "t": 0}, {"type": "Goal", "x": 90.0, "t": 4}, {"team_side": "away", "t": 60, "x": 10.0, "end_x": 12.0, "end_y": 50.0}])
    got = {r.team: r for r in defence.chain_funnel(flags_c(log)).collect()}
    home = got["Home"]
    assert (home.attacks, home.reached_middle, home.reached_final, home.entered_box, home.chains_with_goals) == (1, 1, 1, 1, 1)
    assert got["Away"].reached_middle == 0
