"""Hand-made cases for inputs that an earlier version got wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline import session
from touchline.functions import text
from touchline.operators import facts, normalise
from touchline.operators.topk import top_per_group
from touchline.sources import documents, tables


def test_qualifiers_with_apostrophes_and_literals(spark):
    cells = [
        '[{"type":"Note","value":"it\'s wide"},{"type":"Cross","value":"1"}]', "[{'type': 'Corner', 'value': None}, {'type': {'displayName': 'Head'}, 'value': 'None'}]",
        "[{'type': 'Note', 'value': \"it's\"}]", None, "broken",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, qualifiers string")
    got = {r["i"]: (r["qual_tags"], r["qual_map"]) for r in documents.parse_qualifiers(df).collect()}
    assert got[0] == (["Note", "Cross"], {"Note": "it's wide", "Cross": "1"})
    assert got[1] == (["Corner", "Head"], {"Corner": "true", "Head": "None"})
    assert got[2][1] == {"Note": "it's"} and not got[3][0] and not got[4][0]


def test_team_keys_and_slugs_of_any_latin_letter(spark):
    names = ["Beşiktaş", "Győr & Co", "Śląsk", "Čukarički", "Malmö FF", "ﬁnal", "Ｆｕｌｌ", "école"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(text.team_key(F.col("n"))).collect()]
    assert got == ["besiktas", "gyorandco", "slask", "cukaricki", "malmoff", "final", "full", "ecole"]
    slugs = spark.createDataFrame([("a  b--c",), ("_x/y_",), (None,), ("Beşiktaş A.Ş.",)], "n string").select(text.slug(F.col("n"))).collect()
    assert [r[0] for r in slugs] == ["a__b__c", "x_y", "", "Besiktas_A.S."]


def test_canonical_team_never_multiplies_events(spark):
    day = dt.datetime(2020, 1, 1)
    schedule = spark.createDataFrame(
        [(1, "Club A", "cluba", day), (1, "Club  A", "cluba", day + dt.timedelta(7)), (2, "RB Leipzig", "rbleipzig", day)], "home_id long, home_team string, home_key string, kickoff timestamp")
    events = spark.createDataFrame([(10, 1, "Club A"), (11, 9, "CLUB A"), (12, 8, "RBL"), (13, 7, "nobody")], "event_id long, team_id long, team string")
    got = {r["event_id"]: r["canonical"] for r in normalise.canonical_team(events, schedule).collect()}
    assert got == {10: "Club A", 11: "Club A", 12: "RB Leipzig"}


def test_upsert_of_two_new_rows_is_the_same_each_time(spark):
    old = spark.createDataFrame([(1, "old", 1), (2, "kept", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", 5), (1, "b", 2)], "k int, v string, n int")
    for frame in (new, new.orderBy(F.desc("v"))):
        assert sorted(map(tuple, tables.upsert_by_key(old, frame, ["k"]).collect())) == [(1, "b", 2), (2, "kept", 1)]


def test_values_count_in_the_involvement_score(spark):
    names = ["e_pass", "e_success", "e_final_third", "e_box", "e_shot", "e_goal", "e_defensive", "e_regain", "e_set_piece", "e_cross", "e_carry"]
    row = lambda p: ("S", "N", "T", 1, "A", p, 1.0, 2.0, *[False] * len(names))
    schema = "season string, nation string, tier string, match_id int, team string, player string, x double, y double, " + ", ".join(f"{n} boolean" for n in names)
    e = spark.createDataFrame([row("p"), row("p"), row("q")], schema)
    values = spark.createDataFrame([("S", "N", "T", "A", "q", 0.5, 0.25, 2.0)], "season string, nation string, tier string, team string, player string, xg double, xa double, xt double")
    got = {r["player"]: (round(r["score"], 9), r["rank"]) for r in facts.player_involvement(e, values).collect()}
    assert got == {"p": (0.16, 2), "q": (round(0.08 + 1.6 * 0.5 + 1.6 * 0.25 + 1.25 * 2, 9), 1)}


def test_rankings_are_whole_unless_a_limit_is_asked_for(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), "id")
    assert top_per_group(df, ["g"], [F.col("id")]).count() == 50
    assert top_per_group(df, ["g"], [F.col("id")], 3).count() == 6


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId, master = "app", "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session(), "x")


def _moves(spark, league, set_piece):
    """Three events of a league season: a move, a shot that scores from its end, a shot that misses."""
    cols = "season string, nation string, tier string, match_id long, event_id long, x double, y double, end_x double, end_y double, is_shot boolean, provider_xg double, type_c string, outcome_c string, qual_c string, f_pass boolean, f_carry boolean, f_cross boolean, f_success boolean, f_shot boolean, f_goal boolean, f_set_piece boolean"
    row = lambda i, x, ex, shot, goal: ("S", league, "T", 1, i, x, 50.0, ex, 50.0 if ex else None, shot, 0.1, "pass", "", "", not shot, False, False, True, shot, goal, set_piece and not shot)
    return spark.createDataFrame([row(1, 30.0, 90.0, False, False), row(2, 90.0, None, True, True), row(3, 90.0, None, True, league == "good")], cols)


def test_leagues_have_grids_of_their_own_and_set_pieces_count_in_league_scope_only(spark, monkeypatch):
    from touchline.functions import flags
    from touchline.operators import value

    monkeypatch.setattr(flags, "flags_f", lambda df: df)
    f = _moves(spark, "good", False).unionByName(_moves(spark, "poor", False))
    grid = value.solve_zones(value.zone_cells(f, value.LEAGUE), value.LEAGUE)
    top = {r["nation"]: r["xt"] for r in grid.groupBy("nation").agg(F.max("xt").alias("xt")).collect()}
    assert top == {"good": 1.0, "poor": 0.5}
    moves = value.attach_values(_moves(spark, "good", True).where("f_pass"), grid).select("league_xt_added", "positive_league_xt", "xt_added", "positive_xt").first()
    assert tuple(moves) == (0.0, 0.0, 0.0, 0.0)  # the only way from the start zone leads to a zone worth the same
    last = value.attach_values(_moves(spark, "poor", True).where("f_pass").withColumn("x", F.lit(60.0)), grid).select("positive_league_xt", "positive_xt").first()
    assert tuple(last) == (0.5, 0.0)


def test_grid_of_a_log_whose_play_rarely_ends(spark):
    from touchline.operators import value

    cells = spark.createDataFrame(
        [(0, 0, 99, 99, 0, 0), (0, -1, 1, 0, 1, 1)], "zone_start int, zone_end int, actions long, moves long, shots long, goals long")
    got = {r["zone"]: r["xt"] for r in value.solve_zones(cells).collect()}
    assert got[0] == pytest.approx(1.0, abs=1e-9)  # thirty rounds would stop at 0.26


def test_following_events_however_far_their_index(spark, make_log):
    from touchline.operators import links

    rows = [{"t": 10, "event_index": 1.0, "type": "Tackle"}, {"t": 18, "event_index": 400_000.0, "type": "Goal"}, {"t": 18.5, "event_index": 400_001.0, "type": "Goal"}]
    log = make_log(rows)
    for strict in (False, True):
        got = links.following(log, {"shot": ("is_shot", "own", 8)}, [], strict).where("event_index = 1").first()
        assert got["shot"]["event_index"] == 400_000.0
        assert links.following(log, {"shot": ("is_shot", "own", 7)}, [], strict).where("event_index = 1").first()["shot"] is None
    assert links.any_following(log, "hit", "is_shot", 8, "own").where("event_index = 1").first()["hit"]
    assert not links.any_following(log, "hit", "is_shot", 7.9, "own").where("event_index = 1").first()["hit"]
