"""Block-wise forms give what whole-match windows give, also when one match holds most rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.functions.flags import flags_c, flags_f
from touchline.operators import links, ordering, sequences

EVENT = st.tuples(st.sampled_from(["home", "away"]), st.sampled_from(["Pass", "Tackle", "Goal", "SavedShot"]), st.sampled_from([0, 0, 0, 1, 7, 16, 40]))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(EVENT, min_size=20, max_size=70))
def test_blocks_equal_windows(make_log, events):
    clock, rows = 0, []
    for side, kind, gap in events:
        clock += gap
        rows.append({"team_side": side, "type": kind, "t": clock})
    log = make_log(rows)
    get = lambda df, *c: sorted(tuple(r) for r in df.select("event_index", *c).collect())
    assert get(sequences.event_index(log), "row_index") == get(sequences.event_index_in_blocks(log, rows=9), "row_index")
    assert get(sequences.possessions(flags_f(log)), "possession_id") == get(sequences.possessions_in_blocks(flags_f(log), rows=9), "possession_id")
    c = flags_c(log)
    cols = ["home_before", "away_before", "home_after", "away_after"]
    assert get(sequences.score_state(c), *cols) == get(sequences.score_state_in_blocks(c, rows=9), *cols)
    rules = {"hit": ("is_shot", "own", 15), "loss": ("true", "other", 8)}
    for strict in (True, False):
        plain = links.following(c, rules, [], strict).select("event_index", F.col("hit.event_index").alias("a"), F.col("loss.event_index").alias("b"))
        block = links.following_in_blocks(c, rules, [], strict, rows=9).select("event_index", F.col("hit.event_index").alias("a"), F.col("loss.event_index").alias("b"))
        assert sorted(map(str, plain.collect())) == sorted(map(str, block.collect()))
    assert get(sequences.season_chains(log), "chain_id") == get(sequences.season_chains_in_blocks(log, rows=9), "chain_id")
    for per_team in (False, True):
        assert get(sequences.attack_chains(c, 15.0, per_team), "attack_chain_id") == get(sequences.attack_chains_in_blocks(c, 15.0, per_team, rows=9), "attack_chain_id")
    assert get(sequences.team_action_chains(c), "chain_id") == get(sequences.team_action_chains_in_blocks(c, rows=9), "chain_id")


def test_ranges_cut_a_huge_match(make_log):
    """One match, most of it in one second: no range holds much more than its share of the rows."""
    log = make_log([{"t": 5 if 20 < i < 900 else i, "event_index": float(i)} for i in range(1000)])
    sizes = [r["count"] for r in ordering.row_blocks(log, rows=50).groupBy("_block").count().collect()]
    assert len(sizes) >= 18 and max(sizes) <= 150 and sum(sizes) == 1000
