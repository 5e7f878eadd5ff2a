"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from touchline.plans import catalogue
from touchline.session import local_session

HEADLINE = [
    "a02_team_match_summary", "a03_team_style_profile", "a04_momentum_profile", "a01_team_summary", "a06_ppda_and_tilt", "a10_player_involvement",
    "w02_possessions", "w04_attack_chains", "w06_rolling_momentum", "w07_score_state", "w15_inferred_carries", "w19_possession_chains",
    "j12_receivers", "j13_pressing_effect", "j17_shot_assists", "j23_transition_outcomes", "a11_pass_edges", "a20_chain_funnel",
    "a34_set_piece_summary", "m03_zone_values", "j03_attach_values", "a38_league_rows", "a42_correlation_pearson", "a59_season_dashboard", "t02_stream_momentum",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    catalogue.QUERIES["p12_match_order"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's code paths
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
