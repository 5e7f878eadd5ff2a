import datetime as dt

import pytest

from touchline import matchlog
from touchline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log_schema(spark):
    raw = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    return matchlog.match_log(raw).schema


@pytest.fixture(scope="session")
def make_log(spark, log_schema):
    """Canonical rows from short dicts; anything left out takes a plain default."""

    def build(rows):
        out = []
        for i, r in enumerate(rows):
            side = r.get("team_side", "home")
            clock = float(r.get("t", i * 5))
            kind, outcome = r.get("type", "Pass"), r.get("outcome", "Successful")
            base = {
                "event_id": i, "season": "2016-2017", "nation": "N0", "tier": "T1", "match_id": 1, "event_index": float(i), "period": 1,
                "minute": int(clock // 60), "second": int(clock % 60), "expanded_minute": clock / 60, "clock_s": clock,
                "team": "Home" if side == "home" else "Away", "team_key": side, "team_id": 1 if side == "home" else 2, "team_side": side,
                "opponent": "Away" if side == "home" else "Home", "player": f"P{i}", "player_id": i, "shirt_no": 5, "position": "MC", "is_starter": True,
                "type": kind, "type_c": kind.lower(), "outcome": outcome, "outcome_c": outcome.lower(), "card_type": None, "qual_tags": [],
                "x": 50.0, "y": 50.0, "end_x": None, "end_y": None, "goal_mouth_y": None, "goal_mouth_z": None, "blocked_y": None, "provider_xg": None,
                "is_touch": True, "is_shot": kind in ("Goal", "SavedShot", "MissedShots", "BlockedShot", "ShotOnPost"), "is_goal": kind == "Goal",
                "home_team": "Home", "away_team": "Away", "home_id": 1, "away_id": 2, "kickoff": dt.datetime(2016, 8, 1, 15),
            }
            base.update({k: v for k, v in r.items() if k not in ("t", "type", "outcome", "team_side")})
            base["qual_c"] = "".join(base["qual_tags"]).lower()
            out.append(tuple(base[f.name] for f in log_schema.fields))
        return spark.createDataFrame(out, log_schema)

    return build
