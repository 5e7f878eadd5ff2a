"""Shot models of each league season against a plain fit that shares no code with them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import players, shot_models
from touchline.operators.value import FEATURES, LEAGUE
from touchline.plans.registry import Tables, TrainedTables

ROUNDS = 6


def plain_tree(x, g, h, depth):
    """Nested (feature, threshold, left, right) or the value of a leaf, by trying every split."""
    rows = len(g)
    if depth < 5 and rows >= 48:
        best, total = (0.0, None), g.sum() ** 2 / (h.sum() + 0.05)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for threshold in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= threshold
                n = left.sum()
                if n < 24 or rows - n < 24 or h[left].sum() < 1e-3 or h[~left].sum() < 1e-3:
                    continue
                gain = round(g[left].sum() ** 2 / (h[left].sum() + 0.05) + g[~left].sum() ** 2 / (h[~left].sum() + 0.05) - total, 9)
                if gain > best[0]:
                    best = (gain, (f, threshold))
        if best[1]:
            f, threshold = best[1]
            left = x[:, f] <= threshold
            return f, threshold, plain_tree(x[left], g[left], h[left], depth + 1), plain_tree(x[~left], g[~left], h[~left], depth + 1)
    return -0.05 * g.sum() / (h.sum() + 0.05)


def value_of(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_probability(x, y):
    """Mean of both models for the rows that they are fitted on."""
    margin = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        tree = plain_tree(x, p - y, p * (1 - p), 0)
        margin += np.array([value_of(tree, row) for row in x])
    spread = np.where(x.std(0) > 0, x.std(0), 1)
    z, w, b = (x - x.mean(0)) / spread, np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):  # plain descent on the convex loss
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w, b = w - 0.004 * (z.T @ (p - y) + w), b - 0.004 * (p - y).sum()
    return (1 / (1 + np.exp(-(z @ w + b))) + 1 / (1 + np.exp(-margin))) / 2


@pytest.fixture(scope="module")
def shots(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    return shot_models.shot_table(t.shots)


def test_scores_of_one_league_season(spark, shots):
    status = shot_models.model_status(shots)
    scores = shot_models.score_shots(shots, status, shot_models.fit_models(shots, status, ROUNDS, bins=10_000), chunk=200).where("season = '2016-2017'").toPandas()
    own = shots.where("season = '2016-2017'").toPandas()
    assert len(scores) == len(own) == 582
    wanted = own[["match_id", "event_index", "shot_family", "goal"]].copy()
    fits = {}
    for kind in ("all", *own["shot_family"].unique()):
        part = own[own["shot_family"] != "penalty"] if kind == "all" else own[own["shot_family"] == kind]
        rate, n = part["goal"].mean(), len(part)
        if kind == "penalty":
            fits[kind] = dict.fromkeys(part.index, rate if n >= 10 else 0.76)
        elif n >= 120 and part["goal"].sum() >= 12:
            w = min(max(n / 1500, 0.15), 1)
            p = plain_probability(part[FEATURES].to_numpy(float), part["goal"].to_numpy(float))
            fits[kind] = dict(zip(part.index, np.clip(w * p + (1 - w) * rate, 0.001, 0.999)))
        else:
            fits[kind] = dict.fromkeys(part.index, rate)
    both = lambda i, f: fits[f][i] if f == "penalty" else 0.5 * fits["all"][i] + 0.5 * fits[f][i]
    wanted["want"] = [float(np.clip(both(i, f), 0.001, 0.999)) for i, f in zip(wanted.index, wanted["shot_family"])]
    joined = wanted.merge(scores[["match_id", "event_index", "xg"]], on=["match_id", "event_index"])
    assert len(joined) == len(own) and np.abs(joined["want"] - joined["xg"]).max() < 1e-6


def test_gates_and_penalties(spark, shots):
    some = shots.where("shot_family in ('penalty', 'header')").limit(0)
    row = shots.first().asDict()
    rows = [{**row, "season": s, "match_id": i, "shot_family": f, "goal": g} for i, (s, f, g) in enumerate(
        [("few", "penalty", 1)] * 9 + [("many", "penalty", 1)] * 5 + [("many", "penalty", 0)] * 5 + [("few", "header", 0)] * 3 + [("few", "header", 1)])]
    small = spark.createDataFrame([tuple(r[c] for c in shots.columns) for r in rows], shots.schema)
    status = shot_models.model_status(small)
    assert {(r["season"], r["model"]): r["status"] for r in status.collect()} == {
        ("few", "penalty"): "default rate", ("many", "penalty"): "own rate", ("few", "header"): "base rate", ("few", "global_non_penalty"): "base rate"}
    got = {(r["season"], r["shot_family"]): r["xg"] for r in shot_models.score_shots(small, status, shot_models.fit_models(small, status, 2)).collect()}
    assert got == {("few", "penalty"): 0.76, ("many", "penalty"): 0.5, ("few", "header"): 0.25}
    none = shot_models.model_status(some)
    assert none.count() == 0 and shot_models.score_shots(some, none, shot_models.fit_models(some, none, 2)).count() == 0
    sure = spark.createDataFrame([tuple({**row, "shot_family": "header", "goal": 0}[c] for c in shots.columns)], shots.schema)
    assert [r["xg"] for r in shot_models.score_shots(sure, shot_models.model_status(sure), shot_models.fit_models(sure, shot_models.model_status(sure), 2)).collect()] == [0.001]


def test_facts_read_the_trained_scores(spark):
    t = TrainedTables(spark, "/root/testdata/sf0.01")
    who = [*LEAGUE, "team", "player"]
    want = {tuple(r[c] for c in who): r["xg"] for r in t.scores.groupBy(*who).agg(F.sum("xg").alias("xg")).collect()}
    got = {tuple(r[c] for c in who): r["xg"] for r in players.player_xg(t.shots).groupBy(*who).agg(F.sum("xg").alias("xg")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    per_shot = {(r["match_id"], r["event_index"]): r["xg"] for r in t.scores.collect()}
    assert all(abs(r["xg"] - per_shot[r["match_id"], r["shot_index"]]) < 1e-12 for r in t.credits.collect())
    assert all(abs(r["xg"] - per_shot[r["match_id"], r["event_index"]]) < 1e-12 for r in t.valued.where("is_shot").collect())


def test_leagues_without_events_are_unavailable(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    quality = shot_models.model_quality(t.log.limit(0), shot_models.shot_table(t.shots).limit(0), t.credits.limit(0), t.valued.limit(0))
    got = shot_models.with_fixtures(quality, t.schedule).collect()
    assert sorted(r["model"] for r in got) == ["xA", "xG", "xT"] and {r["status"] for r in got} == {"unavailable"}
