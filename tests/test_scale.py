"""What keeps the larger jobs small: fits side by side, narrow exchanges, cells that are never sent."""

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from touchline.operators import links, shot_models, value
from touchline.operators.value import FEATURES, LEAGUE
from touchline.plans.registry import Tables
from touchline.session import cut_lineage
from touchline.sources import versions


def sample(seed, rows):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 2, (rows, 3)), rng.random((rows, 3)), rng.integers(0, 6, (rows, 2)), np.ones(rows)]).astype(float)
    x = np.column_stack([x, x[:, 3] ** 2])  # the same bins as an earlier column
    return x, (rng.random(rows) < 0.1 + 0.4 * x[:, 0] * x[:, 3]).astype(float)


def test_samples_fitted_together_are_fitted_alone():
    samples = [sample(1, 300), sample(2, 60), sample(3, 30), (np.ones((50, 10)), np.arange(50) % 2.0)]
    for got, (x, y) in zip(shot_models.boosted_together(samples, 12), samples):
        want = shot_models.boosted(x, y, 12)
        assert got[0] == want[0] and all(np.array_equal(a, b) for a, b in zip(got[1:3], want[1:3])) and np.allclose(got[3], want[3], atol=1e-12)
        assert not (got[1] == 9).any()  # of equal splits the first counts


def test_models_over_several_batches(spark, monkeypatch):
    monkeypatch.setattr(shot_models, "_TOGETHER", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        shots = shot_models.shot_table(Tables(spark, "/root/testdata/sf0.01").shots)
        status = shot_models.model_status(shots)
        fits = shot_models.fit_models(shots, status, 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    trained = {tuple(r[c] for c in [*LEAGUE, "model"]) for r in status.where("status = 'trained'").collect()}
    assert trained and {tuple(r[c] for c in [*LEAGUE, "model"]) for r in fits} == trained and len(fits) == len(trained)
    one = next(r for r in fits if r["model"] == shot_models.GLOBAL)
    own = shots.where((F.col("season") == one["season"]) & (F.col("shot_family") != "penalty")).toPandas().sort_values(["match_id", "event_index"])
    base, feature, threshold, leaf = shot_models.boosted(own[FEATURES].to_numpy(float), own["goal"].to_numpy(float), 3)
    assert np.array_equal(one["feature"], feature.ravel()) and np.array_equal(one["threshold"], threshold.ravel()) and np.allclose(one["leaf"], leaf.ravel(), atol=1e-12)


def test_trees_by_blocks_are_the_same(monkeypatch):
    monkeypatch.setattr(shot_models, "_BLOCK", 70)
    for x, y in (sample(1, 300), sample(2, 60), sample(4, 1500), (np.ones((50, 10)), np.arange(50) % 2.0)):
        got, want = shot_models.boosted_by_blocks(x, y, 12), shot_models.boosted(x, y, 12)
        assert got[0] == want[0] and all(np.array_equal(a, b) for a, b in zip(got[1:3], want[1:3])) and np.allclose(got[3], want[3], atol=1e-12)
        line = shot_models.logistic(x, y)
        monkeypatch.setattr(shot_models, "_BLOCK", 10_000)
        whole = shot_models.logistic(x, y)
        monkeypatch.setattr(shot_models, "_BLOCK", 70)
        assert np.allclose(line[0], whole[0], atol=1e-9) and np.allclose(line[1], whole[1], atol=1e-9)


def made_shots(spark, **rows):
    """So many headers in each season, and a penalty, which no model reads."""
    features = [f"cast(crc32(concat(season, id, '{c}')) % {2 if i > 5 else 900} as double) as {c}" for i, c in enumerate(FEATURES)]
    shots = [spark.range(n + 1).selectExpr(f"'{season}' as season", "id") for season, n in rows.items()]
    df = shots[0]
    for other in shots[1:]:
        df = df.union(other)
    return df.selectExpr(
        "'N0' as nation", "'T1' as tier", "season", "id div 20 as match_id", "cast(id % 20 as double) as event_index", "'A' as team", "'P' as player",
        "if(id = 0, 'penalty', 'header') as shot_family", f"cast(crc32(concat(season, id, '{FEATURES[0]}')) % 900 + crc32(concat(id, 'g')) % 900 > 1300 as int) as goal", *features)


def assert_fitted_over_all(shots, fits, rounds):
    own = shots.where("shot_family <> 'penalty'").toPandas().sort_values(["match_id", "event_index"])
    assert {(r["season"], r["model"]) for r in fits} == {(s, m) for s in own["season"] for m in (shot_models.GLOBAL, "header")} and len(fits) == 2 * own["season"].nunique()
    for season, part in own.groupby("season"):
        x, y = part[FEATURES].to_numpy(float), part["goal"].to_numpy(float)
        (line, weights), (base, feature, threshold, leaf) = shot_models.logistic(x, y), shot_models.boosted(x, y, rounds)
        for r in (r for r in fits if r["season"] == season):
            assert r["base"] == base and np.isclose(r["intercept"], line, atol=1e-9) and np.allclose(r["weights"], weights, atol=1e-9)
            assert np.array_equal(r["feature"], feature.ravel()) and np.array_equal(r["threshold"], threshold.ravel()) and np.allclose(r["leaf"], leaf.ravel(), atol=1e-12)


def test_models_are_fitted_over_all_shots(spark):
    shots = cut_lineage(made_shots(spark, a=60_000, b=400), "made")
    assert_fitted_over_all(shots, shot_models.fit_models(shots, shot_models.model_status(shots), 2).collect(), 2)


def test_scores_of_a_large_league_season(spark):
    shots = cut_lineage(made_shots(spark, a=51_000), "made")
    got = shot_models.trained_scores(shots, 2).where("shot_family <> 'penalty'").toPandas().sort_values(["match_id", "event_index"])
    own = shots.where("shot_family <> 'penalty'").toPandas().sort_values(["match_id", "event_index"])
    x, y = own[FEATURES].to_numpy(float), own["goal"].to_numpy(float)
    fit = SimpleNamespace(**dict(zip(("intercept", "weights", "base", "feature", "threshold", "leaf"), (*shot_models.logistic(x, y), *shot_models.boosted(x, y, 2)))))
    assert len(got) == 51_000 and np.allclose(got["xg"], np.clip(shot_models.probability(x, fit), 0.001, 0.999), atol=1e-9)


def test_large_and_small_models_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(shot_models, "_TOGETHER", 50)
    shots = cut_lineage(made_shots(spark, a=700, b=200, c=900, d=1000, e=250), "made")
    whole = type(shots).repartition
    monkeypatch.setattr(type(shots), "repartition", lambda self, n, *by: whole(self, 1, *by))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for large in (300, 900):
            assert_fitted_over_all(shots, shot_models.fit_models(shots, shot_models.model_status(shots), 2, large).collect(), 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prepared_rows_meet_one_narrow_exchange(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    for df in (t.prep, t.runs):
        lines = plan(df).splitlines()
        assert sum("Exchange" in line for line in lines) == 1
        below = "\n".join(lines[next(i for i, line in enumerate(lines) if "Exchange" in line) + 1:])
        assert "home_team" not in below and "Window" not in below  # the raw row is sent


def test_kept_tables_are_written_once(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    df = value.with_zones(t.f)
    versions.build({"t": df}, str(tmp_path / "s"), [], [])
    assert {p.name for p in (tmp_path / "s" / "t").iterdir()} == {versions.manifest(spark, str(tmp_path / "s"))["tables"]["t"]["parts"]["[]"]["path"]}
    back = versions.read(spark, str(tmp_path / "s"), "t")
    assert back.columns == df.columns and back.exceptAll(df).count() == 0 and back.count() == df.count()
    versions.build({"t": df.limit(0)}, str(tmp_path / "e"), [], [])
    assert versions.read(spark, str(tmp_path / "e"), "t").count() == 0


def test_cells_are_made_after_the_exchange(spark):
    rows = [(1, "A", "p", 10.0, 20.0), (1, "A", "q", 90.0, 70.0), (1, "B", "o", 10.0, 20.0), (2, "A", "p", 50.0, 50.0)]
    df = links.control_cells(spark.createDataFrame(rows, "match_id long, team string, player string, x double, y double"))
    lines = plan(df).splitlines()
    made = next(i for i, line in enumerate(lines) if "Generate" in line)
    above = [line for line in lines[:made] if "Exchange" in line or "Aggregate" in line]
    assert "HashAggregate" in above[-1] and "HashAggregate" in above[-2]  # both steps of the sum, no exchange or sort between
    got = {(r["match_id"], r["cell"]): r for r in df.collect()}
    assert len(got) == 768
    for (match, cell), r in got.items():
        cx, cy = (cell % 24 + 0.5) * 5, (cell // 24 + 0.5) * 5
        d, player, team = min((round(float(np.hypot(x * 1.2 - cx, y * 0.8 - cy)), 9), p, t) for m, t, p, x, y in rows if m == match)
        assert (r["player"], r["team"]) == (player, team) and abs(r["distance"] - d) < 1e-8
