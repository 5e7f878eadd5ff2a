"""Shot families over all leagues, style map, team clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.facts import SEASON
from touchline.operators.league import DIMENSIONS, METRICS, TEAM
from touchline.operators.shot_models import MIN_GOALS, MIN_PENALTIES, MIN_SHOTS


def model_status(features: DataFrame) -> DataFrame:
    """Per shot family: sample, rate, and whether a model may be trained."""
    df = features.groupBy("shot_family").agg(F.count(F.lit(1)).alias("shots"), F.sum("goal").alias("goals"))
    return df.withColumns(
        {
            "goal_rate": F.expr("goals / cast(shots as double)"),
            "status": F.expr(
                f"case when shot_family = 'penalty' then if(shots >= {MIN_PENALTIES}, 'own rate', 'default rate')"
                f" when shots >= {MIN_SHOTS} and goals >= {MIN_GOALS} then 'trained' else 'base rate' end"
            ),
        }
    )


def _components(frame: pd.DataFrame):
    """Metrics in use, the two axes, their shares of the variance and the places of the teams; None where there are none."""
    values = frame[METRICS].astype(float).replace([np.inf, -np.inf], np.nan)
    use = [c for c in METRICS if values[c].count() >= 3 and values[c].std(ddof=0) > 0]
    if len(frame) < 3 or len(use) < 3:
        return None
    x = values[use].fillna(values[use].median()).fillna(0.0).to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    _, size, axes = np.linalg.svd(z, full_matrices=False)
    # A component is free in its sign: its largest loading is positive.
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return use, axes[:2], (100 * size**2 / (size**2).sum())[:2], z @ axes[:2].T


def _pca(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    found = _components(frame)
    if found is None:
        return frame[TEAM].assign(pc1=np.nan, pc2=np.nan, pc1_variance=np.nan, pc2_variance=np.nan)
    _, _, share, place = found
    return frame[TEAM].assign(pc1=place[:, 0], pc2=place[:, 1], pc1_variance=share[0], pc2_variance=share[1])


def _loadings(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    found = _components(frame)
    if found is None:
        return pd.DataFrame({**{c: pd.Series(dtype=object) for c in (*SEASON, "metric")}, "pc1": pd.Series(dtype=float), "pc2": pd.Series(dtype=float)})
    use, axes, _, _ = found
    return pd.DataFrame({**{c: [v] * len(use) for c, v in zip(SEASON, key)}, "metric": use, "pc1": axes[0], "pc2": axes[1]})


def pca_map(rows: DataFrame) -> DataFrame:
    """Two components of the standardised metrics of each league season (a few dozen clubs at most).

    A missing metric takes the league's median, then 0; a metric needs three values that are not all the same.
    A league of fewer than three teams or metrics has no components: its teams stay, with nulls."""
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in TEAM]
    schema = ", ".join([*kinds, *[f"{c} double" for c in ("pc1", "pc2", "pc1_variance", "pc2_variance")]])
    df = rows.select(*TEAM, *[F.col(m).cast("double").alias(m) for m in METRICS])
    out = df.groupBy(*SEASON).applyInPandas(_pca, schema)
    return out.select(*TEAM, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("pc1", "pc2", "pc1_variance", "pc2_variance")])


def pca_loadings(rows: DataFrame) -> DataFrame:
    """The weight of each metric in the two components of a league season; a league without components has no rows."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in SEASON)
    df = rows.select(*TEAM, *[F.col(m).cast("double").alias(m) for m in METRICS])
    return df.groupBy(*SEASON).applyInPandas(_loadings, f"{kinds}, metric string, pc1 double, pc2 double")


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds until nothing moves, the tightest of one start from every row.

    A start is a row and then, again and again, the row furthest from those chosen: no generator, so every run agrees.
    Clusters are numbered in the order of their first rows.
    """
    best = (np.inf, None)
    for start in range(len(x)):
        centre = x[[start]]
        while len(centre) < k:
            centre = np.vstack([centre, x[((x[:, None] - centre) ** 2).sum(2).min(1).argmax()]])
        label, moved = None, ((x[:, None] - centre) ** 2).sum(2).argmin(1)
        while label is None or (label != moved).any():
            label = moved
            centre = np.array([x[label == c].mean(0) if (label == c).any() else centre[c] for c in range(k)])
            moved = ((x[:, None] - centre) ** 2).sum(2).argmin(1)
        spread = ((x - centre[label]) ** 2).sum()
        if spread < best[0] - 1e-9:
            best = (spread, label)
    return pd.factorize(best[1])[0]


def _clusters(k: int | None):
    dims, order = list(DIMENSIONS), ["pressing", "control", "progression", "chance_creation", "width", "set_piece"]

    def of_league(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("team").reset_index(drop=True)
        if len(frame) < 4:
            return frame.assign(cluster=pd.array([None] * len(frame), "Int32"), label=None)
        x = frame[dims].to_numpy(float)
        spread = np.where(x.std(0) > 0, x.std(0), 1)
        frame["cluster"] = pd.array(_k_means((x - x.mean(0)) / spread, k or min(4, max(2, len(frame) // 3))), "Int32")
        centre = frame.groupby("cluster")[order].transform("mean")
        frame["label"] = np.where(centre.max(axis=1) >= 52, centre.idxmax(axis=1) + " profile", "balanced profile")
        return frame

    return of_league


def team_clusters(scores: DataFrame, k: int | None = None) -> DataFrame:
    """k-means on the six scores of each league season; a cluster is labelled by its largest mean score.
    A league of fewer than four teams is not clustered: its teams stay, with nulls."""
    dims = list(DIMENSIONS)
    wide = scores.groupBy(*TEAM).pivot("dimension", dims).agg(F.first("score")).na.fill(50.0, dims)
    kinds = [f"{c} {wide.schema[c].dataType.simpleString()}" for c in TEAM]
    schema = ", ".join(["cluster int", *kinds, *[f"{d} double" for d in dims], "label string"])
    return wide.groupBy(*SEASON).applyInPandas(_clusters(k), schema)


def cluster_centroids(clusters: DataFrame) -> DataFrame:
    """Per league season and cluster: label, its teams in order, and the mean of each score; ``clusters`` as ``team_clusters`` gives them."""
    means = [F.avg(d).alias(d) for d in DIMENSIONS]
    return clusters.where("cluster is not null").groupBy(*SEASON, "cluster", "label").agg(F.sort_array(F.collect_list("team")).alias("teams"), *means)
