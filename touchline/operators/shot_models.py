"""Shot probabilities: models of every league season, fitted and applied in two jobs for all leagues.

Each league season has one model over all shots but penalties and one for each shot family; a model is the mean
of a regularised logistic regression and boosted trees, and is fitted where its sample passes the gates. Each
(league season, model) is fitted by itself, over all of its shots, in one task. Small samples are fitted together; one of
more than ``large`` shots stands in a file of its task and is read in blocks, so that memory holds about a byte a value and
40 bytes a shot of it; the time of its fit grows with its shots. For scoring, the shots of a league are dealt into chunks of
about ``chunk`` rows, each of which meets its league's models once.

Defined results: a league without shots has no rows; equal rows get equal scores; a family below the gates takes
its rate, and penalties the rate of the league's penalties or, with fewer than ten, the fixed one.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.value import FEATURES, LEAGUE
from touchline.session import cut_lineage

# Sample gates, penalty default, the size of the two models, and the blend.
MIN_SHOTS, MIN_GOALS, MIN_PENALTIES, PENALTY_RATE = 120, 12, 10, 0.76
ROUNDS, DEPTH, RATE, MIN_LEAF, LEAF_L2, BINS = 260, 5, 0.05, 24, 0.05, 255
FULL_SAMPLE, LEAST_WEIGHT, CLIP = 1500.0, 0.15, 0.001
FAMILIES = ("open_play", "header", "set_piece", "direct_free_kick")
GLOBAL = "global_non_penalty"
SHOT = ["match_id", "event_index", "team", "player", "shot_family", "goal"]
_NODES = 2 ** (DEPTH + 1) - 1
# Rows that meet all trees at once, models that one task fits, rows of the models that are fitted together, and rows of a
# sample that are in work at once.
_ROWS, _FITS, _TOGETHER, _BLOCK = 512, 16, 12_000, 65_536
_MODEL = "model string, intercept double, weights array<double>, base double, feature array<int>, threshold array<double>, leaf array<double>"


def shot_table(features: DataFrame) -> DataFrame:
    """Keys, family, goal and the features of every shot, stored, as fits and scores read it."""
    return cut_lineage(features.select(*LEAGUE, *SHOT, *[F.col(c).cast("double").alias(c) for c in FEATURES]), "shots")


def model_status(shots: DataFrame) -> DataFrame:
    """One row per league season and model: shots, goals, goal_rate, status; the rate of penalties is the one they get."""
    kinds = F.when(F.col("shot_family") == "penalty", F.array("shot_family")).otherwise(F.array(F.lit(GLOBAL), "shot_family"))
    df = shots.select(*LEAGUE, F.explode(kinds).alias("model"), "goal").groupBy(*LEAGUE, "model").agg(F.count("*").alias("shots"), F.sum("goal").alias("goals"))
    own = F.col("goals") / F.col("shots")
    penalty = F.col("model") == "penalty"
    rate = F.when(penalty & (F.col("shots") < MIN_PENALTIES), F.lit(PENALTY_RATE)).otherwise(own)
    status = F.when(penalty, F.when(F.col("shots") < MIN_PENALTIES, "default rate").otherwise("own rate")).when(
        (F.col("shots") >= MIN_SHOTS) & (F.col("goals") >= MIN_GOALS), "trained").otherwise("base rate")
    return df.withColumns({"goal_rate": rate, "status": status})


def _blocks(rows: int) -> list[slice]:
    return [slice(start, start + _BLOCK) for start in range(0, rows, _BLOCK)]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights (of the raw columns) that minimise the log loss plus half the squared standardised weights."""
    blocks = _blocks(len(x))
    mean = sum(x[b].sum(0) for b in blocks) / len(x)
    spread = np.sqrt(sum(((x[b] - mean) ** 2).sum(0) for b in blocks) / len(x))
    spread = np.where(spread > 0, spread, 1.0)
    penalty = np.r_[0.0, np.ones(x.shape[1])]

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in blocks:
            yield np.column_stack([np.ones(len(x[b])), (x[b] - mean) / spread]), y[b]

    if len(blocks) == 1:
        only = list(rows())
        rows = lambda: only
    loss = lambda w: sum(np.logaddexp(0, z @ w).sum() - own @ (z @ w) for z, own in rows()) + 0.5 * (penalty * w * w).sum()
    w = np.zeros(len(penalty))
    for _ in range(100):
        gradient, curve = penalty * w, np.diag(penalty + 1e-12)
        for z, own in rows():
            p = 1 / (1 + np.exp(-(z @ w)))
            gradient, curve = gradient + z.T @ (p - own), curve + (z.T * (p * (1 - p))) @ z
        step = np.linalg.solve(curve, gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(w[0] - (w[1:] * mean / spread).sum()), w[1:] / spread


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of the bins of a column: between its values, or between its quantiles where it has many."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="midpoint"))
    return (values[1:] + values[:-1]) / 2


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, bins: int = BINS) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Start value, and per tree and node (children of k: 2k + 1, 2k + 2) the feature, the threshold and the value.

    Trees grow level by level on sums of first and second derivatives of the log loss; a feature of -1 marks a leaf.
    """
    return boosted_together([(x, y)], rounds, bins)[0]


def boosted_together(samples: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, bins: int = BINS) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """``boosted`` for several samples, each by itself; a level of all their trees is one pass.

    Columns with many bins keep their rows in order, so a pass sums rows instead of bins, and splits are looked for only
    where both sides have rows enough; columns of two bins need one sum. A column with the bins of an earlier one is
    left out, because the first of equal splits counts.
    """
    columns, number = samples[0][0].shape[1], len(samples)
    edges = [[_edges(c, bins) for c in x.T] for x, _ in samples]
    stride = 1 + max(len(e) for own in edges for e in own)
    place = np.concatenate([np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(own, x.T)]) for own, (x, _) in zip(edges, samples)])
    ends = np.full((number, columns * stride), np.nan)
    for i, own in enumerate(edges):
        for f, e in enumerate(own):
            ends[i, f * stride:f * stride + len(e)] = e
    most = [max(len(own[f]) for own in edges) for f in range(columns)]
    used = [f for f in range(columns) if most[f] and not any(np.array_equal(place[:, f], place[:, e]) for e in range(f))]
    many, two = [f for f in used if most[f] > 1], [f for f in used if most[f] == 1]
    model = np.repeat(np.arange(number), [len(y) for _, y in samples])
    order = np.argsort(model * stride + place[:, many].T, axis=1, kind="stable").astype(np.int32)
    by_column = np.ascontiguousarray((place[:, many] + np.array(many, np.int64) * stride).T.astype(np.int32))
    row_two, column_two = np.nonzero(place[:, two] == 0)
    bins_two, column = np.array(two, np.int64) * stride, np.arange(len(many))[:, None]
    y = np.concatenate([y for _, y in samples])
    rate = np.clip([own.mean() for _, own in samples], 1e-9, 1 - 1e-9)
    base = np.log(rate / (1 - rate))
    margin, total = base[model], number * _NODES
    runs = [np.zeros((len(many), len(y) + 1)) for _ in range(2)]
    feature, threshold, leaf = np.full((rounds, total), -1, np.int32), np.zeros((rounds, total)), np.zeros((rounds, total))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, node, now = p - y, p * (1 - p), model * _NODES, order
        for level in range(DEPTH + 1):
            held = np.bincount(node, minlength=total)
            nodes = np.flatnonzero(held)
            nodes = nodes[nodes % _NODES >= 2**level - 1]
            sums = [np.bincount(node, w, total)[nodes] for w in (g, h)]
            leaf[t, nodes] = -RATE * sums[0] / (sums[1] + LEAF_L2)
            open_ = held[nodes] >= 2 * MIN_LEAF
            if level == DEPTH or not open_.any():
                break
            cells, whole = nodes[open_], [w[open_] for w in sums]
            size, k = held[cells], len(cells)
            slots = np.full(total, k, np.uint16 if k < 2**16 else np.int64)
            slots[cells] = np.arange(k)
            slot, m = slots[node], int(size.sum())
            if level or m < len(y):
                now = now.ravel()[np.argsort(slot[now], axis=1, kind="stable")[:, :m] + column * now.shape[1]]
            start, at = np.cumsum(size) - size, np.repeat(np.arange(k), size)
            # Places after which a node may be cut: the same ones in every column.
            left = np.arange(m) - start[at] + 1
            cut = np.flatnonzero((left >= MIN_LEAF) & (size[at] - left >= MIN_LEAF))
            here = by_column[column, now[:, cut]]
            of, to = np.nonzero(here != by_column[column, now[:, cut + 1]])
            for run, w in zip(runs, (g, h)):
                np.cumsum(w[now], axis=1, out=run[:, 1:m + 1])
            who = at[cut[to]]
            below = [r[of, cut[to] + 1] - r[of, start[who]] for r in runs]
            cell = slot[row_two].astype(np.int64) * len(two) + column_two
            few = [np.bincount(cell, w, (k + 1) * len(two)).reshape(k + 1, -1)[:k] for w in (g[row_two], h[row_two], None)] if two else [np.zeros((k, 0))] * 3
            on, of_two = np.nonzero((few[2] >= MIN_LEAF) & (size[:, None] - few[2] >= MIN_LEAF))
            bin_, who = np.concatenate([here[of, to], bins_two[of_two]]), np.concatenate([who, on])
            low = [np.concatenate([b, f[on, of_two]]) for b, f in zip(below, few)]
            all_ = [w[who] for w in whole]
            high = [w - c for w, c in zip(all_, low)]
            gain = low[0] ** 2 / (low[1] + LEAF_L2) + high[0] ** 2 / (high[1] + LEAF_L2) - all_[0] ** 2 / (all_[1] + LEAF_L2)
            gain = np.where((low[1] >= 1e-3) & (high[1] >= 1e-3), np.round(gain, 9), 0.0)
            top = np.zeros(k)
            np.maximum.at(top, who, gain)
            split = top > 0
            hit = np.flatnonzero((gain == top[who]) & (gain > 0))
            best = np.full(k, columns * stride - 1)
            np.minimum.at(best, who[hit], bin_[hit])
            chosen = best // stride
            feature[t, cells[split]], threshold[t, cells[split]] = chosen[split], ends[cells[split] // _NODES, best[split]]
            rows = np.flatnonzero(np.r_[split, False][slot])
            mine, was = slot[rows], node[rows]
            node[rows] = 2 * was - model[rows] * _NODES + 1 + (place[rows, chosen[mine]] > (best % stride)[mine])
        margin += leaf[t, node]
    parts = [np.split(a, number, axis=1) for a in (feature, threshold, leaf)]
    return [(float(base[i]), *(p[i] for p in parts)) for i in range(number)]


def boosted_by_blocks(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, bins: int = BINS) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """``boosted`` for a sample of many rows, which may stand in a file.

    Memory holds the bins of the rows and their derivatives; a level sums all rows by node and bin, block by block. Splits,
    gates and the order among equal ones are those of ``boosted_together``.
    """
    blocks, edges, used = _blocks(len(y)), [_edges(np.array(c), bins) for c in x.T], []
    place = np.empty((x.shape[1], len(y)), np.min_scalar_type(max(map(len, edges))))
    for f, e in enumerate(edges):
        own = place[len(used)]
        own[:] = np.searchsorted(e, x[:, f], side="left")
        if len(e) and not any(np.array_equal(own, earlier) for earlier in place[:len(used)]):
            used.append(f)
    widths = [len(edges[f]) + 1 for f in used]
    column, bin_ = np.repeat(np.arange(len(used)), [n - 1 for n in widths]), np.concatenate([np.arange(n - 1) for n in widths] or [np.zeros(0, int)])
    rate = np.clip(y.mean(), 1e-9, 1 - 1e-9)
    base = float(np.log(rate / (1 - rate)))
    margin, g, h, node = np.full(len(y), base), np.empty(len(y)), np.empty(len(y)), np.empty(len(y), np.uint8)
    feature, threshold, leaf = np.full((rounds, _NODES), -1, np.int32), np.zeros((rounds, _NODES)), np.zeros((rounds, _NODES))
    for t in range(rounds):
        for b in blocks:
            p = 1 / (1 + np.exp(-margin[b]))
            g[b], h[b] = p - y[b], p * (1 - p)
        node[:] = 0
        for level in range(DEPTH + 1):
            whole = np.zeros((3, _NODES))
            for b in blocks:
                whole += [np.bincount(node[b], w, _NODES) for w in (g[b], h[b], None)]
            nodes = np.flatnonzero(whole[2])
            nodes = nodes[nodes >= 2**level - 1]
            leaf[t, nodes] = -RATE * whole[0, nodes] / (whole[1, nodes] + LEAF_L2)
            cells = nodes[whole[2, nodes] >= 2 * MIN_LEAF]
            if level == DEPTH or not len(cells) or not used:
                break
            k = len(cells)
            slots = np.full(_NODES, k)
            slots[cells] = np.arange(k)
            sums = [np.zeros((3, (k + 1) * n)) for n in widths]
            for b in blocks:
                slot = slots[node[b]]
                for own, n, total in zip(place, widths, sums):
                    cell = slot * n + own[b]
                    for of, w in zip(total, (g[b], h[b], None)):
                        of += np.bincount(cell, w, len(of))
            low = np.concatenate([s.reshape(3, k + 1, n)[:, :k, :-1].cumsum(2) for s, n in zip(sums, widths)], 2)
            all_ = whole[:, cells, None]
            high = all_ - low
            gain = low[0] ** 2 / (low[1] + LEAF_L2) + high[0] ** 2 / (high[1] + LEAF_L2) - all_[0] ** 2 / (all_[1] + LEAF_L2)
            gain = np.where((low[1] >= 1e-3) & (high[1] >= 1e-3) & (low[2] >= MIN_LEAF) & (high[2] >= MIN_LEAF), np.round(gain, 9), 0.0)
            best = gain.argmax(1)  # the first of equal ones
            split = gain[np.arange(k), best] > 0
            chosen, last = column[best], bin_[best]
            feature[t, cells[split]] = [used[c] for c in chosen[split]]
            threshold[t, cells[split]] = [edges[used[c]][e] for c, e in zip(chosen[split], last[split])]
            for b in blocks:
                slot = slots[node[b]]
                rows = np.flatnonzero(np.r_[split, False][slot])
                mine, at = slot[rows], b.start + rows
                node[at] = 2 * node[at] + 1 + (place[chosen[mine], at] > last[mine])
        for b in blocks:
            margin[b] += leaf[t, node[b]]
    return base, feature, threshold, leaf


class Spool:
    """Shots of one model in a file without a name, which goes when the task drops it."""

    def __init__(self, key: list):
        self.key, self.file, self.goals = key, tempfile.TemporaryFile(), []

    def add(self, frame: pd.DataFrame) -> None:
        self.file.write(np.ascontiguousarray(frame[FEATURES].to_numpy(float)).data)
        self.goals.append(frame["goal"].to_numpy(float))

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        self.file.flush()
        y = np.concatenate(self.goals)
        return np.asarray(np.memmap(self.file, float, "r", shape=(len(y), len(FEATURES)))), y


def probability(x: np.ndarray, model) -> np.ndarray:
    """The mean of both models' probabilities for the rows of ``x``."""
    line = model.intercept + x @ np.asarray(model.weights, float)
    feature, threshold, leaf = (np.asarray(a).reshape(-1, _NODES) for a in (model.feature, model.threshold, model.leaf))
    margin, tree = np.full(len(x), model.base), np.arange(len(feature))[:, None] * _NODES
    feature, threshold, leaf = feature.ravel(), threshold.ravel(), leaf.ravel()
    for start in range(0, len(x), _ROWS):  # all trees at once over a bounded block of rows
        own = np.ascontiguousarray(x[start:start + _ROWS])
        place = np.arange(len(own)) * x.shape[1]
        node = np.zeros((len(tree), len(own)), np.int64)
        for _ in range(DEPTH):
            f = feature[tree + node]
            right = own.ravel()[place + np.maximum(f, 0)] > threshold[tree + node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        for values in leaf[tree + node]:
            margin[start:start + _ROWS] += values
    return (1 / (1 + np.exp(-line)) + 1 / (1 + np.exp(-margin))) / 2


def fit_models(shots: DataFrame, status: DataFrame, rounds: int = ROUNDS, large: int = 50_000, bins: int = BINS) -> DataFrame:
    """One row of parameters per league season and trained model, fitted over all its shots.

    A model of more than ``large`` shots is fitted by itself and by blocks, and its task keeps them in a file.
    """

    by = [*LEAGUE, "model"]

    def parameters(fits: list) -> pd.DataFrame:
        rows = [(*key, *logistic(x, y), base, *(a.ravel() for a in nodes)) for (key, x, y), (base, *nodes) in fits]
        return pd.DataFrame(rows, columns=[*by, "intercept", "weights", "base", "feature", "threshold", "leaf"])

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        own = [(key, part[FEATURES].to_numpy(float), part["goal"].to_numpy(float)) for key, part in frame.groupby(by, sort=False)]
        many, few = [s for s in own if len(s[2]) > large], [s for s in own if len(s[2]) <= large]
        trees = boosted_together([(x, y) for _, x, y in few], rounds, bins) if few else []
        return parameters([*zip(few, trees), *((s, boosted_by_blocks(*s[1:], rounds, bins)) for s in many)])

    def spooled(spool: Spool) -> pd.DataFrame:
        x, y = spool.sample()
        return parameters([((spool.key, x, y), boosted_by_blocks(x, y, rounds, bins))])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of a model follow each other; models are fitted together until they have ``_TOGETHER`` rows."""
        held, spool = [], None
        for frame in frames:
            if spool:
                more = (frame[by] == spool.key).all(axis=1)
                spool.add(frame[more])
                if more.all():
                    continue
                yield spooled(spool)
                frame, spool = frame[~more], None
            held.append(frame)
            if sum(map(len, held)) >= _TOGETHER:
                frame = pd.concat(held, ignore_index=True)
                open_ = (frame[by] == frame[by].iloc[-1]).all(axis=1)
                held = [frame[open_]]
                if not open_.all():
                    yield fitted(frame[~open_])
                if open_.sum() > large:
                    spool = Spool(frame[by].iloc[-1].tolist())
                    spool.add(held.pop())
        if spool:
            yield spooled(spool)
        if sum(map(len, held)):
            yield fitted(pd.concat(held, ignore_index=True))

    each = shots.where("shot_family <> 'penalty'").withColumn("model", F.explode(F.array(F.lit(GLOBAL), "shot_family")))
    trained = status.where("status = 'trained'")
    each = each.join(trained.select(*by), by)
    kinds = ", ".join(f"{c} {shots.schema[c].dataType.simpleString()}" for c in LEAGUE)
    # The rows are few and the work on them is long, so tasks go by the number of models, with more for large ones, not by bytes.
    tasks = trained.agg(F.ceil(F.sum(1 / _FITS + F.floor(F.col("shots") / large)))).first()[0] or 1
    each = each.select(*by, "match_id", "event_index", "goal", *FEATURES).repartition(tasks, *by).sortWithinPartitions(*by, "match_id", "event_index")
    return cut_lineage(each.mapInPandas(fit, f"{kinds}, {_MODEL}"), "shot-models")


def _blend(p: str, rate: str, size: str):
    """A model's probability drawn towards the rate of its sample by its size; the rate alone where nothing was fitted."""
    w = F.least(F.greatest(F.col(size) / FULL_SAMPLE, F.lit(LEAST_WEIGHT)), F.lit(1.0))
    drawn = F.least(F.greatest(w * F.col(p) + (1 - w) * F.col(rate), F.lit(CLIP)), F.lit(1 - CLIP))
    return F.when(F.col(p).isNull(), F.col(rate)).otherwise(drawn)


def score_shots(shots: DataFrame, status: DataFrame, models: DataFrame, chunk: int = 50_000) -> DataFrame:
    """LEAGUE, SHOT, global_p, family_p and xg of every shot."""
    kinds = ", ".join(f"{c} {shots.schema[c].dataType.simpleString()}" for c in [*LEAGUE, *SHOT])

    def score(own: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        x, out = own[FEATURES].to_numpy(float), own[[*LEAGUE, *SHOT]].assign(global_fit=np.nan, family_fit=np.nan)
        for model in fitted.itertuples():
            at = np.flatnonzero((own["shot_family"] != "penalty") if model.model == GLOBAL else own["shot_family"] == model.model)
            if len(at):
                out.iloc[at, out.columns.get_loc("global_fit" if model.model == GLOBAL else "family_fit")] = probability(x[at], model)
        return out

    chunks = status.groupBy(*LEAGUE).agg(F.ceil(F.sum("shots") / chunk).alias("_chunks"))
    dealt = shots.join(chunks, LEAGUE).withColumn("_chunk", F.pmod(F.xxhash64("match_id", "event_index"), F.col("_chunks"))).drop("_chunks")
    copies = models.join(chunks, LEAGUE).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")
    by = [*LEAGUE, "_chunk"]
    fitted = dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(score, f"{kinds}, global_fit double, family_fit double")
    rates = lambda kind: status.select(*LEAGUE, F.col("model").alias(f"{kind}_model"), F.col("goal_rate").alias(f"{kind}_rate"), F.col("shots").alias(f"{kind}_size"))
    fitted = fitted.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("global_fit", "family_fit")}).withColumn("family_model", F.col("shot_family"))
    fitted = fitted.join(rates("global").where(F.col("global_model") == GLOBAL), LEAGUE, "left").join(rates("family"), [*LEAGUE, "family_model"], "left")
    penalty = F.col("shot_family") == "penalty"
    out = fitted.withColumns({
        "global_p": F.when(~penalty, _blend("global_fit", "global_rate", "global_size")),
        "family_p": F.when(penalty, F.col("family_rate")).otherwise(_blend("family_fit", "family_rate", "family_size")),
    })
    xg = F.when(penalty, F.col("family_p")).otherwise(0.5 * F.col("global_p") + 0.5 * F.col("family_p"))
    return out.select(*LEAGUE, *SHOT, "global_p", "family_p", F.least(F.greatest(xg, F.lit(CLIP)), F.lit(1 - CLIP)).alias("xg"))


def trained_scores(features: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all shots by the models of their own league season; stored, as facts read it several times."""
    shots = shot_table(features)
    status = cut_lineage(model_status(shots), "shot-status")
    return cut_lineage(score_shots(shots, status, fit_models(shots, status, rounds)), "shot-scores")


def model_rows(features: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per league season, model and feature; one without feature where nothing is fitted."""
    shots = shot_table(features)
    status = cut_lineage(model_status(shots), "shot-status")
    names = F.array(*[F.lit(f) for f in FEATURES])
    fitted = fit_models(shots, status, rounds).select(*LEAGUE, "model", F.explode(F.arrays_zip(names.alias("feature"), F.col("weights").alias("weight"))).alias("w"))
    fitted = fitted.select(*LEAGUE, "model", "w.feature", "w.weight", F.lit(rounds).alias("trees"))
    return status.join(fitted, [*LEAGUE, "model"], "left").select(
        *LEAGUE, "model", "status", "shots", "goals", "goal_rate", "feature", "weight", F.coalesce("trees", F.lit(0)).alias("trees"))


def model_quality(log: DataFrame, shots: DataFrame, credits: DataFrame, moves: DataFrame) -> DataFrame:
    """Per league season and model (xG, xA, xT) its status with the sample behind it.

    ``log``: all events; ``shots``: family and goal of each shot; ``credits``: assists of shots; ``moves``: valued actions.
    A league without event rows has no status here and counts as unavailable in ``with_fixtures``.
    """
    own = shots.groupBy(*LEAGUE).agg(
        F.count("*").alias("shots_used"), F.sum("goal").alias("goals_seen"),
        F.when(F.count_if(F.col("shot_family") == "penalty") >= MIN_PENALTIES, F.avg(F.when(F.col("shot_family") == "penalty", F.col("goal")))).otherwise(PENALTY_RATE).alias("penalty_rate"))
    linked = credits.groupBy(*LEAGUE).agg(F.count_distinct("match_id", "shot_index").alias("linked_actions"))
    valued = moves.groupBy(*LEAGUE).agg(F.count("*").alias("valued_actions"))
    all_ = log.groupBy(*LEAGUE).agg(F.count("*").alias("events"))
    for part in (own, linked, valued):
        all_ = all_.join(part, LEAGUE, "left")
    all_ = all_.na.fill(0, ["shots_used", "goals_seen", "linked_actions", "valued_actions"])
    status = lambda name, some, sample, yes: F.struct(F.lit(name).alias("model"), F.when(F.col(some) > 0, yes).otherwise("limited").alias("status"), F.col(sample).alias("sample"))
    rows = F.array(status("xG", "shots_used", "shots_used", "trained"), status("xA", "linked_actions", "linked_actions", "applied"),
                   F.struct(F.lit("xT").alias("model"), F.lit("trained").alias("status"), F.col("valued_actions").alias("sample")))
    return all_.select(*LEAGUE, "goals_seen", F.coalesce("penalty_rate", F.lit(PENALTY_RATE)).alias("penalty_rate"), F.explode(rows).alias("r")).select(
        *LEAGUE, "r.model", "r.status", "r.sample", F.when(F.col("r.model") == "xG", F.col("goals_seen")).alias("goals_seen"), F.when(F.col("r.model") == "xG", F.col("penalty_rate")).alias("penalty_rate"))


def with_fixtures(quality: DataFrame, schedule: DataFrame) -> DataFrame:
    """``quality`` with rows of status ``unavailable`` for league seasons that have fixtures and no saved events."""
    missing = schedule.select(*LEAGUE).distinct().join(quality.select(*LEAGUE).distinct(), LEAGUE, "left_anti")
    kinds = F.explode(F.array(*[F.lit(m) for m in ("xG", "xA", "xT")])).alias("model")
    return quality.unionByName(missing.select(*LEAGUE, kinds, F.lit("unavailable").alias("status"), F.lit(0).cast("long").alias("sample")), allowMissingColumns=True)


def with_scores(df: DataFrame, scores: DataFrame, index: str = "event_index") -> DataFrame:
    """``df`` with the trained value of its shots as ``xg``; rows without a score keep theirs."""
    own = scores.select("match_id", F.col("event_index").alias(index), F.col("xg").alias("_trained"))
    return df.join(own, ["match_id", index], "left").withColumn("xg", F.coalesce("_trained", "xg")).drop("_trained")
