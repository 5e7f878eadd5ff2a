"""Quality scores from a regularised quadratic discriminant over document statistics.

Every document gives ``len(NAMES)`` transformed statistics. One distributed pass over all labelled rows
sums counts, statistics and their products by class; the covariance of a class is shrunk towards the
pooled one (``pool``) and towards a multiple of the identity (``ridge``) after scaling each statistic
by its pooled deviation. The score is the logistic of the log density difference, whose Mahalanobis
distances use the Cholesky factor of each class, computed once when the model is fitted.

The statistics are stored once below the shared folder and read for training and for scoring, so that
the texts are read once. The model's size is fixed (two classes, some 16 statistics).

Defined results: null or empty text has all-zero statistics and is scored; without labelled rows every
score is 0.5; with fewer than two rows of a class, or labelled rows that are all alike, it is the smoothed share
of class 1; null labels are ignored, repeated
label rows count once (the larger value); repeated documents are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import label_rows, text_of
from touchline.session import cut_lineage

NAMES = (
    "words", "word_length", "word_spread", "distinct", "adjacent", "lines", "line_words", "line_repeats", "packed", "symbols", "bars",
    "shouts", "capitals", "digits", "stops", "beyond_ascii",
)


def _bytes(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), list(chars.encode()))


CLASSES = {
    "symbols": _bytes("#*$%&<>@=~^_{}[]\\"), "bars": _bytes("|"), "shouts": _bytes("!?"), "capitals": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "digits": _bytes("0123456789"), "stops": _bytes(".,;:"), "beyond_ascii": np.arange(256) >= 128,
}
#: Variance of a statistic below which labelled rows count as alike, and the least mean variance (scaled) that ``ridge`` shares in.
LEAST_VARIANCE, LEAST_SPREAD = 1e-12, 0.01
_MASKS = np.array(list(CLASSES.values()), np.float64)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text: logarithms of counts and of shares in thousandths."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, count=n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = _MASKS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    adjacent = sum(a == b for a, b in zip(words, words[1:])) / n
    measures = [
        np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log(len(set(words)) / n), np.log1p(1000 * adjacent), np.log1p(len(lines)),
        np.log1p(n / len(lines)), np.log1p(1000 * (1 - len(set(lines)) / len(lines))), np.log(len(zlib.compress(raw, 1)) / (len(raw) + 12)),
    ]
    return [float(x) for x in measures] + np.log1p(1000 * shares).tolist()


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``stats`` of every row, stored for the passes that follow."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "stats": [statistics(t) for t in frame["text"]]})

    return cut_lineage(text_of(docs).mapInPandas(run, "doc_id long, stats array<double>"), "stats")


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor, log density constant; or just a constant score."""

    constant: float | None
    scale: np.ndarray | None = None
    parts: tuple = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [offset - 0.5 * (((x / self.scale - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, offset in self.parts]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -35, 35)))


def fit(stats: DataFrame, labels: DataFrame, pool: float = 0.3, ridge: float = 0.01) -> Model:
    """The model from all labelled rows. ``labels``: doc_id, y.

    Products are summed around the mean of all labelled rows, so that small variances keep their digits.
    """
    p = len(NAMES)
    labelled = stats.join(labels, "doc_id").select("stats", "y")
    middle = labelled.select(*[F.avg(F.get("stats", F.lit(i))).alias(n) for i, n in enumerate(NAMES)]).first()
    pilot = np.array([x or 0.0 for x in middle])

    def sums(frames):
        total = np.zeros((2, 1 + p + p * p))
        for frame in frames:
            x = np.array(frame["stats"].tolist()).reshape(-1, p) - pilot
            for y in (0, 1):
                own = x[(frame["y"] == y).to_numpy()]
                total[y] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        yield pd.DataFrame({"y": np.repeat([0, 1], total.shape[1]), "cell": np.tile(np.arange(total.shape[1]), 2), "value": total.ravel()})

    cells = labelled.mapInPandas(sums, "y int, cell int, value double")
    total = np.zeros((2, 1 + p + p * p))
    for row in cells.groupBy("y", "cell").agg(F.sum("value").alias("value")).collect():  # 2 * (1 + p + p * p) rows
        total[row["y"], row["cell"]] = row["value"]
    n = total[:, 0]
    if n.min() < 2:
        return Model(float((n[1] + 1) / (n.sum() + 2)))
    means = total[:, 1 : 1 + p] / n[:, None]
    covariances = [total[y, 1 + p :].reshape(p, p) / n[y] - np.outer(means[y], means[y]) for y in (0, 1)]
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    if np.trace(pooled) <= p * LEAST_VARIANCE:  # the rows do not vary: only the shares of the classes tell
        return Model(float((n[1] + 1) / (n.sum() + 2)))
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    pooled = pooled / np.outer(scale, scale)
    parts = []
    for y in (0, 1):
        own = (1 - pool) * covariances[y] / np.outer(scale, scale) + pool * pooled
        own = (1 - ridge) * own + ridge * max(np.trace(own) / p, LEAST_SPREAD) * np.eye(p)
        lower = np.linalg.cholesky(own)
        parts.append(((means[y] + pilot) / scale, np.linalg.inv(lower), float(np.log(n[y] / n.sum()) - np.log(np.diag(lower)).sum())))
    return Model(None, scale, tuple(parts))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every stored row; a projection."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array(x.tolist()).reshape(-1, len(NAMES))))

    return stats.select("doc_id", probability("stats").alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id and score, learnt from ``labels.quality`` of the rows that are not held out."""
    stats, rows = document_statistics(docs), label_rows(labels, "quality")
    return score(stats, fit(stats, rows if held_out is None else rows.where(~held_out)))
