"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a document are the distinct hashed words, word pairs and pairs with one word left out
(words: runs of letters and digits, lower case). Training passes over a bounded sample of labelled
documents in the order of a hash of their id; each coordinate has its own learning rate, and the L1
part keeps the weight of a feature at exactly zero until its summed gradient exceeds ``l1``. Only
non-zero weights leave the training task; their number is bounded by the ``2**bits`` coordinates, so
that they can be broadcast whatever the size of the corpus. Scoring is a projection without shuffle.

Learning rate and regularisation are chosen among ``GRID`` by the log loss on a part of the training rows that the
tries do not learn from; rows that are held out take no part in it.

Bounds of the samples: ``max_rows`` labelled documents (all, if fewer) for training and ``TRY_ROWS`` for the choice of
settings, taken by a hash of the id.

Defined results: null or empty text has no features and gets the score of the bias; with no labelled
rows every score is 0.5; label rows that are null are ignored, repeated ones count once (the larger
value); repeated documents are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import chunks, label_rows, text_of

WORD = re.compile(r"\w+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
BIAS = -1


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 3
    max_rows: int = 16_384


#: Settings tried (alpha, l1, l2), rows that each try learns from and is judged on, and the share of those that judge.
GRID = tuple((alpha, l1, l2) for alpha in (0.5, 1.0, 2.0, 4.0) for l1 in (1.0, 4.0) for l2 in (0.1,))
TRY_ROWS, JUDGES = 4_096, 4


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen so far (bounded)."""

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def features(texts, hashes: WordHashes, bits: int):
    """Hashed features of all texts in one array, and the row of each (repeats within a text remain)."""
    words = [WORD.findall(t.lower()) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(words)), lengths)
    found, rows = [h * _ODD[0]], [owner]
    for distance, odd in ((1, _ODD[1]), (2, _ODD[2])):
        if len(h) > distance:
            inside = owner[:-distance] == owner[distance:]
            mixed = (h[:-distance] * odd) ^ (h[distance:] + odd)
            found.append((mixed * _ODD[0])[inside])
            rows.append(owner[:-distance][inside])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal state: z and n per coordinate; the last coordinate is the bias, which has no L1."""

    def __init__(self, s: Settings):
        self.s = s
        self.z = np.zeros((1 << s.bits) + 1)
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at):
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.s.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.s.beta + np.sqrt(n)) / self.s.alpha + self.s.l2))

    def learn(self, at, y):
        at = np.r_[at, len(self.z) - 1]
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def _learn(frame: pd.DataFrame, model: Ftrl, hashes: WordHashes) -> None:
    """One pass over the rows (text, y) of a frame, in their order."""
    for a, b in chunks(frame):
        part = frame.iloc[a:b]
        at, owner = features(part["text"], hashes, model.s.bits)
        order = np.argsort(owner, kind="stable")
        at, cuts = at[order], np.searchsorted(owner[order], np.arange(1, len(part)))
        for own, y in zip(np.split(at, cuts), part["y"]):
            model.learn(np.unique(own), y)


def _margins(texts: pd.Series, dense: np.ndarray, bias: float, hashes: WordHashes, bits: int) -> np.ndarray:
    """The weighted sum of each text's distinct features."""
    frame, out = pd.DataFrame({"text": texts}), np.zeros(len(texts))
    for a, b in chunks(frame):
        found, owner = features(texts.iloc[a:b], hashes, bits)
        hit = np.flatnonzero(dense[found])
        both = np.unique(owner[hit] << bits | found[hit])
        out[a:b] = np.bincount(both >> bits, weights=dense[both & ((1 << bits) - 1)], minlength=b - a)
    return out + bias


def _sampled(labels: DataFrame, rows: int, most: int, seed: int) -> DataFrame:
    spread = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    return labels.where(spread < int(min(1.0, most / rows) * (1 << 40)))


def choose(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), grid=GRID) -> Settings:
    """The settings of ``grid`` with the least log loss on a part of ``labels`` (doc_id, y) that they did not learn from.

    Every try is a task of its own over the same ``TRY_ROWS`` rows at most, one in ``JUDGES`` of which judges.
    """
    rows = labels.count()
    if rows == 0:
        return s
    sample = text_of(docs).join(_sampled(labels, rows, TRY_ROWS, 43), "doc_id")
    tries = sample.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["number"].iloc[0])
        turn = pd.util.hash_array(frame["doc_id"].to_numpy(np.int64))
        frame = frame.assign(turn=turn).sort_values(["turn", "doc_id", "text"])
        judges = (frame["turn"] % np.uint64(JUDGES) == 0).to_numpy()
        model, hashes = Ftrl(replace(s, alpha=grid[number][0], l1=grid[number][1], l2=grid[number][2])), WordHashes()
        for epoch in range(s.epochs):
            _learn(frame[~judges], model, hashes)
        w = model.weights(np.arange(len(model.z)))
        held = frame[judges]
        m = np.clip(_margins(held["text"], w[:-1], w[-1], hashes, s.bits), -35, 35)
        loss = float(np.logaddexp(0, np.where(held["y"] == 1, -m, m)).sum())
        return pd.DataFrame({"number": [number], "loss": [loss]})

    found = tries.groupBy("number").applyInPandas(judge, "number int, loss double").collect()  # one row for each try
    alpha, l1, l2 = grid[min(found, key=lambda r: (round(r["loss"], 6), r["number"]))["number"]] if found else (s.alpha, s.l1, s.l2)
    return replace(s, alpha=alpha, l1=l1, l2=l2)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> dict[int, float]:
    """Non-zero weights by coordinate (``BIAS`` for the bias). ``labels``: doc_id, y."""
    rows = labels.count()
    if rows == 0:
        return {}
    sample = text_of(docs).join(_sampled(labels, rows, s.max_rows, 41), "doc_id").withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(s.epochs))))
    # One task, because each step depends on the one before; its input is bounded by max_rows.
    ordered = sample.repartition(1).sortWithinPartitions("turn", F.xxhash64("doc_id", "turn"), "doc_id", "text")

    def learn(frames):
        model, hashes = Ftrl(s), WordHashes()
        for frame in frames:
            _learn(frame, model, hashes)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": np.where(at == len(w) - 1, BIAS, at), "weight": w[at]})

    return {r["at"]: r["weight"] for r in ordered.select("text", "y").mapInPandas(learn, "at long, weight double").collect()}


def score(docs: DataFrame, weights: dict[int, float], bits: int = Settings.bits, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score of every row; ``keep`` names columns of ``docs`` that go along unchanged."""
    at = np.array(sorted(k for k in weights if k >= 0), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((at, np.array([weights[k] for k in at.tolist()]), weights.get(BIAS, 0.0)))

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        at, value, bias = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = value
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(_margins(text, dense, bias, WordHashes(), bits), -35, 35))))

    scored = probability(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id"), *keep, scored.alias("score"))


def trained(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, s: Settings = Settings()) -> dict[int, float]:
    """Weights learnt from ``labels.toxic`` of the rows that are not held out, with settings chosen among those same rows."""
    rows = label_rows(labels, "toxic")
    rows = rows if held_out is None else rows.where(~held_out)
    return train(docs, rows, choose(docs, rows, s))
