"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` hash tables cuts ``m`` random projections into steps of ``width``. A query visits, in
every table, its own bucket and then the perturbed buckets in the order of their estimated success: the sum
of squared distances from the query's projections to the boundaries that are crossed. All candidates of all
tables are measured exactly, in double precision on the original vectors, and the nearest are merged.

``m``, ``width`` and the number of probes are fitted on a bounded sample (``SAMPLE`` vectors and
``TRIALS`` queries, whose true neighbours a scan finds): the combination that reads the fewest candidates
among those whose recall on the trial queries reaches ``target``. Every vector is indexed. Queries that meet
too few candidates are answered exactly: they are set against all vectors in blocks.

Scale: equal vectors are one index entry with its ``k + 1`` smallest ids (enough, as equal vectors are
equally far). Buckets are dealt into groups of about ``GROUP`` entries; a larger bucket is split over several
groups, each of which meets the queries that visit it. Only ``k + 1`` results leave a group per query.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do
vectors of another length than the most common one (ties: the shorter); a null vec_id takes no part;
repeated rows count once, and of different vectors under one vec_id the smallest; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import cut_lineage

TABLES = 8
SAMPLE = 2048
TRIALS = 48
MOST_PROBES = 512
GROUP = 4000
SHAPES = [(m, steps) for m in (6, 8, 10, 12) for steps in (1.5, 2.0, 3.0)]


@dataclass(frozen=True)
class Index:
    """Projections (tables, dim, m) in units of the step, shifts, and the number of probes."""

    project: np.ndarray
    shift: np.ndarray
    probes: int

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections of rows in units of the step: (rows, tables, m)."""
        return np.einsum("rd,tdm->rtm", x, self.project) + self.shift

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """64-bit name of each bucket, given its integer cells along the last axis."""
        h = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
        for i in range(cells.shape[-1]):
            h = (h ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def perturbations(part: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps (-1, 0, 1 per projection) of the ``most`` buckets of least score, in order, with their scores.

    ``part``: the fraction of a step by which each projection lies above its lower boundary.
    """
    m = len(part)
    cost = np.r_[part, 1 - part] ** 2
    order = np.argsort(cost, kind="stable")
    cost = cost[order].tolist()
    column, sign = (order % m).tolist(), np.where(order < m, -1, 1).tolist()
    steps, scores = [np.zeros(m, np.int64)], [0.0]
    heap = [(cost[0], (0,))]
    while heap and len(steps) < most:
        score, chosen = heapq.heappop(heap)
        if len({column[i] for i in chosen}) == len(chosen):
            step = np.zeros(m, np.int64)
            for i in chosen:
                step[column[i]] = sign[i]
            steps.append(step)
            scores.append(score)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*chosen, last + 1)))
    return np.array(steps), np.array(scores)


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id and ``vec`` (array of doubles) of the rows that take part, one per vec_id."""
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null").where(fine)
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return rows
    rows = rows.where(F.size("vec") == common[0]["d"])
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: node (an id kept by storing it), vec, its k + 1 smallest ids."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    own = few.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return cut_lineage(own.withColumn("node", F.monotonically_increasing_id()), "vectors")


def _nearest(x: np.ndarray, q: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``most`` nearest rows, ties to the smaller first id."""
    distance = np.sqrt(((x - q) ** 2).sum(axis=1))
    if len(distance) > 4 * most:
        limit = np.partition(distance, most - 1)[most - 1]
        near = np.flatnonzero(distance <= limit)
    else:
        near = np.arange(len(distance))
    near = near[np.lexsort((first[near], distance[near]))][:most]
    return near, distance[near]


def fit(base: DataFrame, queries: DataFrame, k: int, target: float, seed: int = 11) -> Index | None:
    """The index whose shape and probes read the least among those that reach the target on the trial queries."""
    def some(frame, n):
        return frame.select("node", "vec").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n).collect()

    trial = some(queries, TRIALS)
    sample = np.array([r["vec"] for r in some(base, SAMPLE)])
    if not trial or not len(sample):
        return None
    own = np.array([r["vec"] for r in trial])
    names = np.array([r["node"] for r in trial])

    def scan(frames):
        kept: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, own.shape[1])))] * len(own)
        for frame in frames:
            x, node = np.array(frame["vec"].tolist()), frame["node"].to_numpy()
            for i in range(len(own)):
                other = np.flatnonzero(node != names[i])
                near, distance = _nearest(x[other], own[i], node[other], k)
                d, n, v = np.r_[kept[i][0], distance], np.r_[kept[i][1], node[other[near]]], np.concatenate([kept[i][2], x[other[near]]])
                best = np.argsort(d, kind="stable")[:k]
                kept[i] = (d[best], n[best], v[best])
        for i, (d, n, v) in enumerate(kept):
            if len(d):
                yield pd.DataFrame({"trial": i, "distance": d, "vec": list(v)})

    near = base.select("node", "vec").mapInPandas(scan, "trial int, distance double, vec array<double>")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("trial").orderBy("distance"))).where(F.col("place") <= k).collect()  # TRIALS * k rows
    if not near:
        return None
    of = np.array([r["trial"] for r in near])
    truth, radius = np.array([r["vec"] for r in near]), float(np.median([r["distance"] for r in near]))
    best = None
    for m, steps in SHAPES:
        rng = np.random.default_rng(seed)
        width = steps * max(radius, 1e-9)
        index = Index(rng.normal(size=(TABLES, own.shape[1], m)) / width, rng.uniform(size=(TABLES, m)), MOST_PROBES)
        at, hits, reads = index.places(own), [], []
        cells = np.floor(at)
        step_true = np.floor(index.places(truth)) - cells[of]
        place_sample = np.floor(index.places(sample))
        rank_true, rank_sample = np.full(len(of), 1 << 30), np.full((len(own), len(sample)), 1 << 30)
        for i in range(len(own)):
            mine, step_sample = np.flatnonzero(of == i), place_sample - cells[i]
            for t in range(TABLES):
                low = at[i, t] - cells[i, t]
                scores = perturbations(low, MOST_PROBES)[1]
                for step, rank, rows in ((step_true[mine, t], rank_true, mine), (step_sample[:, t], rank_sample[i], slice(None))):
                    score = np.where(step < 0, low, np.where(step > 0, 1 - low, 0)) ** 2
                    place = np.where(np.abs(step).max(axis=1) > 1, 1 << 30, np.searchsorted(scores, score.sum(axis=1) - 1e-12))
                    place = np.where(place >= len(scores), 1 << 30, place)
                    rank[rows] = np.minimum(rank[rows], place)
        for probes in (8, 16, 32, 64, 128, 256, MOST_PROBES):
            recall, read = (rank_true < probes).mean(), (rank_sample < probes).mean()
            choice = (recall < target, read if recall >= target else -recall)
            if best is None or choice < best[0]:
                best = (choice, Index(index.project, index.shift, probes))
    return best[1]


def _search(k: int, dim: int):
    """Cogrouped function: exact distances of the queries to the entries of the buckets they visit."""
    def run(entries, probes):
        out = {"query": [], "node": [], "first": [], "distance": []}
        if len(entries) and len(probes):
            entries = entries.sort_values("bucket", kind="stable")
            bucket, node, first = (entries[c].to_numpy() for c in ("bucket", "node", "first"))
            x = np.frombuffer(b"".join(entries["packed"]), np.float64).reshape(-1, dim)
            for query, packed, visited in zip(probes["query"], probes["at"], probes["buckets"]):
                visited = np.asarray(visited)
                lo, hi = np.searchsorted(bucket, visited), np.searchsorted(bucket, visited, side="right")
                n = hi - lo
                if not n.sum():
                    continue
                rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                near, distance = _nearest(x[rows], np.frombuffer(packed, np.float64), first[rows], k)
                out["query"].append(np.full(len(near), query))
                out["node"].append(node[rows[near]])
                out["first"].append(first[rows[near]])
                out["distance"].append(distance)
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}).astype({"query": "int64", "node": "int64", "first": "int64", "distance": "float64"})

    return run


def _grouped(entries: DataFrame, probes: DataFrame, k: int, dim: int) -> DataFrame:
    keys = ["tab", "part", "salt"]
    found = entries.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(_search(k, dim), "query long, node long, first long, distance double")
    best = found.groupBy("query", "node", "first").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "first"))
    return best.withColumn("place", place).where(F.col("place") <= k).drop("place")


def search(table: DataFrame, is_query, k: int = 10, target: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row that ``is_query`` (a condition on vec_id) picks."""
    spark = table.sparkSession
    rows = valid_vectors(table)
    base = distinct_vectors(rows, k)
    asked = cut_lineage(rows.where(is_query).join(base.select("node", "vec"), "vec").select("vec_id", "node"), "queries")
    queries = base.join(asked.select("node").distinct(), "node", "left_semi")
    index = fit(base, queries, k, target)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)  # some hundred kilobytes, by its shape
    dim, most = index.project.shape[1], k + 1
    total = base.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).first()
    parts = -(-total["n"] // GROUP)

    def hashed(frames):
        for frame in frames:
            x = np.array(frame["vec"].tolist()).reshape(-1, dim)
            keys = shared.value.keys(np.floor(shared.value.places(x)))
            yield pd.DataFrame({"node": frame["node"], "first": [i[0] for i in frame["ids"]], "packed": [r.tobytes() for r in x], "buckets": list(keys)})

    def visits(frames):
        for frame in frames:
            x = np.array(frame["vec"].tolist()).reshape(-1, dim)
            at = shared.value.places(x)
            cells = np.floor(at).astype(np.int64)
            for i, node in enumerate(frame["node"]):
                for t in range(TABLES):
                    steps = perturbations(at[i, t] - cells[i, t], shared.value.probes)[0]
                    yield pd.DataFrame({"query": node, "tab": t, "bucket": shared.value.keys(cells[i, t] + steps)})

    vectors = cut_lineage(base.select("node", "ids", "vec").mapInPandas(hashed, "node long, first long, packed binary, buckets array<long>"), "hashed")
    entries = vectors.select("node", "first", "packed", F.posexplode("buckets").alias("tab", "bucket"))
    visited = queries.select("node", "vec").mapInPandas(visits, "query long, tab int, bucket long")
    full = cut_lineage(entries.groupBy("tab", "bucket").count().where(F.col("count") > GROUP).select("tab", "bucket", F.ceil(F.col("count") / GROUP).alias("pieces")), "full")
    # A bucket beyond the size of a group is a group of its own in several pieces.
    part = F.when(F.col("pieces").isNull(), F.pmod("bucket", F.lit(parts))).otherwise(F.col("bucket"))
    entries = entries.join(full, ["tab", "bucket"], "left").withColumn("part", part)
    entries = entries.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.col("pieces")), F.lit(-1)))
    salts = F.when(F.col("pieces").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    visited = visited.join(full, ["tab", "bucket"], "left").withColumn("part", part).withColumn("salt", F.explode(salts))
    probes = visited.groupBy("query", "tab", "part", "salt").agg(F.collect_list("bucket").alias("buckets"))
    probes = probes.join(vectors.select(F.col("node").alias("query"), F.col("packed").alias("at")), "query")
    found = cut_lineage(_grouped(entries.select("tab", "part", "salt", "bucket", "node", "first", "packed"), probes, most, dim), "found")

    # Exact rest: queries that met too few vectors, against all of them in blocks.
    ids = found.join(base.select("node", F.size("ids").alias("held")), "node").groupBy("query").agg(F.sum("held").alias("held"))
    enough = ids.where(F.col("held") >= min(most, total["ids"])).select(F.col("query").alias("node"))
    rest = vectors.join(queries.select("node"), "node", "left_semi").join(enough, "node", "left_anti").select(F.col("node").alias("query"), F.col("packed").alias("at"))
    blocks = vectors.select(F.lit(-1).alias("tab"), F.lit(0).cast("long").alias("part"), F.pmod(F.xxhash64("node"), F.lit(parts)).alias("salt"), F.lit(0).cast("long").alias("bucket"), "node", "first", "packed")
    whole = rest.select(F.lit(-1).alias("tab"), F.lit(0).cast("long").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("salt"), "query", "at", F.array(F.lit(0).cast("long")).alias("buckets"))
    exact = found.join(enough.withColumnRenamed("node", "query"), "query", "left_semi")
    if not rest.isEmpty():
        exact = exact.unionByName(_grouped(blocks, whole, most, dim))

    near = exact.join(base.select("node", "ids"), "node").select("query", "distance", F.explode("ids").alias("vec_id"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))).where(F.col("place") <= most)
    own = near.join(asked.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id")), "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return own.select("query_id", rank.alias("rank"), "vec_id", F.col("distance").alias("score")).where(F.col("rank") <= k)
