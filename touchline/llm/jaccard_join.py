"""N-gram Jaccard join: a size-aware heavy-light self join of shingle sets, and its components.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their distinct word shingles.

*Light* sets enumerate fixed-size subsets: linked sets share ``c = ceil(percent * m / 100)`` elements, m
being the larger size, so each set writes down all its subsets of the few sizes c that a partner can
ask for, and linked sets meet in one of them. *Heavy* sets scan inverted lists: ordered by rising corpus
frequency, linked sets share one of their first ``n - ceil(percent * n / 100) + 1`` shingles, so only these
are posted and looked up. The size where the two meet is chosen by cost (``boundary``): subsets written
against postings plus the candidates to be verified at the measured mean list length. Sets just below it
are posted too, for their heavier partners.

Candidates pass a size and a position bound, then a bound from histograms of their hashes, and are at last
verified on the whole sets. Equal sets are one node throughout. A group of sets that share a signature
is never expanded into all pairs while its members may still fall together: first every member meets a
few neighbours of another component in its group, twice, in different orders; then, for the exact rest,
members outside the largest component of a small group meet all others, and larger groups are compared
block by block inside tasks that return links only. Components are contracted in between.

Scale: all corpus frequencies are counted (map-side combined, then by hash bucket); at most ``LISTED``
of the most frequent shingles are broadcast, which only decides an order and so never a result. Texts are
shuffled for documents with surviving candidates only: a bit table of fixed size (``2**23`` bits) is
broadcast to leave out most others, and a join decides. Links and components stay distributed.

Defined results: null or empty text has an empty set, links with nothing and is its own component; fewer
words than the shingle length make one shingle; repeated rows are copies of one set; a null doc_id takes
part, but is the smallest id of a component only if that holds no other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import chunks, text_of
from touchline.session import cut_lineage

#: Most frequent shingles that are ordered last by their frequency; 12 bytes each.
LISTED = 1 << 19
#: Frequency from which a shingle may be listed.
FREQUENT = 8
#: Cells of the histogram that bounds an intersection.
CELLS = 128
#: Neighbours that a member meets in a group in each of the first rounds.
NEIGHBOURS = 4
ROUNDS = 2
#: Members of a group up to which its pairs are written out; larger groups are compared block by block.
SMALL = 64
#: Sets and shingles of a block.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
#: Members of a group that are ordered together.
GROUP = 4096
_BITS = 1 << 23

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _A
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen so far (bounded)."""

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts, length: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (words cut at ASCII white space, A-Z lowered)."""
    words = [t.encode().lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, count=int(counts.sum()))
    rolled = np.full(max(0, len(h) - length + 1), _C)
    for i in range(length):
        rolled = _mixed(rolled + h[i : i + len(rolled)] * _A)
    out, start = [], 0
    for n in counts.tolist():
        if n >= length:
            out.append(np.unique(rolled[start : start + n - length + 1]))
        elif n:
            short = np.full(1, _B)
            for i in range(n):
                short = _mixed(short + h[start + i : start + i + 1] * _C)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def _order_key(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low half of a hash: what frequencies are counted by."""
    return ((shingles >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (shingles & np.uint64(0xFFFFFFFF))


def frequencies(texts: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Order keys of frequent shingles, their counts, the number of buckets, and the mean list length of all others."""
    # As many buckets as the input has partitions, times four: a bucket's size does not grow with the corpus.
    buckets = max(32, 4 * texts.rdd.getNumPartitions())

    def rows(keys, counts):
        order = np.argsort(keys)
        keys, counts = keys[order], np.minimum(counts[order], 2**31 - 1).astype(np.uint32)
        cuts = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1).astype(np.uint64))
        held = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        low = keys.astype(np.uint32)
        return pd.DataFrame({"bucket": held, "low": [low[cuts[b] : cuts[b + 1]].tobytes() for b in held], "n": [counts[cuts[b] : cuts[b + 1]].tobytes() for b in held]})

    def partial(frames):
        hashes, hot = WordHashes(), {}
        for frame in frames:
            for a, b in chunks(frame, 2_000_000):
                sets = shingle_sets(frame["text"].iloc[a:b], length, hashes)
                keys, counts = np.unique(_order_key(np.concatenate(sets), buckets), return_counts=True)
                often = counts >= 8
                for k, n in zip(keys[often].tolist(), counts[often].tolist()):
                    hot[k] = hot.get(k, 0) + n
                yield rows(keys[~often], counts[~often])
        if hot:
            yield rows(np.fromiter(hot, np.uint64, len(hot)), np.fromiter(hot.values(), np.int64, len(hot)))

    def total(frame):
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["low"]])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["n"]]).astype(np.int64)
        order = np.argsort(low)
        low, counts = low[order], counts[order]
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        low, counts = low[starts], np.add.reduceat(counts, starts)
        keys = np.uint64(frame["bucket"].iloc[0]) << np.uint64(32) | low.astype(np.uint64)
        rare = counts < FREQUENT
        out = [(0, b"", b"", int(counts[rare].sum()), int((counts[rare] ** 2).sum()))]
        level = np.floor(np.log2(np.maximum(counts, 1))).astype(int)
        for v in np.unique(level[~rare]):
            own = (level == v) & ~rare
            out.append((int(v), keys[own].tobytes(), counts[own].tobytes(), int(own.sum()), 0))
        return pd.DataFrame(out, columns=["level", "keys", "counts", "n", "squares"])

    counted = texts.select("text").mapInPandas(partial, "bucket int, low binary, n binary").groupBy("bucket").applyInPandas(total, "level int, keys binary, counts binary, n long, squares long")
    counted = cut_lineage(counted, "frequencies")
    levels = {r["level"]: r for r in counted.groupBy("level").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares")).collect()}  # one row per power of two
    rare = levels.pop(0, None)
    least, held = 99, 0
    for v in sorted(levels, reverse=True):
        if (held := held + levels[v]["n"]) > LISTED:
            break
        least = v
    listed = counted.where(F.col("level") >= least).select("keys", "counts").collect()  # LISTED entries at most
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in listed]) if listed else np.zeros(0, np.uint64)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in listed]) if listed else np.zeros(0, np.int64)
    order = np.argsort(keys)
    mean = rare["squares"] / rare["n"] if rare and rare["n"] else 1.0
    return keys[order], counts[order].astype(np.int32), buckets, mean


def subset_sizes(n: int, percent: int) -> list[int]:
    """The sizes of common subsets that a set of n shares with a linked partner."""
    return sorted({-(-percent * m // 100) for m in range(n, 100 * n // percent + 1) if -(-percent * m // 100) <= n})


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def boundary(percent: int, mean_list: float, largest: int = 40) -> int:
    """Largest size whose subsets cost no more than its postings and the candidates these bring.

    A candidate costs the shipping of its set, about a row per four shingles.
    """
    best = 0
    for n in range(1, largest + 1):
        subsets = sum(comb(n, c) for c in subset_sizes(n, percent))
        if subsets > prefix_length(n, percent) * (1 + mean_list * n / 4):
            break
        best = n
    return best


def _signatures(s: np.ndarray, frequency: np.ndarray, percent: int, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that linked sets share, with the place of the shingle in the order (-1: a subset)."""
    n, keys, places = len(s), [], []
    if n <= light:
        mixed = _mixed(s + _C)
        for c in subset_sizes(n, percent):
            gone = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
            left = mixed.sum() - mixed[gone].sum(axis=1, dtype=np.uint64)
            keys.append(_mixed(left * _A + np.uint64(c)))
            places.append(np.full(len(gone), -1))
    if n > light or 100 * n >= percent * (light + 1):
        first = np.lexsort((s, frequency))[: prefix_length(n, percent)]
        keys.append(s[first])
        places.append(np.arange(len(first)))
    return np.concatenate(keys), np.concatenate(places)


def digests(texts: DataFrame, length: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, 128-bit digest of the set, histogram, signatures; stored, as several passes read it."""
    listed, counts, buckets, mean = frequencies(texts, length)
    shared = texts.sparkSession.sparkContext.broadcast((listed, counts))
    light = boundary(percent, mean)

    def run(frames):
        hashes = WordHashes()
        listed, counts = shared.value
        for frame in frames:
            for a, b in chunks(frame):
                sets = shingle_sets(frame["text"].iloc[a:b], length, hashes)
                every = np.concatenate(sets)
                frequency = np.zeros(len(every), np.int32)
                if len(listed):
                    keys = _order_key(every, buckets)
                    at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
                    frequency = np.where(listed[at] == keys, counts[at], 0)
                cuts = np.cumsum([len(s) for s in sets])[:-1]
                out = []
                for s, f in zip(sets, np.split(frequency, cuts)):
                    keys, places = _signatures(s, f, percent, light) if len(s) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    cells = np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), 65535).astype(np.uint16)
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), cells.tobytes(), keys.view(np.int64), places.astype(np.int32)))
                n, print_, cells, keys, places = zip(*out)
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b].astype("Int64"), "text_hash": frame["text_hash"].iloc[a:b], "n": n, "digest": print_, "cells": cells, "keys": keys, "places": places})

    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    return cut_lineage(hashed.mapInPandas(run, "doc_id long, text_hash long, n long, digest binary, cells binary, keys array<long>, places array<int>"), "digests")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One node per distinct non-empty set: node (an id kept by storing it), smallest doc_id, and the digest's columns."""
    grouped = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "cells", "keys", "places")])
    return cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")


@F.pandas_udf(T.LongType())
def _most_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """At most so many elements are common to two sets, by their histograms (a full cell bounds nothing)."""
    if not len(a):
        return pd.Series([], dtype="int64")
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, CELLS).astype(np.int64) for s in (a, b))
    least = np.minimum(x, y)
    return pd.Series(np.where((least == 65535).any(axis=1), 1 << 40, least.sum(axis=1)))


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Elements common to two packed sets."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _needed_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose doc_id is in ``wanted`` (node, doc_id, digest).

    A table of ``_BITS`` bits, whatever the size of ``wanted``, keeps most other texts out of the shuffle.
    """
    def bit(column):
        return F.pmod(F.xxhash64(column), F.lit(_BITS))

    bits = wanted.select(bit("doc_id").alias("b")).groupBy(F.floor(F.col("b") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("_bits"))
    marked = texts.withColumn("_b", bit("doc_id")).withColumn("_word", F.floor(F.col("_b") / 64)).join(F.broadcast(bits), "_word")
    marked = marked.where("(shiftrightunsigned(_bits, cast(_b % 64 as int)) & 1) = 1").drop("_b", "_word", "_bits")
    own = wanted.select("node", "digest", F.col("doc_id").alias("_id"))
    return marked.join(own, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")


def packed_sets(ids: DataFrame, nodes: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(node, held): the whole set of each node in ``ids``, packed; stored."""
    wanted = nodes.select("node", "doc_id", "digest").join(ids, "node", "left_semi")

    def pack(frames):
        hashes = WordHashes()
        for frame in frames:
            for a, b in chunks(frame):
                part = frame.iloc[a:b]
                packed = [s.tobytes() for s in shingle_sets(part["text"], length, hashes)]
                same = [hashlib.blake2b(p, digest_size=16).digest() == d for p, d in zip(packed, part["digest"])]
                yield pd.DataFrame({"node": part["node"], "held": packed})[np.array(same, bool)]

    needed = _needed_texts(texts, wanted).select("node", "digest", "text")
    return cut_lineage(needed.mapInPandas(pack, "node long, held binary").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: bounded by histograms first, then counted on the whole sets."""
    side = nodes.select("node", "n", "cells")
    left = side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    right = side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    bounded = pairs.join(left, "a").join(right, "b")
    close = (100 + percent) * _most_common("ca", "cb") >= percent * (F.col("na") + F.col("nb"))
    bounded = cut_lineage(bounded.where(close).select("a", "b", "na", "nb"), "bounded")
    sets = packed_sets(bounded.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts, length)
    both = bounded.join(sets.select(F.col("node").alias("a"), F.col("held").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("hb")), "b")
    return both.where((100 + percent) * _common("ha", "hb") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _block_links(percent: int):
    """Links between different components among the sets of one block, or between two blocks.

    Intersections are counted as products of 0/1 matrices over slices of the shingles that occur twice;
    one link is enough for each pair of components."""
    def run(frame):
        sets = [np.frombuffer(x, np.uint64) for x in frame["held"]]
        side, label, node = (frame[c].to_numpy() for c in ("side", "label", "node"))
        size = np.array([len(s) for s in sets], np.int64)
        rows, columns = (np.flatnonzero(side == 0), np.flatnonzero(side == side.max()))
        codes, held = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        often = np.bincount(held, minlength=len(codes)) > 1
        rank = np.cumsum(often) - 1
        keep = often[held]
        held, owner = rank[held[keep]], owner[keep]
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        common = np.zeros((len(rows), len(columns)), np.float32)
        for start in range(0, int(often.sum()), 2048):
            lo, hi = np.searchsorted(held, [start, start + 2048])
            cells = np.zeros((len(sets), 2048), np.float32)
            cells[owner[lo:hi], held[lo:hi] - start] = 1
            common += cells[rows] @ cells[columns].T
        enough = (100 + percent) * common.astype(np.int64) >= percent * (size[rows][:, None] + size[columns][None, :])
        i, j = np.nonzero(enough & (label[rows][:, None] != label[columns][None, :]))
        i, j = rows[i], columns[j]
        ends = np.sort(np.stack([label[i], label[j]], axis=1), axis=1)
        one = np.unique(ends, axis=0, return_index=True)[1] if len(i) else np.zeros(0, np.int64)
        return pd.DataFrame({"a": node[i[one]], "b": node[j[one]]})

    return run


def _group_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """Links inside large groups: a group is cut into blocks of a bounded number of sets and shingles, and
    each pair of blocks is compared in one task, which returns links only."""
    sets = packed_sets(members.select("node").distinct(), nodes, texts, length)
    weight = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    own = members.join(weight, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(
        F.least("block", other).alias("i"), F.greatest("block", other).alias("j"), (F.col("block") > other).cast("int").alias("side")))
    dealt = own.select("key", "node", "label", F.explode(meets).alias("m")).select("key", "node", "label", "m.i", "m.j", "m.side").join(sets, "node")
    return dealt.groupBy("key", "i", "j").applyInPandas(_block_links(percent), "a long, b long").distinct()


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links (a, b) have joined labels; each label becomes the smallest of its component."""
    def renamed(edges, names):
        at = edges.join(names.select(F.col("label").alias("a"), F.col("to").alias("x")), "a", "left").join(names.select(F.col("label").alias("b"), F.col("to").alias("y")), "b", "left")
        return at.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct()

    first = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
    edges = cut_lineage(renamed(links, first), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("to")).select("label", F.least("label", "to").alias("to"))
        for _ in range(2):  # follow the pointers, which always lead to smaller labels
            hop = hop.join(hop.select(F.col("label").alias("to"), F.col("to").alias("next")), "to").select("label", F.least("to", "next").alias("to"))
        hop = cut_lineage(hop, "hops")
        moved = labels.join(hop, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels, edges = cut_lineage(moved, "labels"), cut_lineage(renamed(edges, hop), "edges")
    return labels


def _fits(percent: int, n, m, place, other):
    """Size and position bounds: what two sets can still share from a common key on."""
    need = F.ceil(percent * (n + m) / F.lit(100.0 + percent))
    small, large = F.least(n, m), F.greatest(n, m)
    after = F.when((place < 0) | (other < 0), small).otherwise(F.least(n - place, m - other))
    return (100 * small >= percent * large) & (after >= need)


def _neighbour_pairs(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of neighbours in each group that stand in different components and may link."""
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("members") / GROUP))
    order = [F.col("n")] * (turn == 0) + [F.xxhash64("node", F.lit(100 + turn)), F.col("node")]
    w = Window.partitionBy("key", "part").orderBy(*order)
    me = F.struct("node", "label", "n", "place")
    near = members.withColumn("part", part).select("node", "label", "n", "place", F.array(*[F.lag(me, i).over(w) for i in range(1, NEIGHBOURS + 1)]).alias("near"))
    pairs = near.select("node", "label", "n", "place", F.explode("near").alias("o")).where(F.col("o").isNotNull() & (F.col("o.label") != F.col("label")))
    pairs = pairs.where(_fits(percent, F.col("n"), F.col("o.n"), F.col("place"), F.col("o.place")))
    return pairs.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()


def _open_groups(members: DataFrame) -> DataFrame:
    """Members of groups that still hold several components, with the largest component of the group."""
    parts = members.groupBy("key", "label").agg(F.count("*").alias("size"))
    main = parts.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    return cut_lineage(members.join(main, "key"), "open")


def _all_left(open_: DataFrame, percent: int) -> DataFrame:
    """Every pair of a small open group that stands in different components and may link: members outside
    the largest component of their group against all members."""
    stray = open_.where("label <> main").select(*[F.col(c).alias(f"s_{c}") for c in open_.columns])
    apart = (F.col("s_label") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("s_node") < F.col("node")))
    fits = _fits(percent, F.col("n"), F.col("s_n"), F.col("place"), F.col("s_place"))
    pairs = stray.join(open_, (F.col("s_key") == F.col("key")) & apart & fits)
    return pairs.select(F.least("s_node", "node").alias("a"), F.greatest("s_node", "node").alias("b")).distinct()


def classes(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Per row: doc_id, hash of the text, n_shingles, label of the component (null for empty sets), component_id."""
    texts = text_of(docs)
    rows = digests(texts, length, percent)
    nodes = distinct_sets(rows)
    postings = nodes.select("node", "n", F.explode(F.arrays_zip("keys", "places")).alias("k")).select(F.col("k.keys").alias("key"), "node", "n", F.col("k.places").alias("place"))
    groups = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut_lineage(postings.join(groups, "key"), "shared")
    labels = nodes.select("node", F.col("node").alias("label"))
    for turn in range(ROUNDS):
        pairs = _neighbour_pairs(shared.join(labels, "node"), percent, turn)
        labels = contract(labels, verified(pairs, nodes, texts, length, percent))
    open_ = _open_groups(shared.join(labels, "node"))
    links = verified(_all_left(open_.where(F.col("members") <= SMALL), percent), nodes, texts, length, percent)
    large = open_.where(F.col("members") > SMALL)
    if not large.isEmpty():
        links = links.unionByName(_group_links(large, nodes, texts, length, percent))
    labels = contract(labels, links)
    named = labels.join(nodes.select("node", "doc_id", "digest"), "node")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = named.join(smallest, "label").select("digest", "label", "component_id")
    # Copies of one set may be a third of all rows: only their ids and digests meet here.
    out = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "digest").join(of_set, "digest", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "label", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def components(docs: DataFrame, length: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: the smallest doc_id reachable by links."""
    return classes(docs, length, percent).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; rows without words all stay."""
    found = cut_lineage(classes(docs, length, percent), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("r")
    kept = found.where("n_shingles > 0").groupBy("label").agg(first).select("r.doc_id", "r.text_hash")
    kept = kept.unionByName(found.where("n_shingles = 0").select("doc_id", "text_hash")).distinct()
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    left = docs.join(kept, same, "left_semi")
    # Repeated rows of the document that stays are one document; where none repeats, the texts are not dealt again.
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])
