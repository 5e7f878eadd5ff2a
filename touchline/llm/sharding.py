"""Sharding by histogram sort, in DataFrame functions throughout.

Every row has the key (h, r, t): a hash of its text, a hash of its id, and a running number that only tells
rows apart which agree in both. Splitters between shards are boundaries in the order of these keys, and a
splitter's goal is its share of all bytes. Each round lays ``probes`` evenly spaced candidate boundaries over
every interval that still holds a goal and counts the exact bytes between them across all partitions (one
partial aggregation). A goal with a boundary within ``tolerance`` (a share of one shard's bytes) takes the
nearest one; any other goal goes on inside the one gap that it fell into. A gap of a single row ends the
search at the nearer side. So the driver sees at most (shards - 1) * probes counts a round, whatever the size.

Groups of equal texts share h. Boundaries between values of h come first, so a group is cut only where it is
itself too large for the tolerance, and then by r, so that a group with a third of all rows spreads over a
third of the shards.

With the splitters known, a row's shard is the number of splitters not above its key, a projection. Rows are
exchanged once, by shard and cell: a cell is a range of h of about ``cell`` rows, and a cell with more than
twice as many (large groups of copies) is dealt over several by a hash of r and t. A row's slot is its place in
(cell, key) order, from the rows of the cells before it.

Defined results: null text counts as the empty text (8 bytes, checksum 0); a null doc_id is a value of its own;
repeated rows are each placed, in shards and slots of their own; with fewer rows than shards some shards stay
empty; an empty table gives no rows; other columns are ignored, whatever their names. Reruns over the same rows
agree: t decides between identical rows only, which are interchangeable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import cut_lineage

KEYS = ("h", "r", "t")
#: Hashes are kept to 62 bits, so that the width of any interval is a long.
SPAN = 1 << 62


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32 and the three parts of the sort key of every row, with the columns ``keep``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("h"), F.shiftrightunsigned(F.xxhash64(doc_id), 2).alias("r"),
        F.monotonically_increasing_id().alias("t"), *keep,
    )


@dataclass(frozen=True)
class Gap:
    """Keys that agree with ``fixed`` and lie from ``low`` to ``high`` in the next part; ``below``: bytes before them."""

    fixed: tuple[int, ...]
    low: int
    high: int
    below: int
    goals: tuple[float, ...]

    @property
    def part(self) -> str:
        return KEYS[len(self.fixed)]

    def holds(self) -> Column:
        here = F.col(self.part).between(self.low, self.high)
        for name, value in zip(KEYS, self.fixed):
            here = here & (F.col(name) == value)
        return here

    def bin(self, probes: int) -> Column:
        width = -(-(self.high - self.low + 1) // probes)
        return F.expr(f"({self.part} - {self.low}L) div {width}L")


def _histogram(keys: DataFrame, gaps: list[Gap], probes: int) -> dict[int, list]:
    """Exact bytes, rows and key ranges between the candidate boundaries of every gap, in key order."""
    gap = F.coalesce(*[F.when(g.holds(), F.lit(i)) for i, g in enumerate(gaps)], F.lit(None).cast("int"))
    place = F.coalesce(*[F.when(g.holds(), g.bin(probes)) for g in gaps], F.lit(None).cast("long"))
    ends = [f(k).alias(f"{f.__name__}_{k}") for k in KEYS for f in (F.min, F.max)]
    counted = keys.select("size", *KEYS, gap.alias("gap"), place.alias("bin")).where("gap is not null")
    found: dict[int, list] = {i: [] for i in range(len(gaps))}
    for row in counted.groupBy("gap", "bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *ends).collect():
        found[row["gap"]].append(row)
    return {i: sorted(rows, key=lambda r: r["bin"]) for i, rows in found.items()}


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.005, probes: int = 1024) -> list[tuple[int, ...]]:
    """The ``shards`` - 1 boundaries: the rows of the lower shards have keys below them, part by part."""
    whole = keys.agg(F.sum("size").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")).first()
    if whole["bytes"] is None or shards < 2:
        return []
    slack = tolerance * whole["bytes"] / shards
    gaps = [Gap((), whole["low"], whole["high"], 0, tuple(whole["bytes"] * j / shards for j in range(1, shards)))]
    found: dict[float, tuple[int, ...]] = {}
    while gaps:
        counts, further = _histogram(keys, gaps, probes), []
        for i, gap in enumerate(gaps):
            below, goals = gap.below, list(gap.goals)
            for row in counts[i]:
                level = len(gap.fixed)
                low, high = row[f"min_{gap.part}"], row[f"max_{gap.part}"]
                inside = [g for g in goals if g <= below + row["bytes"]]
                goals = goals[len(inside):]
                left = []
                for goal in inside:
                    before, after = goal - below, below + row["bytes"] - goal
                    if min(before, after) <= slack or row["rows"] == 1:
                        found[goal] = (*gap.fixed, low if before < after else high + 1)
                    else:
                        left.append(goal)
                if left and low < high:
                    further.append(Gap(gap.fixed, low, high, below, tuple(left)))
                elif left:  # one value of this part: go on inside it
                    name = KEYS[level + 1]
                    further.append(Gap((*gap.fixed, low), row[f"min_{name}"], row[f"max_{name}"], below, tuple(left)))
                below += row["bytes"]
        gaps = further
    return [found[goal] for goal in sorted(found)]


def shard_of(bounds: list[tuple[int, ...]]) -> Column:
    """The number of boundaries that are not above the key."""
    if not bounds:
        return F.lit(0)
    passed = []
    for bound in bounds:
        above = F.lit(True)
        for name, value in reversed(list(zip(KEYS, bound))):
            above = (F.col(name) > value) | ((F.col(name) == value) & above)
        passed.append(above)
    return F.size(F.filter(F.array(*passed), lambda above: above))


def placed(keys: DataFrame, bounds: list[tuple[int, ...]], rows: int, cell: int = 20_000) -> DataFrame:
    """``keys`` with shard and slot, exchanged once by (shard, cell, part of a large cell)."""
    cells = max(1, rows // cell)
    own = keys.withColumn("shard", shard_of(bounds)).withColumn("cell", F.expr(f"h div {-(-SPAN // cells)}L"))
    counted = own.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    large = cut_lineage(counted.where(F.col("n") > 2 * cell).select("shard", "cell", F.ceil(F.col("n") / cell).alias("parts")), "large")
    own = own.join(large, ["shard", "cell"], "left")
    own = own.withColumn("part", F.pmod(F.xxhash64("r", "t"), F.coalesce("parts", F.lit(1)))).drop("parts")
    held = own.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(held.select("shard", "cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    place = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy(*KEYS))
    ranked = own.withColumn("place", place)
    return ranked.join(starts, ["shard", "cell", "part"]).withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long")).drop("start", "place")


def sharded(docs: DataFrame, shards: int = 24, tolerance: float = 0.005, probes: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    keys = cut_lineage(keyed(docs), "keys")
    out = placed(keys, splitters(keys, shards, tolerance, probes), keys.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, keep: tuple[str, ...], shards: int = 24, tolerance: float = 0.005, cell: int = 20_000) -> None:
    """The columns ``keep`` of all documents as Parquet below ``folder``/shard=N, each file in key order.

    Splitters come from the stored keys; the texts themselves are moved once, by shard and cell.
    """
    keys = cut_lineage(keyed(docs), "keys")
    bounds = splitters(keys, shards, tolerance)
    cells = max(1, keys.count() // cell)
    own = docs.transform(keyed, tuple(c for c in keep if c != "doc_id")).withColumn("shard", shard_of(bounds))
    spot = F.pmod(F.xxhash64("h", "r", "t"), F.lit(max(1, cells // shards)))
    own.repartition("shard", spot).sortWithinPartitions("shard", *KEYS).select("shard", *keep).write.partitionBy("shard").parquet(folder)
