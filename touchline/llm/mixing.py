"""Mixing sources to target weights, in DataFrame functions throughout.

The words of a source, document after document, are packed into blocks of ``block`` words. Target sizes
follow from the weights with a cap per source. Output shards of ``shard`` slots draw their source counts
from a multinomial without replacement, i.e. one conditioned on every source's total, so that the totals
are met exactly: each slot of a source gets a place in one pseudorandom permutation of all slots, and the
places of a shard give its counts. The slots of a source are numbered shard by shard, and slot k takes
block ``permutation(k mod n)`` of pass ``k div n``, with one permutation per source and pass. Slots and
blocks meet in a join on (source, block index).

A permutation is an unbalanced Feistel network over rows and columns whose product just covers n; values
beyond n walk on until they fall inside, which takes fewer steps than one row has places.

Scale: offsets inside a source come from two levels (hash buckets of a bounded number of documents, then
the buckets), so that a source with a third of all rows is dealt over many tasks. The table of sources is
the only one ordered in one task. Word counts are stored once below the shared folder.

Defined results: null or empty text has size 0 and takes nothing; null sources are one source, ordered last;
a null doc_id stays null; repeated rows are packed each; a run over the same rows gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that one task orders.
BUCKET = 2_000
#: Slot numbers written out together before they are dealt on.
STRIDE = 65_536
_WALK = 16


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def _step(x: Column, rows: Column, cols: Column, seed: list[Column]) -> Column:
    a, b = F.floor(x / cols).cast("long"), F.pmod(x, cols)
    for turn in range(2):
        a = F.pmod(a + F.pmod(F.xxhash64(*seed, F.lit(2 * turn), b), rows), rows)
        b = F.pmod(b + F.pmod(F.xxhash64(*seed, F.lit(2 * turn + 1), a), cols), cols)
    return a * cols + b


def permuted(x: Column, n: Column, seed: list[Column]) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n-1."""
    rows = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    cols = F.ceil(n / rows).cast("long")
    first = _step(x, rows, cols, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), first, lambda y, _: F.when(y < n, y).otherwise(_step(y, rows, cols, seed)))
    return F.when(first < n, first).otherwise(walked)


def source_plan(sized: DataFrame, weights=(5, 2, 1), share: float = 1.0, cap: float = 3.0, block: int = 32) -> DataFrame:
    """Per source: number ``sid``, source_size, target, blocks ``n``, slots, and the slots before it."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1).withColumn("w", w)
    per = per.withColumn("top", cap * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("w"))
    # In order of cap over weight, the first source that the common level leaves below its cap sets the level.
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    per = per.withColumn("target", F.least(F.col("top"), F.coalesce(F.col("level") * F.col("w"), F.col("top"))))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - full * F.col("source_size")
    per = per.withColumn("n", F.ceil(F.col("source_size") / block).cast("long"))
    per = per.withColumn("slots", full * F.col("n") + F.least(F.round(rest / block).cast("long"), F.col("n")))
    first = F.coalesce(F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select("source", "sid", "source_size", "target", "n", "slots", first.alias("first"), F.sum("slots").over(everything).alias("all_slots"))


def shard_counts(plan: DataFrame, shard: int = 4096, seed: int = 7) -> DataFrame:
    """(shard, sid, drawn): how many slots of each source every output shard draws."""
    strides = plan.where("slots > 0").select("sid", "slots", "first", "all_slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / STRIDE))).alias("stride"))
    own = F.sequence(F.col("stride") * STRIDE, F.least((F.col("stride") + 1) * STRIDE, F.col("slots")) - 1)
    slots = strides.repartition("sid", "stride").select("sid", "first", "all_slots", F.explode(own).alias("k"))
    place = permuted(F.col("first") + F.col("k"), F.col("all_slots"), [F.lit(seed)])
    return slots.select("sid", F.floor(place / shard).cast("long").alias("shard")).groupBy("shard", "sid").agg(F.count("*").alias("drawn"))


def slot_blocks(plan: DataFrame, shard: int = 4096, seed: int = 7) -> DataFrame:
    """(shard, sid, pass, block): the block that each drawn slot takes."""
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = shard_counts(plan, shard, seed).withColumn("before", F.coalesce(F.sum("drawn").over(earlier), F.lit(0)))
    # A few rows here become millions: dealt again so that many tasks write them out.
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = drawn.repartition(tasks, "sid", "shard").select("shard", "sid", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("drawn") - 1)).alias("k"))
    slots = slots.join(plan.select("sid", "n"), "sid").withColumn("pass", F.floor(F.col("k") / F.col("n")).cast("long"))
    block = permuted(F.pmod("k", "n"), F.col("n"), [F.lit(seed), F.col("sid"), F.col("pass")])
    return slots.select("shard", "sid", "pass", block.alias("block"))


def offsets(sized: DataFrame, plan: DataFrame, rows: int) -> DataFrame:
    """``sized`` with sid and ``begin``: the words of the source before the document."""
    buckets = max(1, -(-rows // BUCKET))
    own = sized.join(plan.select("source", "sid"), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    totals = totals.select("sid", "bucket", F.coalesce(F.sum("held").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    own = own.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(totals, ["sid", "bucket"]).withColumn("begin", F.col("begin") + F.col("start")).drop("bucket", "start")


def spread(packed: DataFrame, block: int) -> DataFrame:
    """One row per document and block that it reaches into, with the words ``lo`` .. ``hi`` (of the document) held there."""
    last = F.floor((F.col("begin") + F.col("size") - 1) / block)
    each = packed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), last)))
    lo, hi = F.greatest(F.col("begin"), F.col("block") * block), F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block)
    return each.withColumn("lo", lo - F.col("begin")).withColumn("hi", hi - F.col("begin"))


def taken_words(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, cap: float = 3.0, block: int = 32, shard: int = 4096, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    sized = cut_lineage(sizes(docs), "sizes")
    plan = cut_lineage(source_plan(sized, weights, share, cap, block), "sources")
    packed = offsets(sized, plan, sized.count())
    uses = slot_blocks(plan, shard, seed).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    parts = spread(packed, block).join(uses, ["sid", "block"], "left")
    words = (F.col("hi") - F.col("lo")) * F.coalesce(F.col("uses"), F.lit(0))
    # Documents of one source lie side by side, so (sid, begin) tells those with words apart.
    used = parts.groupBy("sid", "begin", "doc_id", "size").agg(F.sum(words).alias("taken"))
    none = packed.where("size = 0").select("sid", "begin", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return used.unionByName(none).join(plan.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, cap: float = 3.0, block: int = 256, shard: int = 4096, seed: int = 7) -> DataFrame:
    """The mix itself: a row per slot and document in its block, with the words taken as ``text``.

    Keeps ``doc_id``, ``lang`` and ``source``; ``n_chars`` is the length of the part.
    """
    sized = cut_lineage(sizes(docs), "sizes")
    plan = cut_lineage(source_plan(sized, weights, share, cap, block), "sources")
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "lang", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), "text").where("size > 0")
    packed = offsets(own, plan, sized.count()).withColumn("words", words)
    steps = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.size("words") - 1) / block))

    def part(b):
        lo, hi = F.greatest(F.col("begin"), b * block), F.least(F.col("begin") + F.col("size"), (b + 1) * block)
        return F.struct(b.alias("block"), F.array_join(F.slice("words", (lo - F.col("begin") + 1).cast("int"), (hi - lo).cast("int")), "").alias("text"))

    parts = packed.select("doc_id", "lang", "source", "sid", F.explode(F.transform(steps, part)).alias("p"))
    parts = parts.select("doc_id", "lang", "source", "sid", "p.block", "p.text")
    mixed = parts.join(slot_blocks(plan, shard, seed), ["sid", "block"])
    return mixed.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
