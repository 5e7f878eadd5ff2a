"""Match order, and running values that do not need a whole match in one task.

Most sequence operators partition a window by match.  That is safe while a match is
bounded (the match log bounds it by construction).  For a log without that bound - one
match id holding a large share of all rows - the ``*_in_blocks`` forms cut the rows, in
match order, into ranges of about ``rows`` rows each: values are computed inside a range, one
summary row per range and match carries the state across, and the two are joined on (match,
range).  Ranges count rows, so a crowded second or a single huge match is cut like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.session import cut_lineage

ORDER = ["period", "expanded_minute", "event_index"]


def match_window(*extra: str) -> WindowSpec:
    return Window.partitionBy("match_id", *extra).orderBy(*ORDER)


def running_in_blocks(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums and previous-row values over (keys, order).

    ``df`` comes from ``row_blocks`` in an order that agrees with this one.  No task sees more than one block of one
    key, apart from the block summaries (one row per block).
    """
    sums = sums or {}
    previous = previous or {}
    df = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(upto) for n in sums})
    df = df.withColumns({f"_p_{n}": F.lag(F.struct(c)).over(inside) for n, c in previous.items()})
    rank = F.struct(*order)
    summary = df.groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(F.struct(c), rank).alias(f"_l_{n}") for n, c in previous.items()],
    )
    across = Window.partitionBy(*keys).orderBy("_block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.lag(f"_l_{n}").over(across).alias(f"_c_{n}") for n in previous],
    )
    out = df.join(carried, [*keys, "_block"])
    out = out.withColumns({n: F.col(f"_s_{n}") + F.col(f"_o_{n}") for n in sums})
    out = out.withColumns(
        {n: F.coalesce(F.col(f"_p_{n}"), F.col(f"_c_{n}")).getField(c) for n, c in previous.items()}
    )
    return out.drop(*[c for c in out.columns if c[:3] in {"_v_", "_s_", "_p_", "_o_", "_c_"}])


def row_blocks(df: DataFrame, order: list[str] | None = None, rows: int = 50_000) -> DataFrame:
    """``df`` with the number ``_block`` of its range in the order of (match_id, ``order``).

    The rows are stored before and after: the ranges are found in a pass of their own, and a number, once given, stays.
    """
    stored = cut_lineage(df, "rows")
    parts = max(1, -(-stored.count() // rows))
    laid = stored.repartitionByRange(parts, "match_id", *(order or ORDER)).withColumn("_block", F.spark_partition_id())
    return cut_lineage(laid, "ranges")


def numbered_in_blocks(df: DataFrame, keys: list[str], before: dict[str, str], new: str, name: str, rows: int = 50_000) -> DataFrame:
    """``name``: the running number of the rows, in match order, for which ``new`` holds.

    ``before`` names columns for values of the row before, for ``new`` to read; they are null on the first row.
    """
    df = running_in_blocks(row_blocks(df, rows=rows), keys, ORDER, previous=before)
    df = df.withColumn("_new", F.expr(f"cast(coalesce({new}, false) as int)"))
    return running_in_blocks(df, keys, ORDER, {name: F.col("_new")}).drop(*before, "_new", "_block")
