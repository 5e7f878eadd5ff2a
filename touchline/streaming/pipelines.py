"""Structured Streaming forms of ingest, windows, chains, dedupe and score state.

Each pipeline reads arriving event files, keeps its state behind a watermark, and writes to
a table in the shared folder; a run with ``availableNow`` drains what has arrived and ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline import matchlog
from touchline.functions.flags import flags_b, flags_c
from touchline.operators.sequences import STOPPAGE
from touchline.session import scratch_dir

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DELAY = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Arriving event files; the event time is a zoned timestamp (watermarks need one)."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def log_with_time(events: DataFrame) -> DataFrame:
    """Match log columns plus ``ts`` (both are projections of the same row, so no join)."""
    base = events.withColumnRenamed("ts", "_ts")
    return matchlog.match_log(base, keep=["_ts"]).withColumnRenamed("_ts", "ts")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a Parquet table and return it."""
    spark = stream.sparkSession
    path, state = scratch_dir(spark, name), scratch_dir(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ingest_by_match(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Arriving rows replace the stored row of the same event; a match may be spread over files.

    Every micro-batch owns one directory, overwritten if the batch is repeated after a failure, so
    stored matches are never read and rewritten in place; ``latest_matches`` shows the newest row
    of each event.  A stream carries no removals: a row that a later file leaves out stays."""
    path, state = scratch_dir(spark, "ingest"), scratch_dir(spark, "ingest-state")
    flagged = flags_b(matchlog.match_log(event_stream(spark, sf_dir, files_per_batch))).select(
        "season", "match_id", "event_index", "team", "type", "is_shot", "is_pass", "box_entry"
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    flagged.writeStream.foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return latest_matches(spark.read.parquet(path))


def latest_matches(stored: DataFrame) -> DataFrame:
    """Newest row of every event of a match; of several in one batch the greatest by its columns, so
    that the result does not depend on the run (max combines map-side)."""
    cols = [c for c in stored.columns if c != "batch"]
    newest = stored.groupBy("match_id", "event_index").agg(F.max(F.struct("batch", *cols)).alias("_r"))
    return newest.select(*[F.col("_r")[c].alias(c) for c in cols])


def momentum_windows(events: DataFrame, length: str = "10 minutes") -> DataFrame:
    """Tumbling event-time windows per match and team."""
    df = flags_b(log_with_time(events)).withWatermark("ts", DELAY)
    return df.groupBy(F.window("ts", length), "match_id", "team").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if("is_shot").alias("shots"), F.count_if("box_entry").alias("box_entries")
    ).selectExpr("window.start as window_start", "window.end as window_end", "match_id", "team", "event_count", "shots", "box_entries")


def gap_chains(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Gap-based chains of one side of a match."""
    df = log_with_time(events).withWatermark("ts", DELAY)
    return df.groupBy(F.session_window("ts", gap), "match_id", "team_side").agg(
        F.count(F.lit(1)).alias("actions"), F.count_if("is_shot").alias("shots")
    ).selectExpr("session_window.start as chain_start", "session_window.end as chain_end", "match_id", "team_side", "actions", "shots")


def deduplicated(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(keys or ["event_id"])


#: How far by event time a row may stand behind the newest one, whatever file it comes in; far above the
#: longest match (seven days on the smallest tables). Later rows are left out by Spark and counted in the query's
#: progress (numRowsDroppedByWatermark). A match without a goal for so long before the watermark is over, and its state goes.
LATE_DAYS = 60
LATE_MS = LATE_DAYS * 24 * 3600 * 1000
GOAL = ["period", "expanded_minute", "event_index", "is_home"]
SCORE = "match_id long, event_index double, home_after long, away_after long, version long"
SCORE_STATE = "period array<long>, expanded_minute array<double>, event_index array<double>, is_home array<boolean>, latest long, version long"


def _score(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # the match is over
        state.remove()
        return
    rows = pd.concat(list(batches))
    goals, latest, version = rows[GOAL].assign(new=True), int(rows["ms"].max()), 1
    if state.exists:
        *known, before, version = state.get
        goals = pd.concat([pd.DataFrame(dict(zip(GOAL, known))).assign(new=False), goals])
        latest, version = max(latest, before), version + 1
    goals = goals.drop_duplicates("event_index", keep="last").sort_values(GOAL[:3])
    state.update((*[goals[c].tolist() for c in GOAL], latest, version))
    state.setTimeoutTimestamp(latest + LATE_MS)
    out = pd.DataFrame({
        "match_id": key[0], "event_index": goals["event_index"], "home_after": goals["is_home"].astype("int64").cumsum(),
        "away_after": (~goals["is_home"].astype(bool)).astype("int64").cumsum(), "version": version,
    })
    # An earlier goal that arrives later changes the score at all that follow it.
    yield out[goals["new"].astype(bool).cummax().to_numpy()]


def score_state(events: DataFrame) -> DataFrame:
    """Running score per match at each goal, whatever the order in which files arrive. The goals of a match
    (a few rows) are its state, until ``LATE_DAYS`` have gone by; a goal whose score changes is given
    again with a higher ``version``, and ``latest_scores`` shows the newest."""
    log = flags_c(log_with_time(events)).withWatermark("ts", f"{LATE_DAYS} days").where("is_goal")
    df = log.selectExpr("ts", "unix_millis(ts) as ms", "match_id", "cast(period as long) as period", "cast(expanded_minute as double) as expanded_minute",
                        "cast(event_index as double) as event_index", "team_side = 'home' as is_home")
    return df.groupBy("match_id").applyInPandasWithState(_score, SCORE, SCORE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_scores(stored: DataFrame) -> DataFrame:
    """Newest score at each goal (max combines map-side)."""
    newest = stored.groupBy("match_id", "event_index").agg(F.max(F.struct("version", "home_after", "away_after")).alias("_r"))
    return newest.select("match_id", "event_index", "_r.home_after", "_r.away_after")


# ------------------------------------------------------------------ values at every event

#: What a match keeps of each event, and how its values are given: rows that are new or whose value has changed.
KEPT = {"event_index": "double", "period": "bigint", "expanded_minute": "double", "clock_s": "double", "team_key": "string", "is_home": "boolean", "is_goal": "boolean", "halt": "boolean"}
KEPT_STATE = ", ".join([*[f"{c} array<{kind}>" for c, kind in KEPT.items()], "latest bigint", "version bigint"])


def _scores(rows: pd.DataFrame) -> pd.DataFrame:
    """Home and away goals after each event; ``rows`` in match order."""
    goal, home = rows["is_goal"].astype(bool), rows["is_home"].astype(bool)
    return pd.DataFrame({"home_after": (goal & home).astype("int64").cumsum(), "away_after": (goal & ~home).astype("int64").cumsum()})


def _attack_chains(gap: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Chain numbers: a new one at another period or team, after more than ``gap`` seconds, and at a stoppage on either side."""

    def numbers(rows: pd.DataFrame) -> pd.DataFrame:
        before, halt = rows.shift(1), rows["halt"].astype(bool)
        new = (rows["period"] != before["period"]) | (rows["team_key"] != before["team_key"]) | (rows["clock_s"] - before["clock_s"] > gap) | halt | halt.shift(1, fill_value=False)
        return pd.DataFrame({"attack_chain_id": new.astype("int64").cumsum()})

    return numbers


def _at_every_event(values: Callable[[pd.DataFrame], pd.DataFrame]):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the match is over
            state.remove()
            return
        arrived = pd.concat(list(batches))
        rows, latest, version, old = arrived[list(KEPT)], int(arrived["ms"].max()), 1, None
        if state.exists:
            *columns, before, version = state.get
            known = pd.DataFrame(dict(zip(KEPT, columns)))
            old = pd.concat([known[["event_index"]], values(known)], axis=1).set_index("event_index")
            rows, latest, version = pd.concat([known, rows]), max(latest, before), version + 1
        # The newest row of an event counts.
        rows = rows.drop_duplicates("event_index", keep="last").sort_values(["period", "expanded_minute", "event_index"]).reset_index(drop=True)
        state.update((*[rows[c].tolist() for c in KEPT], latest, version))
        state.setTimeoutTimestamp(latest + LATE_MS)
        now = values(rows)
        changed = pd.Series(True, index=rows.index)
        if old is not None:
            changed = (old.reindex(rows["event_index"]).reset_index(drop=True) != now).any(axis=1)
        yield pd.concat([rows[["event_index"]], now], axis=1)[changed].assign(match_id=key[0], version=version)

    return update


def at_every_event(events: DataFrame, values: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> DataFrame:
    """``values`` of every event of a match, whatever the order in which files arrive.

    A match keeps its events (a bounded number, a few columns of each) until ``LATE_DAYS`` have gone by; an event whose
    value changes is given again with a higher ``version``, and ``latest_values`` shows the newest.
    """
    log = flags_c(log_with_time(events)).withWatermark("ts", f"{LATE_DAYS} days")
    df = log.selectExpr("ts", "unix_millis(ts) as ms", "match_id", "cast(event_index as double) as event_index", "cast(period as bigint) as period",
                        "cast(expanded_minute as double) as expanded_minute", "cast(clock_s as double) as clock_s", "team_key", "team_side = 'home' as is_home", "is_goal",
                        f"concat(type_c, outcome_c) rlike '{STOPPAGE}' as halt")
    out = ", ".join(["event_index double", *[f"{c} bigint" for c in columns], "match_id bigint", "version bigint"])
    return df.groupBy("match_id").applyInPandasWithState(_at_every_event(values), out, KEPT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def score_at_every_event(events: DataFrame) -> DataFrame:
    return at_every_event(events, _scores, ["home_after", "away_after"])


def attack_chains(events: DataFrame, gap: float = 15.0) -> DataFrame:
    return at_every_event(events, _attack_chains(gap), ["attack_chain_id"])


def latest_values(stored: DataFrame) -> DataFrame:
    """Newest values of each event (max combines map-side)."""
    columns = [c for c in stored.columns if c not in ("match_id", "event_index", "version")]
    newest = stored.groupBy("match_id", "event_index").agg(F.max(F.struct("version", *columns)).alias("_r"))
    return newest.select("match_id", "event_index", *[F.col("_r")[c].alias(c) for c in columns])


def refresh_runs(spark: SparkSession, sf_dir: str, runs: int = 2) -> DataFrame:
    """Rebuild only when sources changed: the file source's checkpoint remembers what it has
    read, so a second run over unchanged files writes nothing."""
    path, state = scratch_dir(spark, "refresh"), scratch_dir(spark, "refresh-state")
    counts = []
    for run in range(1, runs + 1):
        stream = event_stream(spark, sf_dir).select("event_id").withColumn("run", F.lit(run))
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        counts.append(run)
    done = spark.read.parquet(path).groupBy("run").agg(F.count(F.lit(1)).alias("rows"))
    return spark.createDataFrame([(r,) for r in counts], "run int").join(done, "run", "left").na.fill(0, ["rows"])
