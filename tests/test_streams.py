"""Streams whose matches arrive over several files and micro-batches."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from touchline import matchlog
from touchline.functions.flags import flags_c
from touchline.operators import sequences
from touchline.streaming import pipelines

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def put(spark, folder, parts):
    """One file per frame, with rising modification times, so that they are read in this order."""
    for i, part in enumerate(parts):
        path = folder / f"events{i}.parquet"
        part.toPandas().to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + 60 * i,) * 2)
    return str(folder)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def test_ingest_of_a_match_in_two_files(spark, events, tmp_path):
    # Every match in two files, and the first fifty rows once more in a third.
    folder = put(spark, tmp_path, [events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), events.where("event_id < 50")])
    got = pipelines.ingest_by_match(spark, folder, files_per_batch=1).groupBy("match_id").agg(F.count("*").alias("n"), F.count_distinct("event_index").alias("d"))
    want = {r["m"]: r["n"] for r in events.groupBy(F.expr("event_id div 200 + 1").alias("m")).agg(F.count("*").alias("n")).collect()}
    assert {r["match_id"]: r["n"] for r in got.collect()} == want == {r["match_id"]: r["d"] for r in got.collect()}


@pytest.mark.parametrize("order", ["forward", "backward", "interleaved"])
def test_score_over_several_batches(spark, events, tmp_path, order):
    whole = tmp_path / "whole"
    whole.mkdir()
    score = lambda folder, n=None: sorted(map(tuple, pipelines.latest_scores(pipelines.run_to_table(pipelines.score_state(pipelines.event_stream(spark, folder, n)), "score")).collect()))
    want = score(put(spark, whole, [events]))
    assert len({r[0] for r in want}) > 1 and max(r[2] + r[3] for r in want) > 1
    cut = "event_id % 4" if order == "interleaved" else "event_id div 60"
    numbers = sorted(r[0] for r in events.selectExpr(cut).distinct().collect())
    parts = [events.where(f"{cut} = {i}") for i in (reversed(numbers) if order == "backward" else numbers)]
    folder = tmp_path / order
    folder.mkdir()
    assert score(put(spark, folder, parts), 1) == want


@pytest.mark.parametrize("order", ["backward", "interleaved"])
def test_chains_and_scores_at_every_event_over_several_batches(spark, events, tmp_path, order):
    """Equal to the batch forms over the whole log, with a row that comes again."""
    c = flags_c(matchlog.match_log(events))
    get = lambda df, *cols: sorted(tuple(r) for r in df.select("match_id", F.col("event_index").cast("double"), *cols).collect())
    cut = "event_id % 3" if order == "interleaved" else "event_id div 70"
    numbers = sorted((r[0] for r in events.selectExpr(cut).distinct().collect()), reverse=order == "backward")
    folder = put(spark, tmp_path, [*[events.where(f"{cut} = {i}") for i in numbers], events.where("event_id < 20")])
    run = lambda stream, name: pipelines.latest_values(pipelines.run_to_table(stream, name))
    chains = run(pipelines.attack_chains(pipelines.event_stream(spark, folder, 4)), "c")
    assert get(chains, "attack_chain_id") == get(sequences.attack_chains(c), "attack_chain_id")
    if order == "interleaved":
        short = run(pipelines.attack_chains(pipelines.event_stream(spark, folder, 4), gap=10.0), "s")
        assert get(short, "attack_chain_id") == get(sequences.attack_chains(c, 10.0), "attack_chain_id")
    scores = run(pipelines.score_at_every_event(pipelines.event_stream(spark, folder, 4)), "e")
    assert get(scores, "home_after", "away_after") == get(sequences.score_state(c), "home_after", "away_after")
