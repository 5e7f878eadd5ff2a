"""The versioned store: commits, upserts, failures half-way, and what is said about its sources."""

import json
import os

import pytest
from pyspark.sql import functions as F

from touchline.plans.registry import Tables
from touchline.sources import match_store, versions

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "store")


def rows(df):
    return sorted(map(str, df.collect()))


def write_csv(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_upsert_replaces_matches_in_all_tables(spark, root):
    b = Tables(spark, SF).b
    assert match_store.build(b, root) == 1
    before = {n: rows(versions.read(spark, root, n)) for n in match_store.NEEDED}
    incoming = b.where("match_id = 2 and event_index < 50")
    assert match_store.upsert(incoming, root) == 2
    wanted = match_store.match_tables(b.where("match_id <> 2 or event_index < 50"))
    for name in match_store.NEEDED:
        assert rows(versions.read(spark, root, name)) == rows(wanted[name].select(*versions.read(spark, root, name).columns))
        assert rows(versions.read(spark, root, name, 1)) == before[name]
    assert match_store.upsert(incoming.limit(0), root) == 3
    assert rows(versions.read(spark, root, "events")) == rows(versions.read(spark, root, "events", 2))


def test_a_match_that_changes_its_season_leaves_the_old_one(spark, root):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0), ("b/c d", 3, 0.0), (None, 4, 0.0)], "season string, match_id long, event_index double")
    versions.build({"events": df}, root, ["season"], ["match_id"])
    moved = spark.createDataFrame([("b/c d", 2, 1.0), (None, 1, 2.0)], df.schema)
    versions.upsert({"events": moved}, root, ["season"], ["match_id"])
    got = {(r["season"], r["match_id"], r["event_index"]) for r in versions.read(spark, root, "events").collect()}
    assert got == {("b/c d", 2, 1.0), (None, 1, 2.0), ("b/c d", 3, 0.0), (None, 4, 0.0)}
    assert {(r["partition"], r["rows"]) for r in versions.counts(spark, root).collect()} == {("b/c d", 2), ("", 2)}
    assert versions.read(spark, root, "events").where("season = 'b/c d'").count() == 2


def test_a_failure_half_way_changes_nothing(spark, root):
    b = Tables(spark, SF).b
    match_store.build(b, root)
    before = rows(versions.counts(spark, root))
    parts = match_store.match_tables(b.where("match_id = 1"))
    parts["momentum_profiles"] = parts["momentum_profiles"].withColumn("shots", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        versions.upsert(parts, root, match_store.BY, match_store.ORDER)
    assert rows(versions.counts(spark, root)) == before
    assert versions.read(spark, root, "events").count() == b.count()
    assert match_store.upsert(b.where("match_id = 1"), root) == 2


def test_two_writers_of_one_version(spark, root):
    df = spark.createDataFrame([("a", 1)], "season string, match_id long")
    versions.build({"t": df}, root, ["season"], ["match_id"])
    entries = versions.manifest(spark, root)["tables"]
    versions._commit(spark, root, entries, 1)
    with pytest.raises(RuntimeError):
        versions._commit(spark, root, entries, 1)


def test_states_of_the_sources(spark, root, tmp_path):
    folder = str(tmp_path / "in" / "nation tier" / "team")
    write_csv(folder, "2016.csv", "a,b\n1,2\n")
    write_csv(folder, "2017.csv", "a,b\n1,2\n")
    files = versions.source_files(spark, [str(tmp_path / "in")])
    state = lambda: versions.freshness(spark, root, versions.source_files(spark, [str(tmp_path / "in")]), ["t"])
    assert state()["reason"] == "missing_manifest"
    df = spark.createDataFrame([("a", 1)], "season string, match_id long")
    versions.build({"t": df}, root, ["season"], ["match_id"])
    assert state()["reason"] == "missing_source_snapshot"
    versions.build({"t": df, versions.SOURCES: files}, root, ["season"], ["match_id"])
    assert state() == {"reason": "current", "up_to_date": True, "changed": []}
    write_csv(folder, "2016.csv", "a,b\n1,2\n3,4\n")
    write_csv(folder, "2018.csv", "a,b\n")
    os.rename(os.path.join(folder, "2017.csv"), str(tmp_path / "2017.csv"))
    changed = state()
    assert changed["reason"] == "sources_changed" and [os.path.basename(p) for p in changed["changed"]] == ["2016.csv", "2017.csv", "2018.csv"]
    kinds = {os.path.basename(r["path"]): r["state"] for r in versions.changed_files(versions.read(spark, root, versions.SOURCES), versions.source_files(spark, [str(tmp_path / "in")])).collect()}
    assert kinds == {"2016.csv": "changed", "2017.csv": "removed", "2018.csv": "new"}
    held = versions.manifest(spark, root)
    path = f"{root}/_versions/{held['version']:08d}.json"
    with open(path, "w") as f:
        json.dump({**held, "format": 0}, f)
    os.remove(f"{root}/_versions/.{held['version']:08d}.json.crc")
    assert state()["reason"] == "manifest_version_changed"
    assert versions.freshness(spark, root, files, ["t", "other"])["reason"] == "missing_outputs"


def test_filters_choose_folders(spark, root):
    b = Tables(spark, "/root/testdata/sf0.01").b
    match_store.build(b, root)
    df = versions.read(spark, root, "events").where("season = '2016-2017' and match_id = 4").select("match_id", "type")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "PushedFilters: [IsNotNull(match_id), EqualTo(match_id,4)]" in plan
    assert df.count() == b.where("match_id = 4").count()
    spans = versions.read(spark, root, "events").groupBy(F.input_file_name().alias("f")).agg(F.min("match_id").alias("a"), F.max("match_id").alias("b")).orderBy("a", "b").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:]))  # files hold ranges of matches
