"""A store of several tables with versions: events, what is derived from them, and the source files behind them.

Every write goes into folders of its own (``<table>/<partition>/store_version=<id>``), and a version is a manifest that lists for
each table the folder that holds each partition. A commit is one rename of a finished manifest, so readers see the
old version or the new one for all tables at once; a write that fails half-way leaves folders that no manifest
names. An upsert writes the partitions anew that hold or get an incoming match, in every table, and takes over the
folders of all others. Manifests hold a row per table and partition, never one per match or source file; the snapshot of
source files is a table of the store like any other.

Defined results: an upsert into a missing store builds it; a table missing from an upsert stays as it is; an empty
incoming table changes nothing; two commits of one version number are refused (the second one raises).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from touchline.session import cut_lineage

#: Raised when the layout or the rules behind stored rows change; stores of another format are rebuilt.
FORMAT = 1
SOURCES, MARK = "sources", "store_version"
#: Changed paths that a state names.
NAMED = 25


def file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default of the newest one; None where there is none."""
    folder, fs = file_system(spark, f"{root}/_versions")
    if not fs.exists(folder):
        return None
    numbers = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")]
    if not numbers or (version is not None and version not in numbers):
        return None
    stream = fs.open(file_system(spark, f"{root}/_versions/{version or max(numbers):08d}.json")[0])
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def _commit(spark: SparkSession, root: str, tables: dict, previous: int) -> int:
    number = previous + 1
    target, fs = file_system(spark, f"{root}/_versions/{number:08d}.json")
    aside = file_system(spark, f"{root}/_versions/.{uuid.uuid4().hex}")[0]
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps({"version": number, "format": FORMAT, "tables": tables}).encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(aside, target):
        raise RuntimeError(f"version {number} of {root} was committed by another writer")
    return number


def _written(df: DataFrame, root: str, name: str, by: list[str], order: list[str]) -> dict:
    """Writes a table's partitions into a folder of their own and gives their entry of the manifest.

    The rows are stored aside first: ranges are found in a pass of their own, and an upsert reads what it replaces. A
    table without partitions and order is written once, as its rows come.
    """
    mark, sort = uuid.uuid4().hex, [*by, *[c for c in order if c not in by]]
    if not sort:
        path = f"{MARK}={mark}"
        df.write.parquet(f"{root}/{name}/{path}")
        rows = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}/{path}").count()
        schema = StructType([*df.schema.fields, StructField(MARK, StringType(), False)])
        return {"schema": schema.json(), "by": by, "order": order, "parts": {"[]": {"path": path, "rows": rows}} if rows else {}}
    df = cut_lineage(df, name)
    marked = df.withColumn(MARK, F.lit(mark))
    # Ranges in the order of the files: a match stands together, and its row groups can be pruned.
    laid = marked.repartitionByRange(*sort).sortWithinPartitions(*by, MARK, *sort[len(by):])
    laid.write.mode("append").partitionBy(*by, MARK).parquet(f"{root}/{name}")
    parts = {}
    for row in df.groupBy(*by).agg(F.count("*").alias("rows")).where("rows > 0").collect():
        path = [f"{c}={_escaped(df.sparkSession, row[c])}" for c in by]
        parts[json.dumps([_text(row[c]) for c in by])] = {"path": "/".join([*path, f"{MARK}={mark}"]), "rows": row["rows"]}
    return {"schema": marked.schema.json(), "by": by, "order": order, "parts": parts}


def _text(value) -> str | None:
    return None if value is None else str(value)


def _escaped(spark: SparkSession, value) -> str:
    if value is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))


def build(tables: dict[str, DataFrame], root: str, by: list[str], order: list[str], extend: bool = False) -> int:
    """Writes all ``tables`` as the next version of the store and gives its number.

    ``by``: partition columns (those that a table has); ``order``: the columns that rows are laid out by. With
    ``extend``, the other tables of the newest version stay in the new one.
    """
    spark = next(iter(tables.values())).sparkSession
    previous = manifest(spark, root)
    has = lambda df, names: [c for c in names if c in df.columns]
    entries = {name: _written(df, root, name, has(df, by), has(df, order)) for name, df in tables.items()}
    old = previous["tables"] if previous and extend else {}
    return _commit(spark, root, {**old, **entries}, previous["version"] if previous else 0)


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest or of a given version. Filters on partition columns choose folders."""
    entry = manifest(spark, root, version)["tables"][name]
    schema = StructType.fromJson(json.loads(entry["schema"]))
    paths = [f"{root}/{name}/{p['path']}" for p in entry["parts"].values()]
    names = [c for c in schema.names if c != MARK]
    if not paths:
        return spark.createDataFrame([], schema).select(*names)
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths).select(*names)


def upsert(incoming: dict[str, DataFrame], root: str, by: list[str], order: list[str], key: str = "match_id") -> int:
    """The next version, in which the rows of incoming keys replace the stored ones in every table named."""
    spark = next(iter(incoming.values())).sparkSession
    held = manifest(spark, root)
    if held is None:
        return build(incoming, root, by, order)
    entries = dict(held["tables"])
    for name, new in incoming.items():
        new, entry = cut_lineage(new, "incoming"), entries[name]
        stored, cols = read(spark, root, name, held["version"]), entry["by"]
        keys = new.select(key).distinct()
        touched = stored.join(keys, key, "left_semi").select(*cols).unionByName(new.select(*cols)).distinct()
        names = {json.dumps([_text(r[c]) for c in cols]) for r in touched.collect()}  # partitions, no more than the manifest names
        same = F.lit(True)
        for c in cols:
            same = same & stored[c].eqNullSafe(F.col(f"_{c}"))
        kept = stored.join(touched.select(*[F.col(c).alias(f"_{c}") for c in cols]), same, "left_semi").join(keys, key, "left_anti")
        fresh = _written(kept.unionByName(new, allowMissingColumns=True).select(*stored.columns), root, name, cols, entry["order"])
        entries[name] = {**entry, "parts": {**{k: p for k, p in entry["parts"].items() if k not in names}, **fresh["parts"]}}
    return _commit(spark, root, entries, held["version"])


def counts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """table, version, partition, rows as the manifest states them."""
    held = manifest(spark, root, version)
    rows = [(name, held["version"], "/".join(v or "" for v in json.loads(k)), p["rows"]) for name, e in held["tables"].items() for k, p in e["parts"].items()]
    return spark.createDataFrame(rows, "table string, version int, partition string, rows long")


# ------------------------------------------------------------------ sources

def source_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size and modified of every file below ``paths``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def freshness(spark: SparkSession, root: str, files: DataFrame, needed: list[str]) -> dict:
    """Whether the newest version still stands for its sources: a reason, and the first changed paths.

    Reasons: missing_manifest, missing_outputs, manifest_version_changed, missing_source_snapshot, sources_changed, current.
    """
    state = lambda reason, changed=(): {"reason": reason, "up_to_date": reason == "current", "changed": list(changed)}
    held = manifest(spark, root)
    if held is None:
        return state("missing_manifest")
    for name in needed:
        for part in held["tables"].get(name, {"parts": {"": {"path": "missing"}}})["parts"].values():
            folder, fs = file_system(spark, f"{root}/{name}/{part['path']}")
            if not fs.exists(folder):
                return state("missing_outputs")
    if held["format"] != FORMAT:
        return state("manifest_version_changed")
    if SOURCES not in held["tables"]:
        return state("missing_source_snapshot")
    changed = [r["path"] for r in changed_files(read(spark, root, SOURCES), files).orderBy("path").limit(NAMED).collect()]
    return state("sources_changed", changed) if changed else state("current")


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path and state (new, removed or changed) of the files that differ between two snapshots."""
    old = previous.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    both = current.select("path", "size", "modified").join(old, "path", "full_outer")
    state = F.when(F.col("_size").isNull(), "new").when(F.col("size").isNull(), "removed").when(
        (F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified")), "changed")
    return both.select("path", state.alias("state")).where("state is not null")
