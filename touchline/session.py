"""Session helpers: settings the operators rely on and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Broadcasting is left to Spark's own size check (autoBroadcastJoinThreshold) except for
# the fixed grids, whose row count is a constant of the grid.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JIT does not compile methods above 8000 bytes; wide flag projections exceed that, and
    # Spark's split evaluation (compiled) is then 2-3 times faster than one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


_LOCAL_BASE: dict[str, str] = {}
_OWNED: set[str] = set()


def local_session(cpus: int | str = "*", name: str = "touchline") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the results depend on."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        if spark.conf.get(key, None) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, removed when the driver ends.

    Read from ``spark.checkpoint.dir``. Only on one machine (master ``local[...]``), where no folder
    is configured, a temporary one is made; a cluster without the setting gets an error, because a
    folder of the driver's machine is not seen by its executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL_BASE.setdefault(app, "") or tempfile.mkdtemp(prefix="touchline-")
        _LOCAL_BASE[app] = base
    root = os.path.join(base, f"touchline-{app}")
    if root not in _OWNED:
        _OWNED.add(root)
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lost executors only
    cost a re-read and the plan behind it ends here."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
