"""Reading delimited text, discovering files, and keeping stored tables current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.flags import with_flags
from touchline.session import cut_lineage, scratch_dir

NOT_SELECTABLE = r"backup|\.tmp|\.crdownload"


# ------------------------------------------------------------------ delimited text

def header_names(line: str) -> list[str]:
    """Column names of a header: blanks become unnamed_i, duplicates get _1, _2 ..."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for i, raw in enumerate(line.lstrip("﻿").split(",")):
        name = raw.strip().strip('"') or f"unnamed_{i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}_{seen[name]}"
        else:
            seen[name] = 0
        names.append(name)
    return names


def parse_lines(lines: DataFrame, header: str, column: str = "value") -> DataFrame:
    """CSV lines -> text columns.  Short rows are padded with '', long rows trimmed to the
    header, empty rows skipped; ``read_mode`` says whether a row needed repair."""
    names = header_names(header)
    wide = [f"c{i}" for i in range(len(names) + 1)]
    schema = ", ".join(f"`{c}` string" for c in wide)
    df = lines.where(F.trim(F.col(column)) != "")
    df = df.withColumn("_c", F.from_csv(F.col(column), schema, {"mode": "PERMISSIVE"}))
    long = F.col(f"_c.c{len(names)}").isNotNull()
    short = F.col(f"_c.c{len(names) - 1}").isNull() & ~F.col(column).endswith(",")
    mode = F.when(long | short, "repaired_field_count").otherwise("normal")
    keep = [c for c in lines.columns if c != column]
    return df.select(*keep, *[F.coalesce(f"_c.c{i}", F.lit("")).alias(n) for i, n in enumerate(names)], mode.alias("read_mode"))


def read_csv(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Resilient scan of delimited files that share a header."""
    lines = spark.read.text(path).where(F.col("value") != header)
    return parse_lines(lines, header)


def file_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """uri, path, length, header (the first line, null for an empty file) and whether the text is valid UTF-8, of every file."""
    uri = F.col("_metadata.file_path").alias("uri")
    lines = spark.read.text(paths, recursiveFileLookup=True).select(uri, "value", F.monotonically_increasing_id().alias("_n"))
    first = lines.groupBy("uri").agg(F.min_by("value", F.struct("_n")).alias("header"), F.min(F.is_valid_utf8("value")).alias("valid"))
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(uri, "path", "length")
    return every.join(first, "uri", "left").withColumn("valid", F.coalesce("valid", F.lit(True)))


def read_csv_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of all files below ``paths`` and the mode each file was read in.

    Files may have headers of their own: those that share one are read together, quote-aware, so that a quoted field may
    hold line breaks, and the groups are united by column name. Short rows are padded with '', long rows cut to the
    header, blank lines skipped. Modes: ``normal``; ``repaired_field_count`` where a row was too long;
    ``python_skip_bad_lines`` where, besides, the text is not valid UTF-8, so that long rows are left out instead;
    ``empty`` without a header (files of no bytes at all are not listed). Rows carry ``source_path``; the driver sees the distinct headers only.
    """
    files = cut_lineage(file_headers(spark, paths), "headers").withColumn("header", F.regexp_replace("header", "^\ufeff", ""))
    named = files.where("trim(header) <> ''")
    rows = None
    for (header,) in named.select("header").distinct().orderBy("header").collect():
        own = [r[0] for r in named.where(F.col("header") == header).select("path").collect()]
        names = header_names(header)
        schema = ", ".join(f"`{c}` string" for c in [*[f"c{i}" for i in range(len(names))], "_bad"])
        df = spark.read.csv(own, schema=schema, header=True, multiLine=True, quote='"', escape='"', columnNameOfCorruptRecord="_bad")
        bare = F.regexp_replace("_bad", '"[^"]*"', "")
        long = F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1 > len(names), F.lit(False))
        df = df.select(F.col("_metadata.file_path").alias("uri"), *[F.coalesce(f"c{i}", F.lit("")).alias(n) for i, n in enumerate(names)], long.alias("_long"))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    if rows is None:
        rows = spark.createDataFrame([], "uri string, _long boolean")
    rows = cut_lineage(rows, "csv")  # parsed once, for the modes and for the rows
    held = rows.groupBy("uri").agg(F.max("_long").alias("_long"))
    mode = F.when(F.coalesce(F.trim("header"), F.lit("")) == "", "empty").when(~F.coalesce("_long", F.lit(False)), "normal").when(F.col("valid"), "repaired_field_count").otherwise("python_skip_bad_lines")
    modes = files.join(held, "uri", "left").select("path", mode.alias("read_mode"))
    kept = rows.join(files.select("uri", F.col("path").alias("source_path"), "valid"), "uri").where(F.col("valid") | ~F.col("_long"))
    return kept.drop("uri", "valid", "_long"), modes


# ------------------------------------------------------------------ discovery

def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and modification time of every file below a root, without reading contents
    into rows (the content column is pruned)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def event_files(files: DataFrame) -> DataFrame:
    """Season event files by layout: nation/tier/team/season.csv, nation/tier/season.csv, or
    nation/team/season.csv.  Hidden folders are skipped and the first root wins."""
    df = files.where(F.col("path").endswith(".csv") & ~F.lower("path").rlike(NOT_SELECTABLE))
    df = df.withColumn("parts", F.split(F.col("path"), "/"))
    df = df.where(~F.exists("parts", lambda p: p.startswith("_") | p.startswith("~")))
    df = df.withColumns(
        {
            "season": F.regexp_replace(F.element_at("parts", -1), r"\.csv$", ""),
            "_up": F.element_at("parts", -2), "_up2": F.expr("try_element_at(parts, -3)"), "_up3": F.expr("try_element_at(parts, -4)"),
        }
    )
    tier = "rlike '^T[0-9]+$'"
    df = df.selectExpr(
        "*",
        f"case when _up {tier} then '__season_event_file' else _up end as source_team",
        f"case when _up {tier} then _up when _up2 {tier} then _up2 else '' end as tier",
        f"case when _up {tier} then _up2 when _up2 {tier} then _up3 else _up2 end as nation",
    )
    w = Window.partitionBy("nation", "tier", "source_team", "season").orderBy("root_no", "path")
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_up", "_up2", "_up3", "parts")


def selectable(files: DataFrame) -> DataFrame:
    """Schedule files that may be chosen: no backups, temporary or hidden names."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return files.where(~F.lower(name).rlike(NOT_SELECTABLE) & ~name.rlike(r"^[~.]"))


def freshness(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Compare two file snapshots: new, removed, changed or current per path."""
    p = previous.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"))
    df = current.join(p, "path", "full_outer")
    return df.select(
        "path",
        F.expr("case when _l is null then 'new' when length is null then 'removed' when length <> _l or modified <> _m then 'changed' else 'current' end").alias("state"),
    )


# ------------------------------------------------------------------ season and match loads

KEYS = ["match_id", "period", "expanded_minute", "team", "player", "type", "x", "y", "end_x", "end_y", "outcome"]


def dedupe_events(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Distinct on the key columns that exist (four at least), else on every scalar column."""
    have = [k for k in keys if k in df.columns]
    if len(have) < 4:
        have = [n for n, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    return df.dropDuplicates(have)


def season_events(parts: list[DataFrame]) -> DataFrame:
    """Union of the season's files with missing columns filled, no null ids, deduplicated."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return dedupe_events(out.where("match_id is not null"))


def match_events(season: DataFrame, match_id: int) -> DataFrame:
    return dedupe_events(season.where(F.col("match_id") == match_id))


# Columns typed as numbers on output, by name.
NUMERIC = {"match_id", "team_id", "player_id", "event_index", "x", "y", "end_x", "end_y", "expanded_minute", "minute", "second", "home_score", "away_score"}


def typed_output(df: DataFrame) -> DataFrame:
    """Types by column name: numbers, booleans for is_/has_, ISO text for times, cleaned text;
    arrays and maps stay native."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in NUMERIC:
            out.append(F.expr(f"try_cast(`{name}` as double)").alias(name))
        elif name.startswith(("is_", "has_")):
            out.append(F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes", "y"), F.lit(False)).alias(name))
        elif kind.startswith("timestamp"):
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(name))
        elif kind == "string":
            out.append(F.when(F.lower(F.trim(c)).isin("", "nan", "none", "null", "<na>", "nat"), "").otherwise(F.coalesce(F.trim(c), F.lit(""))).alias(name))
        else:
            out.append(c)
    return df.select(*out)


# ------------------------------------------------------------------ upserts

def upsert_matches(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of incoming match ids replace the stored ones."""
    ids = incoming.select("match_id").distinct()
    return existing.join(ids, "match_id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert_matches_table(incoming: DataFrame, path: str, partition: str = "match_id") -> None:
    """The same on a stored table: the partitions that hold or get an incoming match are written back from their
    stored rows of other matches plus the incoming ones; all others stay untouched."""
    spark = incoming.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    incoming, gone = cut_lineage(incoming, "upsert-incoming"), []
    rows = incoming
    if store.exists(folder):
        schema = spark.read.parquet(path).schema
        # The type of a partition column is guessed from its directories; the incoming rows know it.
        schema = type(schema)([incoming.schema[partition] if f.name == partition else f for f in schema])
        stored = spark.read.schema(schema).parquet(path)
        ids = incoming.select("match_id").distinct()
        held = stored.join(ids, "match_id", "left_semi").select(partition)
        touched = held.unionByName(incoming.select(partition)).distinct()
        kept = stored.join(touched.withColumnRenamed(partition, "_p"), F.col(partition).eqNullSafe(F.col("_p")), "left_semi").join(ids, "match_id", "left_anti")
        # Written aside first: the partitions that are read here are the ones overwritten.
        rows = cut_lineage(kept.unionByName(incoming, allowMissingColumns=True), "upsert")
        left = rows.select(F.col(partition).alias("_p")).distinct()
        gone = [r[0] for r in touched.join(left, F.col(partition).eqNullSafe(F.col("_p")), "left_anti").collect()]  # partitions that lost all their matches
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for value in gone:
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition, None if value is None else str(value))
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)


def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Column union; the new row of a key wins, and of several new rows the greatest by its columns in
    order (rows carry no arrival time), so that the result is always the same.  max combines before the
    shuffle, so a key with many versions never gathers in one task."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (*key, "_new")]
    return both.groupBy(*key).agg(F.max(F.struct("_new", *cols)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in cols])


def upsert_positions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (match, team, player); a known position beats ``Unknown``, then the newer row."""
    key = ["match_id", "team", "player"]
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (*key, "_new")]
    rank = F.struct((F.col("player_position") != "Unknown").alias("known"), F.col("_new"))
    return both.groupBy(*key).agg(F.max_by(F.struct(*cols), rank).alias("_r")).select(*key, "_r.*")


def failed_log(previous: DataFrame, fetched: DataFrame, failed: DataFrame) -> DataFrame:
    """(previous - fetched) and the newly failed ones."""
    kept = previous.join(fetched.select("match_id"), "match_id", "left_anti").join(failed.select("match_id"), "match_id", "left_anti")
    return kept.unionByName(failed, allowMissingColumns=True)


def merge_schedules(primary: DataFrame, enrichment: DataFrame, key: str = "match_id") -> DataFrame:
    """First non-empty value per column, the enrichment first."""
    cols = [c for c in primary.columns if c != key]
    both = enrichment.withColumn("_rank", F.lit(0)).unionByName(primary.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    filled = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col("_rank"))).alias(c)
    return both.groupBy(key).agg(*[filled(c) for c in cols], F.expr("min(_rank) = 0 and max(_rank) = 0").alias("added"))


# ------------------------------------------------------------------ coverage

def prefix_join(names: DataFrame, schedule_teams: DataFrame) -> DataFrame:
    """Event team to schedule team inside a league season: equal key, else one key a prefix of
    the other (shortest first).  The league keeps both sides to a few dozen clubs."""
    scope = ["nation", "tier", "season"]
    pairs = names.join(schedule_teams, scope).where(
        "event_key = team_key or startswith(event_key, team_key) or startswith(team_key, event_key)"
    )
    rank = F.struct(F.expr("event_key <> team_key"), F.expr("abs(length(event_key) - length(team_key))"), F.col("team_key"))
    return pairs.groupBy(*scope, "event_key").agg(F.min_by("team", rank).alias("team"))


def positions_join(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Two passes: by player id, then by lower-case name; only blank or Unknown is filled."""
    ids = positions.where("player_id is not null").groupBy("match_id", "team_id", "player_id").agg(F.min("position").alias("_a"))
    names = positions.groupBy("match_id", "team_id", F.lower("player").alias("_name")).agg(F.min("position").alias("_b"))
    df = events.withColumn("_name", F.lower("player")).join(ids, ["match_id", "team_id", "player_id"], "left").join(names, ["match_id", "team_id", "_name"], "left")
    known = F.when(~F.coalesce("position", F.lit("")).isin("", "Unknown"), F.col("position"))
    return df.withColumn("position", F.coalesce(known, "_a", "_b", F.lit("Unknown"))).drop("_a", "_b", "_name")


def coverage(schedule: DataFrame, saved: DataFrame, failed: DataFrame) -> DataFrame:
    """Each fixture with rows saved per side, and what has to be fetched."""
    per = saved.groupBy("match_id", "team_key").agg(F.count(F.lit(1)).alias("n"))
    h = per.select("match_id", F.col("team_key").alias("home_key"), F.col("n").alias("home_rows"))
    a = per.select("match_id", F.col("team_key").alias("away_key"), F.col("n").alias("away_rows"))
    f = failed.select("match_id", F.col("reason").alias("failed_reason"))
    df = schedule.join(h, ["match_id", "home_key"], "left").join(a, ["match_id", "away_key"], "left").join(f, "match_id", "left")
    df = df.na.fill(0, ["home_rows", "away_rows"])
    df = with_flags(df, finished="status in ('6','FT','AET','PEN') or upper(elapsed) in ('FT','AET','PEN','FULL TIME')")
    df = df.withColumn(
        "data_status", F.expr("case when home_rows > 0 and away_rows > 0 then 'complete' when home_rows > 0 or away_rows > 0 then 'partial' else 'missing' end")
    )
    return df.withColumn(
        "scrape_status",
        F.expr(
            "case when data_status = 'complete' then 'saved' when not finished then 'not_finished' when failed_reason is not null and data_status = 'partial' then 'failed_partial'"
            " when failed_reason is not null then 'failed' when data_status = 'partial' then 'to_complete' else 'to_fetch' end"
        ),
    ).select("nation", "tier", "season", "match_id", "home_team", "away_team", "kickoff", "finished", "home_rows", "away_rows", "data_status", "scrape_status")


def coverage_overview(cov: DataFrame) -> DataFrame:
    """Counts per league season with a status by priority."""
    n = lambda r: F.count_if(F.expr(r))
    df = cov.groupBy("nation", "tier", "season").agg(
        F.count(F.lit(1)).alias("fixtures"), n("finished").alias("finished"), n("data_status = 'complete'").alias("complete"), n("data_status = 'partial'").alias("partial"),
        n("data_status = 'missing'").alias("missing"), n("scrape_status like 'failed%'").alias("failed"), n("scrape_status in ('to_fetch','to_complete')").alias("to_fetch"),
        n("finished and data_status = 'complete'").alias("finished_complete"), F.sum(F.expr("home_rows + away_rows")).alias("event_rows"),
    )
    return df.withColumns(
        {
            "coverage_pct": F.expr("if(finished > 0, 100D * finished_complete / finished, 0D)"),
            "status": F.expr(
                "case when fixtures = 0 then 'no schedule' when failed > 0 then 'has failures' when to_fetch > 0 and complete = 0 then 'not started'"
                " when to_fetch > 0 then 'incomplete' when partial > 0 then 'partial' when finished = 0 then 'waiting' else 'complete' end"
            ),
        }
    )


def fixtures(schedule: DataFrame, saved: DataFrame) -> DataFrame:
    """Schedule rows with availability flags of both sides."""
    per = saved.select("match_id", "team_key").distinct().withColumn("_x", F.lit(True))
    h = per.select("match_id", F.col("team_key").alias("home_key"), F.col("_x").alias("has_home"))
    a = per.select("match_id", F.col("team_key").alias("away_key"), F.col("_x").alias("has_away"))
    df = schedule.join(h, ["match_id", "home_key"], "left").join(a, ["match_id", "away_key"], "left").na.fill(False, ["has_home", "has_away"])
    return df.select("match_id", "home_team", "away_team", "kickoff", "status", "has_home", "has_away", F.expr("has_home and has_away").alias("has_both"))


def column_audit(df: DataFrame) -> DataFrame:
    """Per column: type, null-like, blank and non-numeric counts, in one pass over the table."""
    aggs, items = [], []
    for i, (name, kind) in enumerate(df.dtypes):
        c = f"cast(`{name}` as string)"
        aggs += [
            F.count_if(F.expr(f"`{name}` is null or lower(trim({c})) in ('nan','none','null','<na>','nat')")).alias(f"n{i}"),
            F.count_if(F.expr(f"trim({c}) = ''")).alias(f"b{i}"),
            F.count_if(F.expr(f"`{name}` is not null and trim({c}) <> '' and try_cast({c} as double) is null")).alias(f"x{i}"),
            F.count(F.lit(1)).alias(f"r{i}"),
        ]
        items.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"), F.col(f"r{i}").alias("rows"), F.col(f"n{i}").alias("null_like"), F.col(f"b{i}").alias("blank"), F.col(f"x{i}").alias("not_numeric")))
    return df.agg(*aggs).select(F.explode(F.array(*items)).alias("i")).select("i.*")


# ------------------------------------------------------------------ store

def processed_store(flagged: DataFrame, path: str | None = None) -> str:
    """Write the flagged events as one table partitioned by season and hashed match bucket.

    A match stands whole in one file and its matches are dealt over all tasks, so a match filter prunes by
    directory and by the row-group statistics, and no task writes more than its share; one directory per match would mean billions of tiny files."""
    path = path or scratch_dir(flagged.sparkSession, "store")
    df = flagged.withColumn("bucket", F.expr("pmod(match_id, 16)"))
    (
        df.repartition("season", "bucket", "match_id").sortWithinPartitions("match_id", "event_index")
        .write.mode("overwrite").partitionBy("season", "bucket").parquet(path)
    )
    return path


def read_match(spark: SparkSession, path: str, match_id: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("bucket") == match_id % 16) & (F.col("match_id") == match_id))


def read_team(spark: SparkSession, path: str, team_key: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("team_key") == team_key)
