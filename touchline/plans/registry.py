"""Query registry: a name, a plan over the given tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import matchlog
from touchline.functions import flags
from touchline.plans import oracle_base
from touchline.session import scratch_dir, tune
from touchline.sources import versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STORES: dict[tuple[str, str], str] = {}
# Bytes of stored raw events for one partition of matches, up to the session's number of shuffle partitions.
PART_BYTES = 256 * 1024


def checks() -> dict[str, str]:
    """The complete check statements, built once every module has defined its tables."""
    return {name: oracle_base.sql(text) for name, text in ORACLES.items()}


class Tables:
    """The frames one query is built from; each is planned only when it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return matchlog.read_events(self.spark, self.sf_dir)

    @cached_property
    def log(self) -> DataFrame:
        return matchlog.match_log(self.events)

    @cached_property
    def matches(self) -> DataFrame:
        """The log with the rows of each match in one partition, for what runs windows over matches."""
        folder, fs = versions.file_system(self.spark, f"{self.sf_dir}/events.parquet")
        parts = -(-fs.getContentSummary(folder).getLength() // PART_BYTES)
        return matchlog.match_log(self.events, parts=max(1, min(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions")))))

    @cached_property
    def schedule(self) -> DataFrame:
        return matchlog.schedule(self.events)

    @cached_property
    def a(self) -> DataFrame:
        return flags.flags_a(self.log)

    @cached_property
    def b(self) -> DataFrame:
        return flags.flags_b(self.log)

    @cached_property
    def c(self) -> DataFrame:
        return flags.flags_c(self.log)

    @cached_property
    def e(self) -> DataFrame:
        return flags.flags_e(self.log)

    @cached_property
    def f(self) -> DataFrame:
        return flags.flags_f(self.log)

    @cached_property
    def prep(self) -> DataFrame:
        from touchline.operators import sequences

        return sequences.prepare(flags.flags_c(self.matches))

    @cached_property
    def d(self) -> DataFrame:
        return flags.flags_d(self.prep)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of the session's store for these inputs; made anew when a source file has changed since."""
        root = _STORES.setdefault((self.spark.sparkContext.applicationId, self.sf_dir), "") or scratch_dir(self.spark, "store")
        _STORES[self.spark.sparkContext.applicationId, self.sf_dir] = root
        files = versions.source_files(self.spark, [f"{self.sf_dir}/events.parquet"])
        reason = versions.freshness(self.spark, root, files, [versions.SOURCES, name])["reason"]
        if reason != "current":
            current = reason == "missing_outputs"
            # Read whole, with column pruning, so neither folders of seasons nor ranges of matches would pay for their sort.
            versions.build({name: make()} if current else {versions.SOURCES: files, name: make()}, root, [], [], extend=current)
        return versions.read(self.spark, root, name)

    @cached_property
    def valued(self) -> DataFrame:
        """Prepared events with shot and ball-movement values, stored for the session."""
        from touchline.operators import value

        return self.kept("valued", lambda: value.attach_values(self.prep, self.grids))

    @cached_property
    def moves(self) -> DataFrame:
        """The valued ball movements, as ``value.value_actions`` gives them."""
        return self.valued.where("_move").withColumn("xt_added", F.col("league_xt_added"))

    @cached_property
    def grids(self) -> DataFrame:
        """Values of the 192 zones of each league season, an array a league."""
        from touchline.operators import value

        return self.kept("grids", lambda: value.solve_grids(value.zone_cells(self.f, value.LEAGUE), value.LEAGUE))

    @cached_property
    def grid(self) -> DataFrame:
        """The same, a row for each zone."""
        return self.grids.select("nation", "tier", "season", F.posexplode("grid").alias("zone", "xt"))

    @cached_property
    def match_valued(self) -> DataFrame:
        """Prepared events with ball movements valued by a grid of their own match; set pieces count nothing."""
        from touchline.operators import value

        grids = value.solve_grids(value.zone_cells(self.f, value.MATCH), value.MATCH)
        return self.kept("match_valued", lambda: value.attach_values(self.prep, grids, value.MATCH))

    @cached_property
    def runs(self) -> DataFrame:
        from touchline.operators import sequences

        return sequences.possessions(flags.flags_f(self.matches))

    @cached_property
    def shots(self) -> DataFrame:
        """Features of every shot with its value ``xg``."""
        from touchline.operators import players, value

        return players.rule_values(value.shot_features(self.runs))

    @cached_property
    def credits(self) -> DataFrame:
        """Assists of every shot with the shot's value."""
        from touchline.operators import value

        return value.shot_assists(self.runs)

    @cached_property
    def involvement(self) -> DataFrame:
        from touchline.operators import facts, players

        values = players.player_values(self.shots, self.credits, self.moves)
        return facts.player_involvement(self.e, values)


class TrainedTables(Tables):
    """The same frames with shot values from the models of each league season instead of the rule."""

    @cached_property
    def scores(self) -> DataFrame:
        from touchline.operators import shot_models, value

        return self.kept("shot_scores", lambda: shot_models.trained_scores(value.shot_features(self.runs)))

    @cached_property
    def valued(self) -> DataFrame:
        from touchline.operators import shot_models, value

        return shot_models.with_scores(self.kept("valued", lambda: value.attach_values(self.prep, self.grids)), self.scores)

    @cached_property
    def shots(self) -> DataFrame:
        from touchline.operators import players, shot_models, value

        return shot_models.with_scores(players.rule_values(value.shot_features(self.runs)), self.scores)

    @cached_property
    def credits(self) -> DataFrame:
        from touchline.operators import shot_models, value

        return shot_models.with_scores(value.shot_assists(self.runs), self.scores, "shot_index")


def query(name: str, check: str | None = None, trained: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its DuckDB check.

    ``trained``: also as ``name``_trained over trained shot values, which SQL cannot give; tests check those.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if trained:
            QUERIES[f"{name}_trained"] = lambda spark, sf_dir: fn(TrainedTables(spark, sf_dir))
        if check is not None:
            ORACLES[name] = check
        return fn

    return register
