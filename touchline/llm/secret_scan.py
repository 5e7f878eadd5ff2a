"""Secret scans over a trigram inverted index, in DataFrame functions throughout.

Every rule's expression gives a Boolean trigram query (``trigrams.py``). The index holds one posting
(trigram, document) for each trigram that some rule asks for and each document that contains it; the
postings of a clause are intersected by counting them per document, and only documents left by some
clause of a rule are searched with its expression. A rule without mandatory trigrams is searched for in
every text. Places of matches follow from the lengths of the gaps and matches that the expression cuts
a text into, added up in code points.

Scale: postings are counted with partial aggregation; the clauses are a table of a few dozen rows fixed by
the rules. A document is known by (doc_id, hash of id and text): equal hashes could only add a candidate,
never lose one, because candidates are searched in their own text. Nothing is gathered beyond the
matches of one text.

Defined results: null text counts as empty (no spans); a null doc_id stays null; repeated rows are returned
each with the same result; texts of any length are searched whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.trigrams import repeats_group, trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern``: what to find; ``value``: the group that must have ``least`` characters (0: the match).

    Groups may not be repeated without a bound: the matcher recurses once for each round, so a long text would
    overflow its stack. A character class is repeated in a loop.
    """

    kind: str
    pattern: str
    value: int = 0
    least: int = 0
    base: bool = False

    def __post_init__(self):
        if repeats_group(self.pattern):
            raise ValueError(f"{self.kind}: repeat a character class instead of a group")


# The base rules of the contract, then the rules that this scan adds.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

_BLOCK = 256


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per document (doc_id, key) the rules whose trigram query it satisfies. ``docs``: doc_id, text."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    clauses = [(kind, n, gram, len(clause)) for kind, q in queries.items() for n, clause in enumerate(q) for gram in clause]
    wanted = sorted({c[2] for c in clauses})
    spark = docs.sparkSession
    asked = spark.createDataFrame(clauses or [("", 0, "", 1)], "kind string, clause int, gram string, size int")
    lowered = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.lower("text").alias("low"))
    grams = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in wanted] or [F.lit(None).cast("string")])
    # Dealt by document once; the counts that follow stay in that partitioning.
    postings = lowered.select("doc_id", "key", F.explode(F.array_compact(grams)).alias("gram")).repartition("doc_id", "key").distinct()
    # The clause table is a few dozen rows whatever the corpus, so it is sent to every task.
    met = postings.join(F.broadcast(asked), "gram").groupBy("doc_id", "key", "kind", "clause", "size").agg(F.count("*").alias("n")).where("n = size")
    return met.groupBy("doc_id", "key").agg(F.collect_set("kind").alias("kinds"))


def _prefix(lengths: Column) -> Column:
    """Sums of all entries before each one, taken in blocks so that long arrays stay cheap."""
    size = F.size(lengths)
    blocks = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))

    def inside(state, block):
        part = F.slice(lengths, block * _BLOCK + 1, F.lit(_BLOCK))
        step = F.aggregate(
            part, F.struct(state["total"].alias("total"), F.array().cast("array<long>").alias("own")),
            lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["own"], F.array(s["total"])).alias("own")),
        )
        return F.struct(step["total"].alias("total"), F.concat(state["all"], F.array(step["own"])).alias("all"))

    begin = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<array<long>>").alias("all"))
    return F.flatten(F.aggregate(blocks, begin, inside)["all"])


def pieces(text: Column, rule: Rule) -> Column:
    """Array of (gap, match, deciding value) that the rule's expression cuts a text into; the last gap has no match."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    if rule.value == 0:
        return F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match"), m.alias("value")))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value))
    pairs = F.zip_with(found, values, lambda m, v: F.struct(m.alias("match"), v.alias("value")))
    return F.zip_with(gaps, pairs, lambda g, p: F.struct(g.alias("gap"), p["match"].alias("match"), p["value"].alias("value")))


def spans(parts: Column, rule: Rule, order: int) -> Column:
    """Array of (start, rank of the rule, end, kind) of the matches that count. ``parts``: a column, as it is read often."""
    steps = F.transform(parts, lambda p: (F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))).cast("long"))
    every = F.zip_with(parts, _prefix(steps), lambda p, before: F.struct(
        (before + F.length(p["gap"])).alias("start"), F.lit(order).alias("rank"),
        (before + F.length(p["gap"]) + F.length(p["match"])).alias("end"), F.lit(rule.kind).alias("kind"), F.length(p["value"]).alias("size"),
    ))
    return F.filter(every, lambda s: s["size"] >= rule.least)


def with_candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """All columns of ``docs`` plus ``_kinds``: the indexed rules that may match a row. ``docs``: doc_id, text, ..."""
    kinds = candidates(docs.select("doc_id", "text"), rules).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("kinds").alias("_kinds"))
    same = (F.col("_id").eqNullSafe(F.col("doc_id"))) & (F.col("_key") == row_key(F.col("doc_id"), F.col("text")))
    return docs.join(kinds, same, "left").drop("_id", "_key")


def _asked(rule: Rule) -> Column:
    return F.lit(True) if trigram_query(rule.pattern) is None else F.array_contains(F.coalesce(F.col("_kinds"), F.array().cast("array<string>")), rule.kind)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and ``found``: all spans of a text by start, then rule, as (start, rank, end, kind)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    hits = with_candidates(own, rules).select("doc_id", *[
        F.when(_asked(r) & F.regexp_like(text, F.lit(r.pattern)), pieces(text, r)).alias(f"_{i}") for i, r in enumerate(rules)])
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,size:int>>")
    each = [F.when(F.col(f"_{i}").isNull(), none).otherwise(spans(F.col(f"_{i}"), r, i)) for i, r in enumerate(rules)]
    return hits.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans as text."""
    base = [r.kind for r in rules if r.base]
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return scan(docs, rules).select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )


def _replaced(rule: Rule) -> Column:
    def kept(p):
        match = F.when(p["match"].isNull(), F.lit("")).when(F.length(p["value"]) >= rule.least, F.lit(f"[{rule.kind}]")).otherwise(p["match"])
        return F.concat(p["gap"], match)

    return F.array_join(F.transform(pieces(F.col("text"), rule), kept), "")


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with every match that counts replaced by ``[kind]``; rows, other columns and clean texts stay."""
    columns = docs.columns
    frame = with_candidates(docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))), rules)
    for rule in rules:
        frame = frame.withColumn("text", F.when(_asked(rule) & F.regexp_like("text", F.lit(rule.pattern)), _replaced(rule)).otherwise(F.col("text")))
    return frame.select(*columns)
