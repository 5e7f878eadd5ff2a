"""Histogram shards, phrase collocations and spelling variants against brute force on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import phrases, sharding, spelling, sql
from touchline.session import cut_lineage

SF = "/root/testdata/sf0.001"


def table(spark, rows, kinds="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, kinds)


# ------------------------------------------------------------------ shards

def spread_rows(seed=3):
    """Texts of many sizes, one text in a third of all rows, repeated rows, nulls and empty texts."""
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 60)))) for i in range(900)]
    rows += [(1000 + i, "the same text in every one of these rows") for i in range(400)] + [(7, "repeated")] * 150 + [(None, None), (None, ""), (5, None), (6, "x" * 3000)]
    return rows


@pytest.mark.parametrize(("shards", "probes"), [(24, 1024), (5, 4), (1, 16), (300, 64)])
def test_shards_are_near_equal_and_gapless(spark, shards, probes):
    rows = spread_rows()
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, h string, shard int").repartition(7)
    got = sharding.sharded(docs, shards, 0.005, probes).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(held.values()), 3008
    assert max(held.values()) <= total / shards * 1.01 + largest and (shards > 24 or min(held.values()) >= total / shards * 0.99 - largest)


def test_splitters_are_the_nearest_boundaries(spark):
    """Against all rows sorted by key in plain Python, with no tolerance."""
    keys = sharding.keyed(table(spark, [(*r, None) for r in spread_rows()]).repartition(5)).cache()
    rows = sorted((r["h"], r["r"], r["t"], r["size"]) for r in keys.collect())
    below = np.concatenate([[0], np.cumsum([r[3] for r in rows])])
    bounds = sharding.splitters(keys, 24, 0.0, 32)
    for j, bound in enumerate(bounds, 1):
        place = sum(r[: len(bound)] < bound for r in rows)
        goal = below[-1] * j / 24
        assert abs(below[place] - goal) == pytest.approx(np.abs(below - goal).min())


def test_groups_stay_whole_within_the_tolerance(spark):
    rows = [(i, f"text {i % 100}", None) for i in range(2000)]
    got = sharding.sharded(table(spark, rows), 4, 0.02).collect()
    places = defaultdict(set)
    for r in got:
        places[r["text_crc32"]].add(r["shard"])
    assert all(len(p) == 1 for p in places.values())
    assert sharding.sharded(table(spark, rows).limit(0)).count() == 0
    large = table(spark, [(i, "one text", None) for i in range(3000)])
    keys = sharding.keyed(large).cache()
    cut = sharding.placed(keys, sharding.splitters(keys, 3, 0.0), 3000, cell=100).collect()
    assert Counter(r["shard"] for r in cut) == {0: 1000, 1: 1000, 2: 1000} and len({(r["shard"], r["part"]) for r in cut}) > 10
    assert all(sorted(r["slot"] for r in cut if r["shard"] == s) == list(range(1000)) for s in range(3))


def test_written_shards_hold_every_text(spark, tmp_path):
    rows = spread_rows()
    folder = str(tmp_path / "out")
    sharding.write_shards(table(spark, [(*r, None) for r in rows]), folder, ("doc_id", "text"), 6)
    back = spark.read.parquet(folder)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame(rows, "doc_id long, text string").collect()))
    sizes = Counter()
    for r in back.collect():
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 8
    assert len(sizes) == 6 and max(sizes.values()) - min(sizes.values()) <= 3008 * 2


# ------------------------------------------------------------------ phrases

def odd_texts():
    rng = random.Random(5)
    words = ["New", "york", "CITY", "the", "of", "é", "a-b", "x" * 500]
    rows = [(i, " ".join(rng.choices(words, weights=[9, 9, 9, 5, 5, 2, 2, 1], k=rng.randint(0, 40))) + rng.choice(["", ".", "!\n", "\t,"]), rng.choice(["en", None, "de"])) for i in range(120)]
    return rows + [(None, None, "en"), (1, "", "en"), (2, " \t ", None), (3, ".,;:!?\n\x0b\x0c\r", "fr"), (4, "new york city " * 5000, "en"), (4, "new york city", "en"), (4, "new york city", "en")]


def collocations_in_duckdb(rows, **settings):
    con = duckdb.connect()
    con.register("given", pa.table({"text": [r[1] for r in rows], "lang": [r[2] for r in rows]}))
    con.execute("create table documents as select * from given")
    return sorted(con.execute(sql._collocations(**settings)).fetchall())


@pytest.mark.parametrize("bounds", [{}, {"hold": 40, "burst": 4, "chunk": 300}, {"vocabulary": 3, "chunk": 100}])
def test_collocations_with_and_without_spills(spark, bounds):
    rows = odd_texts()
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, rows).repartition(3), **bounds).collect())
    want = collocations_in_duckdb(rows)
    assert got == want and len(got) > 20
    some = sorted(tuple(r) for r in phrases.collocations(table(spark, rows), least=3, inside=90, top=7, **bounds).collect())
    assert some == collocations_in_duckdb(rows, least=3, inside=90, top=7)


def test_collocations_of_nothing(spark):
    docs = table(spark, odd_texts())
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("text is null")).count() == 0


def test_long_texts_are_counted_in_overlapping_parts(monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 7)
    text = " ".join(random.Random(1).choices("abc", k=200))
    words = text.split()
    for lengths in ((1, 2), (3,), (1, 2, 3)):
        state, found = phrases.TaskCounts(lengths, None, 50, 100, 3), Counter()
        for batch in [*state.count("en", [text]), *state.rest()]:
            for r in batch.to_pylist():
                found[tuple(r[w] for w in ("w1", "w2", "w3") if r[w] is not None)] += r["n"]
        assert found.pop(()) == 200
        assert found == sum((Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) for k in lengths), Counter())


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 30_000_000_000_001, 30_000_000_000_011, 31_000_000_000_007
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._cut(1, "l", "r").alias("c")).first()
    assert row["c"]["score"] == 1_000_000 * a * a // (left * right)


# ------------------------------------------------------------------ spelling

def variants_by_force(rows, letters=6, least=5, ratio=5, rate=199):
    counts, lower = Counter(), str.maketrans(spelling.UPPER, spelling.LOWER)
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out, form = {}, {}
    for w in words:
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
        out[w] = len(close)
    result = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        result.add((w, form.get(w), root, n, out[w], words[form[w]] if w in form else None))
    return result


def spelled_rows():
    rng = random.Random(11)
    rows = []
    for stem, n in (("banana", 300), ("bananas", 40), ("bananass", 7), ("banéna", 50), ("anabana", 20), ("straßen", 30), ("ÉCOLES", 25), ("écoles", 25), ("aaaaaa", 60), ("aaaaaaa", 12), ("aabaaaa", 6)):
        rows += [(rng.randrange(10**6), stem, None) for _ in range(n)]
    for _ in range(3000):
        w = list("paragraph")
        if rng.random() < 0.3:
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice("aeiou")], [w[k], w[k]]])
        rows.append((rng.randrange(10**6), "X " + "".join(w) + ", 1", None))
    return rows + [(None, "banana banana", None), (1, None, None), (2, "", None), (3, "z" * 5000, None), (4, "Banana BANANA bAnAna", None)] * 3


def test_spelling_variants(spark):
    rows = spelled_rows()
    got = {tuple(r) for r in spelling.variants(table(spark, rows).repartition(4)).collect()}
    assert got == variants_by_force(rows)
    by = {r[0]: r for r in got}
    assert by["bananass"][1:3] == ("bananas", "banana") and by["straßen"][1] is None
    few = {tuple(r) for r in spelling.variants(table(spark, rows), least=1, ratio=2, rate=3).collect()}
    assert few == variants_by_force(rows, least=1, ratio=2, rate=3)
    assert spelling.variants(table(spark, rows).limit(0)).count() == 0


def test_spelling_broadcasts_nothing(spark):
    """Files of few bytes stand for many signatures: no join may gather its side on the driver."""
    words = cut_lineage(spark.range(400).selectExpr("concat('abcdefg', char(97 + id div 20), char(97 + id % 20)) as word", "id + 5 as n"), "words")
    pairs = spelling.near_pairs(words)
    variants = spelling.variants(words.selectExpr("n as doc_id", "repeat(concat(word, ' '), cast(n as int)) as text"))
    ways = spelling.roots(words.selectExpr("word", "word as form"))
    for df, rows in ((pairs, 400 * 38 // 2), (variants, 400), (ways, 400)):
        assert len(df.collect()) == rows
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_words_share_a_signature(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzàéÿÀ"
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices(letters, k=rng.randint(6, 12)))
        k, c = rng.randrange(len(a)), rng.choice(letters)
        b = rng.choice([a[:k] + a[k + 1 :] if len(a) > 6 else a + c, a[:k] + c + a[k:], a[:k] + c + a[k + 1 :]])
        if a != b:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(set(x) & set(y) for x, y in df.select(spelling.signatures(df.a), spelling.signatures(df.b)).collect())
