"""Joins, searches, mixing and the URL tree against brute force on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import ann, jaccard_join, mixing, url_filter

random.seed(5)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, length):
    words = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)} if len(words) >= length else ({tuple(words)} if words else set())


def linked(rows, length, percent):
    """(doc_id, set size, smallest doc_id reachable) of every row, by comparing all pairs."""
    sets, parent = [shingles(t, length) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return [(i, len(sets[x]), least.get(root(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)]


def near_copies():
    texts = []
    for size in (1, 2, 3, 5, 9, 10, 11, 12, 13, 20, 21, 22, 30, 40, 60, 120) * 3:
        base = [f"w{random.randrange(60)}" for _ in range(size)]
        for _ in range(random.choice([1, 2, 5])):
            words = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                k = random.randrange(len(words))
                words[k : k + 1] = random.choice([[f"z{random.randrange(9)}"], [words[k], f"y{random.randrange(5)}"]])
            texts.append(" ".join(words))
    texts += ["", None, "  \n", "A b C d", "a B c D"]
    rows = [*enumerate(texts), (0, texts[0]), (None, "q q"), (None, texts[3]), (7, "other text here for seven")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize(("length", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components(spark, length, percent):
    rows = near_copies()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, key string").repartition(3)
    got = jaccard_join.components(docs, length, percent)
    assert Counter(map(tuple, got.collect())) == Counter(linked(rows, length, percent))


def test_jaccard_star_of_near_copies(spark):
    """Near copies of one base that link to it or to each other only in part: no link may be lost."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in random.sample(range(60), i % 4):
            words[k] = f"x{random.randrange(4)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, jaccard_join.components(docs).collect())) == Counter(linked(rows, 3, 90))


def test_jaccard_empty_table_and_representatives(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.components(docs).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text, "a"), (2, text + " end", "b"), (2, text + " end", "b"), (9, "alone here", "c"), (5, "", "d"), (None, text, "e")], "doc_id long, text string, lang string")
    assert sorted((r["doc_id"], r["lang"]) for r in jaccard_join.representatives(docs).collect()) == [(2, "b"), (5, "d"), (9, "c")]


def test_signatures_meet_wherever_sets_link():
    for percent, light in ((90, 12), (80, 8), (60, 6)):
        for _ in range(300):
            n = random.randint(1, 30)
            a = random.sample(range(1000), n)
            b = a[: max(1, n - random.randint(0, 4))] + [2000 + i for i in range(random.randint(0, 4))]
            if 100 * len({*a} & {*b}) < percent * len({*a} | {*b}):
                continue
            keys = []
            for s in (a, b):
                s = np.sort(np.array(s, np.uint64))
                keys.append(set(jaccard_join._signatures(s, (s % np.uint64(3)).astype(np.int32), percent, light)[0].tolist()))
            assert keys[0] & keys[1]


def test_contract_joins_long_chains(spark):
    labels = spark.range(60).select(F.col("id").alias("node"), F.col("id").alias("label"))
    links = spark.createDataFrame([(i, i + 1) for i in range(59) if i != 30], "a long, b long")
    got = {r["node"]: r["label"] for r in jaccard_join.contract(labels, links).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(60)}


def vectors(spark, n=700, dim=12):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[50:120] = x[50]  # copies
    rows = [(i, [float(v) for v in x[i]], 1.0, i) for i in range(n)]
    odd = [(9000, None, 1.0, 1), (9100, [0.0] * dim, 1.0, 1), (9200, [float("nan")] * dim, 1.0, 1), (9300, [None] * dim, 1.0, 1), (9400, [1.0, 2.0], 1.0, 1), (None, [1.0] * dim, 1.0, 1), rows[0]]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score double, node int"), x


def test_nearest_neighbours(spark):
    table, x = vectors(spark)
    got = defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, len(x), 20))
    hit = 0
    for q, rows in got.items():
        distance = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        true = np.lexsort((np.arange(len(x)), distance))[:10]
        assert [r for r, _, _ in rows] == list(range(1, 11)) and all(abs(distance[v] - s) < 1e-12 for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        hit += len({v for _, v, _ in rows} & set(true.tolist()))
    assert hit >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[60]] == [v for v in range(50, 61) if v != 60][:10]  # ties: the smaller ids


def test_few_vectors_are_all_returned(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-50.0, 3.0]), (2, [0.0, 900.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(table, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2)] and abs(got[0][3] - math.dist((1, 0), (-50, 3))) < 1e-12
    assert ann.search(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(table, F.col("vec_id") == 77).count() == 0


def test_probes_come_in_order_of_their_score():
    part = np.random.default_rng(1).uniform(size=5)
    steps, scores = ann.perturbations(part, 3**5)
    every = sorted(sum((p if s < 0 else 1 - p) ** 2 for p, s in zip(part, step) if s) for step in np.ndindex(*[3] * 5) for step in [[v - 1 for v in step]])
    assert len({tuple(s) for s in steps.tolist()}) == 3**5 and np.allclose(scores, every)


def word_docs(spark):
    rng, rows = random.Random(8), []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 90, 300])), source, "en", 1))
    rows += [rows[0], rows[0], (None, "x y z", "a", "en", 1), (5000, None, "b", "en", 1), (5001, "w " * 9000, "c", "en", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, target int").repartition(3)


def water(sizes, weights, cap=3.0):
    """Targets by resharing the excess again and again."""
    target, open_, rest = dict.fromkeys(sizes, 0.0), [s for s in sizes], float(sum(sizes.values()))
    while open_:
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
            open_.remove(s)
    return target


def test_mix_meets_its_targets(spark):
    rows, docs = word_docs(spark)
    got = mixing.taken_words(docs, block=32)
    table = got.collect()
    assert Counter((r["doc_id"], r["size"]) for r in table) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    target = water(sizes, {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)})
    source = {i: s for i, _, s, *_ in rows}
    taken = Counter()
    for r in table:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 64 for s in sizes)
    again = mixing.taken_words(docs.repartition(5), block=32)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, table))
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_targets_with_caps(spark):
    docs = spark.createDataFrame([(1, "a " * 3, "a"), (2, "b " * 90, "b"), (3, "c " * 500, "c")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["target"] for r in mixing.taken_words(docs, block=8).collect()}
    want = water({1: 3, 2: 90, 3: 500}, {1: 5, 2: 2, 3: 1})
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want) and got[1] == 9


def test_mixed_texts_are_the_words_taken(spark):
    _, docs = word_docs(spark)
    parts = mixing.mixed_texts(docs, block=32).collect()
    got = Counter()
    for r in parts:
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = Counter()
    for r in mixing.taken_words(docs, block=32).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == +want


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 7, 100, 257, 3000):
        places = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), [F.lit(3), F.lit(1)])).collect()]
        assert sorted(places) == list(range(n))


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0].translate({k: k + 32 for k in range(65, 91)})
    path = re.split(r"[?#]", rest, maxsplit=1)[0][len(host) :]
    fits = [h + p for h, p, _ in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len) if fits else None


def test_url_rules_and_odd_urls(spark):
    urls = [
        None, "no", "http://Ex.ORG", "a://b://c/d?x", "https://www.Example.com/en/1#t", "https://example.com/en/", "https://a.example.com/en/x", "x://a.net/es/1/2/3/4/5?q",
        "x://net/fr/", "x://NET/frx", "http://x.com\n/a\nb", "://", "x://badcom/", "x://com/", "x://É.com/é",
    ]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)] + [(None, urls[4], "t"), (4, urls[4], "t")], "page_id long, url string, template string")
    got = url_filter.judged(pages).collect()
    assert len(got) == len(urls) + 2
    verdicts = {h + p: v for h, p, v in url_filter.RULES}
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"]) == rule_of(urls[r["page_id"]])
        assert r["verdict"] == verdicts[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_url_tree_learns_a_bad_branch(spark):
    rows = [(i, f"http://site.org/{'ads' if i % 3 == 0 else 'news'}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "page_id long, reject int")
    got = {r["page_id"]: r for r in url_filter.judged(pages, labels, rules=()).collect()}
    assert all((r["verdict"] == "block") == (i % 3 == 0) for i, r in got.items())
    assert {r["template"] for r in got.values()} == {"/ads/*", "/news/*"}


def test_url_tree_needs_evidence_and_has_no_depth_limit(spark):
    """A bad branch below many levels is found; a few labels among many pages reject nothing; long and hot urls are judged."""
    deep = [(i, f"http://site.org/a/b/c/d/e/{'ads' if i % 3 == 0 else 'news'}/{i}") for i in range(300)]
    few = [(1000 + i, f"http://many.org/p{i}/x") for i in range(200)]
    rest = [(2000, "http://long.org/" + "s/" * 3000), (2001, "http://long.org/t"), *[(3000 + i, "http://hot.org/one/page/again") for i in range(400)]]
    pages = spark.createDataFrame(deep + few + rest, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(1000 + i, 1) for i in range(6)], "page_id long, reject int")
    got = {r["page_id"]: r for r in url_filter.judged(pages, labels, rules=()).collect()}
    assert len(got) == pages.count()
    assert all((got[i]["verdict"] == "block") == (i % 3 == 0) for i, _ in deep) and {got[i]["template"] for i, _ in deep} == {"/a/b/c/d/e/ads/*", "/a/b/c/d/e/news/*"}
    assert all(got[i]["verdict"] == "allow" for i, _ in few[6:]) and all(got[i]["verdict"] == "allow" for i, _ in rest)


def test_url_rules_reject_no_neighbours(spark):
    """Rare es and fr pages of a host, which rules block, say nothing about the pages beside them."""
    rows = [(i, f"http://a.net/{'es' if i < 3 else 'fr' if i < 6 else f'w{i}'}/{i}") for i in range(400)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(6))
