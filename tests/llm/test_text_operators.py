"""Operators that read one text at a time, against plain versions of the same rules."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from touchline.llm import byte_bpe, quality, repetition, secret_scan, token_counts, toxicity
from touchline.llm.trigrams import trigram_query

random.seed(4)
ODD = [
    "", None, "   \n\n  x \t", "aaaaaaa aaaa aa", "<|endoftext|>x <|endoftext|><|endoftext|>", "日本語のテキスト 😀😀😀", "a" * 3000, " 　x", "it's we're I'll ſ K",
    "".join(random.choice("abcdefgh") for _ in range(3000)), "word " * 4000,
]
MIXED = ["".join(random.choice("ab <|endoftext|>e\n日é'1") for _ in range(60)) for _ in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeated rows, a null id and extra columns with clashing names."""
    rows = list(enumerate(ODD + MIXED)) + [(0, ""), (3, ODD[3]), (None, "no id here")]
    rows = [(i, t, "en", "s", 0, 0.5, 7, "k") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n long, key string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 30) for i, t in plain(docs))
    got = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), limit=30)
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_byte_bpe(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in plain(docs):
        ids = library.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids)] += 1
    got = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"))
    assert Counter((*r[:4], tuple(r[4])) for r in got.collect()) == want
    assert byte_bpe.encode(empty, P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_long_and_short_merges_agree():
    pieces = ["".join(random.choice("abcdeé ") for _ in range(n)).strip().encode() or b"x" for n in (5, 60, 300, 500)]
    _, _, single, table = byte_bpe.rank_file(P.path("byte_bpe_50k.tiktoken"))
    for piece, ids in zip(pieces, byte_bpe.encode_pieces(pieces, P.path("byte_bpe_50k.tiktoken"))):
        assert byte_bpe.merge_long(single[np.frombuffer(piece, np.uint8)], table).tolist() == ids.tolist()


def repeats(words, window):
    at = {}
    for i in range(len(words) - window + 1):
        at.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(window)})


def longest(words):
    best = 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            k = 0
            while j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_repetition(docs, empty):
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(150)] + ["x y z\n" * 40, "a # b\n\n a # b\nc | d"]
    got = repetition.judge(texts, 8, 0.3, 200)
    for n, text in enumerate(texts):
        words = text.split()
        lines = [x for x in text.split("\n") if x.split()]
        assert got["n_repeat_words"][n] == repeats(words, 8) and got["longest_repeat"][n] == longest(words)
        assert got["n_dup_lines"][n] == len(lines) - len(set(lines)) and got["n_symbols"][n] == sum(text.count(c) for c in "#*$%&|<>")
        assert got["base_failed"][n] == (len(words) < 20 or 100 * repeats(words, 8) > 30 * len(words))
    rows = repetition.repetition_rules(docs).collect()
    cut = re.compile(r"[^\x20\x09-\x0D]+")
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"]) for r in rows) == Counter((i, len(w := cut.findall(t)), sum(map(len, w))) for i, t in plain(docs))
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert repetition.repetition_rules(empty).count() == 0


BASE = [
    ("assign", re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [(m.start(), r, m.end(), k) for r, (k, p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m.group(g)) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def secret_texts():
    parts = [
        "token", "API_KEY", "apikey", "=", ":", " ", "'", '"', "abcdef1234", "PASSWORD", "secret", "AKIA", "ABCDEFGH12345678", "0123456789abcdef0123456789abcdef",
        "é", "😀", "\n", "x", "_", "İ", "ghp_" + "a" * 36, "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----",
    ]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(300)] + ["token=token:abcdef1", "token=abcdef " * 700]


def test_secret_scan(spark, docs, empty):
    rows = [*enumerate(secret_texts()), (None, "token=abcdefg"), (7, None), (8, "secret: 12345678"), (8, "secret: 12345678")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, want = Counter(), Counter()
    for r in secret_scan.report(frame).collect():
        own = ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        got[r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], own] += 1
    for i, t in rows:
        spans = base_spans(t or "")
        want[i, *(spans.count(f"{k}:") for k in ("assign", "access", "hex")), spans] += 1
    assert got == want
    assert secret_scan.report(empty).count() == 0
    assert secret_scan.report(docs).count() == docs.count()


def test_added_secret_rules_and_redaction(spark):
    rows = [(1, "a ghp_" + "Z" * 36 + " b"), (2, "clean text"), (3, "password: hunter22 token=ab")]
    frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, kinds string")
    assert {r["doc_id"]: r["spans"] for r in secret_scan.report(frame).collect()} == {1: "hub_token:2:42", 2: "", 3: "assign:0:18"}
    assert {r["doc_id"]: r["text"] for r in secret_scan.redact(frame).collect()} == {1: "a [hub_token] b", 2: "clean text", 3: "[assign] token=ab"}


def test_trigram_queries_hold_for_every_match():
    for rule in secret_scan.RULES:
        query, find = trigram_query(rule.pattern), re.compile(rule.pattern.replace("(?i:", "(?i:"))
        for text in secret_texts():
            if query is not None and find.search(text):
                assert any(all(g in text.lower() for g in clause) for clause in query)
    assert trigram_query("[0-9a-f]{24,}") is None and trigram_query("ab?") is None
    assert trigram_query("(abc|xyz)[0-9]+def") == [("abc", "def"), ("def", "xyz")]


def toxic_corpus(spark, n=600):
    rng = random.Random(9)
    words, bad = [f"w{i}" for i in range(80)], ["vile", "nasty"]
    rows = []
    for i in range(n):
        y = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if y:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), int(y)))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.1), (5000, "", 0.1), (5000, "", 0.1)], "doc_id long, text string, y double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0] + [(None, 1), (4, None), (2, 0)], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_learns_and_covers_odd_rows(spark, empty):
    docs, labels, truth = toxic_corpus(spark)
    weights = toxicity.trained(docs, labels)
    got = toxicity.score(docs, weights).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    wrong = [r for r in got if r["doc_id"] in truth and (r["score"] >= 0.5) != bool(truth[r["doc_id"]])]
    assert len(wrong) <= 6
    assert {r["score"] for r in toxicity.score(docs, toxicity.trained(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(empty, weights).count() == 0


def test_ftrl_follows_the_published_update():
    s = toxicity.Settings(bits=4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    model, z, n = toxicity.Ftrl(s), {}, {}
    for _ in range(60):
        at, y = sorted(random.sample(range(16), 3)), random.random() < 0.4
        w = {}
        for i in [*at, 16]:
            a, b, l1 = z.get(i, 0.0), n.get(i, 0.0), 0 if i == 16 else s.l1
            w[i] = 0.0 if abs(a) <= l1 else -(a - (1 if a > 0 else -1) * l1) / ((s.beta + b**0.5) / s.alpha + s.l2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in [*at, 16]:
            b = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - ((b + g * g) ** 0.5 - b**0.5) / s.alpha * w[i]
            n[i] = b + g * g
        model.learn(np.array(at), float(y))
    assert all(abs(model.z[i] - v) < 1e-9 for i, v in z.items())


def test_quality_matches_a_direct_density(spark, empty):
    rng = random.Random(2)
    good = [" ".join("w" * rng.randint(2, 9) for _ in range(rng.randint(20, 90))) + "." for _ in range(150)]
    bad = [" | ".join("X" * rng.randint(2, 9) for _ in range(rng.randint(10, 60))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (7000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    x, y = np.array([quality.statistics(t) for _, t, _ in rows]), np.array([r[2] for r in rows])
    density = []
    pooled = sum((y == k).sum() * np.cov(x[y == k].T, bias=True) for k in (0, 1)) / len(y)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    for k in (0, 1):
        own = 0.7 * np.cov(x[y == k].T, bias=True) / np.outer(scale, scale) + 0.3 * pooled / np.outer(scale, scale)
        own = 0.99 * own + 0.01 * np.trace(own) / len(own) * np.eye(len(own))
        off = (x - x[y == k].mean(axis=0)) / scale
        density.append(np.log((y == k).mean()) - 0.5 * (np.linalg.slogdet(own)[1] + np.einsum("ij,jk,ik->i", off, np.linalg.inv(own), off)))
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -35, 35)))
    assert max(abs(got[i] - w) for (i, _, _), w in zip(rows, want)) < 1e-6
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    only = labels.where("quality = 1")
    assert len({r["score"] for r in quality.quality_scores(docs, only).collect()}) == 1
    assert quality.quality_scores(empty, labels).count() == 0


def test_long_text_for_every_secret_rule(spark):
    """Texts that pass each rule's trigram query and are long where the rule repeats something."""
    long = {
        "assign": "token=" + "a" * 200_000, "access": "AKIA" + "B" * 200_000, "hex": "0a" * 100_000, "private_key": "-----BEGIN " + "A " * 100_000 + "PRIVATE KEY-----",
        "hub_token": "ghp_" + "a" * 36 + " " * 200_000, "chat_token": "xoxb-" + "1-" * 100_000, "map_key": "AIza" + "x" * 35 + " " * 200_000, "web_token": ".".join(["eyJ" + "a" * 60_000] * 3),
    }
    assert set(long) == {r.kind for r in secret_scan.RULES}
    rows = [(i, text, kind) for i, (kind, text) in enumerate(long.items())]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.report(frame).collect()}
    for i, text, kind in rows:
        assert f"{kind}:0:{len(text.rstrip())}" in spans[i].split(",")
    assert all(len(r["text"]) < 200_050 for r in secret_scan.redact(frame).collect())
    with pytest.raises(ValueError):
        secret_scan.Rule("bad", "(?:[A-Z]+ )*END")


def test_quality_of_rows_that_do_not_vary(spark):
    """Alike labelled rows tell the share of the classes only; a class that does not vary leaves finite scores."""
    labels = lambda ys: spark.createDataFrame([(i, y) for i, y in enumerate(ys)], "doc_id long, quality int")
    docs_of = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for text, ys, want in (("", [0, 1] * 4, 0.5), ("One text, again and again.", [1] * 4 + [0] * 5, 5 / 11)):
        got = quality.quality_scores(docs_of([text] * len(ys)), labels(ys)).collect()
        assert len(got) == len(ys) and all(abs(r["score"] - want) < 1e-9 for r in got)
    texts = ["same words here"] * 5 + [f"text {'word ' * i} end. {i}" for i in range(5)]
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs_of(texts), labels([1] * 5 + [0] * 5)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and min(got[i] for i in range(5)) > max(got[i] for i in range(5, 10))


def test_toxicity_settings_come_from_training_rows(spark):
    """Labels of held-out rows change neither the settings nor the weights; the choice has the least loss of the grid."""
    docs, labels, _ = toxic_corpus(spark)
    held_out = F.pmod(F.col("doc_id"), F.lit(5)) == 0
    flipped = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.trained(docs, labels, held_out) == toxicity.trained(docs, flipped, held_out)
    rows = toxicity.label_rows(labels, "toxic")
    useless, useful = (0.001, 50.0, 10.0), (1.0, 1.0, 0.1)
    chosen = toxicity.choose(docs, rows, toxicity.Settings(), (useless, useful))
    assert (chosen.alpha, chosen.l1, chosen.l2) == useful
    assert toxicity.choose(docs, rows.limit(0)) == toxicity.Settings()
