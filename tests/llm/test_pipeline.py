"""The corpus pipeline on a small corpus, each stage against what it must do, and the registry."""

import hashlib
import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from touchline.llm import mixing, queries, stages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BAD = ["vile", "nasty", "foul"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, toxic ones, near copies and one secret, with labels for half of them."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(400):
        words = [rng.choice([f"w{k}" for k in range(300)]) for _ in range(rng.randint(20, 80))]
        y = i % 8 == 0
        for _ in range(4 * y):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(y)))
    for k in range(5):  # near copies of document 1: one word of at least twenty more
        rows.append((1000 + k, rows[1][1] + f" extra{k}", "en", "s1", 0))
    rows += [(2000, "my password: hunter22 is here with enough words to stay", "en", "s0", 0), (2001, None, "en", None, 0), (2002, "", None, "s1", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_one_after_the_other(spark, corpus):
    path, rows = corpus
    text = {i: t or "" for i, t, *_ in rows}
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/stage{n}")
        docs = spark.read.parquet(f"{path}/stage{n}")
        if n < 4:
            assert sorted(docs.columns) == sorted(stages.COLUMNS)
        seen.append(docs.collect())
    kept = {r["doc_id"] for r in seen[0]}
    toxic = {i for i, t in text.items() if set(t.split()) & set(BAD)}
    assert len(kept & toxic) <= 2 and len((set(text) - toxic) - kept) == 0
    assert all(r["text"] == dict((i, t) for i, t, *_ in rows)[r["doc_id"]] for r in seen[0])

    once = [r["doc_id"] for r in seen[1]]
    assert len(once) == len(set(once)) and set(once) == kept - {1000 + k for k in range(5)} and 1 in once

    redacted = {r["doc_id"]: r for r in seen[2]}
    assert set(redacted) == set(once)
    assert redacted[2000]["text"] == "my [assign] is here with enough words to stay" and redacted[2000]["n_chars"] == len(redacted[2000]["text"])
    assert all(redacted[i]["text"] == text[i] for i in redacted if i != 2000)

    words = {i: len(WORD.findall(r["text"] or "")) for i, r in redacted.items()}
    taken = {}
    for r in seen[3]:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["text"].strip() in redacted[r["doc_id"]]["text"]
    assert all(n <= 3 * words[i] for i, n in taken.items())
    want = {r["doc_id"]: r["taken"] for r in mixing.taken_words(spark.read.parquet(f"{path}/stage2"), block=256).collect()}
    assert taken == {i: n for i, n in want.items() if n}

    digests = sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in seen[3])
    assert sorted(r["decoded_sha256"] for r in seen[4]) == digests
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in seen[4])


def test_run_gives_the_rows_of_the_last_stage(spark, corpus):
    path, _ = corpus
    got = corpus_pipeline.run(spark, path)
    assert {"doc_id", "n_tokens", "token_ids"} <= set(got.columns) and got.count() > 100


def test_run_on_empty_documents(spark, corpus, tmp_path):
    path, _ = corpus
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {q for q in names if q.startswith("op") or q == "pipeline"} == {*queries.QUERIES, "pipeline"} and len(queries.QUERIES) == 13
    assert set(queries.ORACLES) <= set(queries.QUERIES)
