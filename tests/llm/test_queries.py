"""Registered queries of the package against their DuckDB statements, and the shape of the others."""

import duckdb
import pytest

from tests.test_checks import SF, TABLES, norm
from touchline.llm import queries

WITHOUT_SQL = {
    "op1_multiprobe_search": {"query_id", "rank", "vec_id", "score"}, "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op6_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op7_source_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op9_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op11_histogram_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op13_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_statement(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    assert norm([tuple(r) for r in got.select(*cols).collect()]) == norm(want)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(got.columns) == WITHOUT_SQL[name]
    rows = got.collect()
    if "doc_id" in got.columns:
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if "predicted" in got.columns:
        limit = 0.7 if name == "op3_quality" else 0.5
        assert all(r["predicted"] == int(r["score"] >= limit) and 0 <= r["score"] <= 1 for r in rows)
