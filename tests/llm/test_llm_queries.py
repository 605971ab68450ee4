"""The registered queries over the smallest tables: whole results with the contract's columns."""

import duckdb
import pytest

from tallyloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op6_personal": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_suffixes": {"doc_id": "bigint", "from_word": "int", "to_word": "int", "n_words": "int"},
    "op10_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op11_language": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op12_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op13_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_every_document(spark, name):
    got = QUERIES[name](spark, SF)
    kinds = dict(got.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    ids = [r[0] for r in rows]
    if name == "op10_neighbours":
        assert len(rows) == 25 * 20 and set(ids) == {i for i in range(500) if i % 20 == 0}
    elif name == "op13_negatives":
        assert len(rows) == len({(r[0], r[1], r[2]) for r in rows}) > 0 and all(i % 50 == 0 for i in ids)
    elif name != "op9_suffixes":
        assert set(ids) == {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
        assert name == "op8_packing" or len(ids) == len(set(ids))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    by = lambda d: sorted(map(tuple, d[sorted(d.columns)].fillna(-1).values.tolist()))
    assert by(got) == by(want)
