"""Registered queries run on the smallest data set; those with SQL match it."""

import duckdb
import pytest

import __spark_entry__ as E
from stormcell.llm.queries import ORACLE, QUERIES
from tests.conftest import SF001

TABLES = ["documents", "pages", "benchmark", "embeddings", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    got = E.queries()[name](spark, SF001)
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


CONTRACT = {
    "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op6_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op10_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(spark, name):
    got = E.queries()[name](spark, SF001)
    assert [tuple(c.split()) for c in CONTRACT[name].split(", ")] == got.dtypes
    assert got.count() > 0


def test_entry_registers_all():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
