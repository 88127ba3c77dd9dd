"""Every registered query at the smallest scale: against its oracle, or for rows."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, oracle_connection

FOLDER = os.environ.get("QUIRE_TESTDATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_every_document_has_audit_evidence(spark):
    got = {r.paper_id: r for r in QUERIES["e_audit_inputs_whole"](spark, FOLDER).select("paper_id", "context", "reason").collect()}
    documents = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("trim(text) <> ''").select("doc_id").collect()}
    assert all(got[i].context is not None for i in documents)
    assert any(r.reason is not None for r in got.values())
