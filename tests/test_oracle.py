"""Every registered query against its SQL on the smallest tables."""
import pytest
from compare import check, connect

import __spark_entry__ as entry_module

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()
SLOW = {"e13_staged_retrieval", "e_answer_context", "j1_ingest_stream", "f5_near_duplicates"}    # covered by their own tests


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, sf_dir, name):
    ok, message, _ = check(spark, con, QUERIES[name], ORACLE.get(name), sf_dir)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
