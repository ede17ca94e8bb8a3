"""Every registered query with SQL gives the same rows there, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_point
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    text, good = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert good, text


@pytest.mark.parametrize("name", ["append_existing_dedup", "feed_ingest", "hash_embed", "model_summary"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
