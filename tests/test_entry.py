"""The catalogue against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from engramix.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["kg_upsert", "conflict_competing", "decay_edges", "reinforce_edges", "transitive_depends_on", "salient_chunks", "bm25_top5", "rrf_merge", "graph_facts_routed", "insights_list", "session_activity"])
def test_matches_oracle(spark, con, name):
    a = catalog.QUERIES[name](spark, DIR).toPandas()
    b = con.sql(catalog.ORACLES[name]).df()
    key = sorted(a.columns)
    rows = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in d[key].astype(object).itertuples(index=False))
    assert key == sorted(b.columns) and rows(a) == rows(b)


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
