"""Every registered query is well formed, and a few agree with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from timeweave.plans import registry
from timeweave.sources.fixtures import BASE

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["c6_overlap_join", "w1_speaker_turns", "f2_keyword_candidates", "d3_stage_statuses"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.sql(registry.ORACLES[name]).df()[list(got.columns)]
    key = lambda rows: sorted(map(repr, [[float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r] for r in rows]))
    assert key(got.astype(object).where(got.notna(), None).itertuples(index=False, name=None)) == key(want.astype(object).where(want.notna(), None).itertuples(index=False, name=None))
