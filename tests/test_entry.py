"""The driver's contract: names, SQL of registered queries only, and a sample compared with DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", ["vault_page", "isbn_extract", "classify_topic", "search_rank", "dork_primary", "token_bucket", "zipf_coverage", "catalog_upsert", "glyph_roundtrip"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    f = lambda rows: sorted(repr([round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in rows)
    got = entry.queries()[name](spark, D).select(*cols).collect()
    assert f(map(tuple, got)) == f(want.fetchall())


def test_entry_runs(spark):
    if os.path.isdir(D):
        assert entry.entry(spark).count() > 0
