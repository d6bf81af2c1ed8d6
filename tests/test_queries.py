"""Every registered query of the library against its SQL twin in DuckDB."""

import decimal
import os

import duckdb
import pytest

from pixelloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    found = duck.execute(catalog.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())


@pytest.mark.parametrize("name", ["numa_windowed_stats", "numa_windowed_median", "numa_dilate", "numa_deltas", "numa_partial_sums", "numa_crossings", "numa_rank_value", "numa_equal_population_bins", "numa_peaks", "numa_open"])
def test_small_chunks(spark, duck, name, monkeypatch):
    """Arrays cut into many chunks, and ranks into few bins, give the same."""
    from pixelloom.operators import sequences

    monkeypatch.setattr(sequences, "CHUNK", 16)
    monkeypatch.setattr(sequences, "BINS", 3)
    test_matches_sql(spark, duck, name)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
