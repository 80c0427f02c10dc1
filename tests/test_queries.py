"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from palimpsest.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def over(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return over(SF)


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return str(value.tz_localize(None) if value.tzinfo else value)
    if hasattr(value, "item"):
        value = value.item()
    return float(f"{value:.8g}") if isinstance(value, float) else value


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["q235_entity_clusters", "q160_prune_counts", "q177_sheaf_contradictions", "q115_merge_log", "q140_code_search"])
def test_larger_tables(spark, name):
    """Queries whose bounds the smallest tables do not reach."""
    sf = SF.replace("0.001", "0.01")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), over(sf).sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert rows(got) == rows(want)
