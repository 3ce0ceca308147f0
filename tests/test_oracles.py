"""Every query with a SQL twin gives the twin's rows on the smallest tables; the others give rows."""

from __future__ import annotations

import pytest

from aspectra.plans import catalogue
from aspectra.plans.verify import TABLES, compare


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf, name):
    said = compare(spark, duck, name, catalogue.queries()[name], catalogue.oracle_sql().get(name), sf)
    assert said.startswith(("ok", "rows")), said
