"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from inkfield.plans import catalog, naming, stored  # noqa: F401

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "None"
        return f"{float(v):.5f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_names_are_unique_and_known():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
