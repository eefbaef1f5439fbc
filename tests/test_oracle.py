"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tracery.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if isinstance(v, np.ndarray):
            return str(list(v))
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    ours = catalogue.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    floats = [c for c in ours.columns if (ours[c].dtype.kind == "f") != (theirs[c].dtype.kind == "f")]
    for c in floats:
        ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    assert rows(ours) == rows(theirs)


def test_queries_without_sql_run(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, SF).count() > 0
