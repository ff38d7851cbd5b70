"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import os

import pytest
from pandas.api.types import is_bool_dtype, is_numeric_dtype

from citeweave import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows_of(frame):
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        if is_numeric_dtype(out[c]) and not is_bool_dtype(out[c]):
            out[c] = out[c].astype("float64").round(9)
    text = out.astype(str).replace({"None": "nan", "NaN": "nan", "<NA>": "nan", "NaT": "nan"})
    return sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    got, want = catalog.queries()[name](spark, FOLDER).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
