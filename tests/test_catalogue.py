"""Each query against its SQL, over whole tables."""

import os

import duckdb
import pytest

from sparkassay.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def table(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(map(str, pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    assert table(catalogue.QUERIES[name](spark, SF).toPandas()) == table(con.execute(catalogue.SQL[name]).fetchdf())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, SF).collect()
