"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from threadlake import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    text = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return sorted(tuple(map(_plain, r)) for r in text.itertuples(index=False))


def _plain(x):
    if x is None:
        return ""
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.9g}" if float(x) != int(float(x)) else str(int(x))
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()
