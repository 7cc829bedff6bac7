"""Every registered dataflow query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from rillflow.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir="/root/testdata/sf0.001"):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, sf, db, name):
    df = catalog.queries()[name](spark, sf)
    got = df.collect()
    if name not in catalog.oracle_sql():
        assert got
        return
    want = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
