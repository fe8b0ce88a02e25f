"""Every registered query with a SQL twin gives the twin's rows."""

import datetime
import decimal

import duckdb
import pytest

from tomeline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return v


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def same_rows(df, relation):
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    at = [relation.columns.index(c) for c in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, sf, db, name):
    same_rows(registry.QUERIES[name](spark, sf), db.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_do_not_depend_on_how_they_are_dealt(spark, sf, name):
    """Queries without a twin: some rows, and the same ones over one partition and over seven."""
    rows = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = registry.QUERIES[name](spark, sf)
            rows.append(sorted(str([plain(v) for v in r]) for r in df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] and rows[0] == rows[1]
