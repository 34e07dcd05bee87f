"""Every query with a SQL twin gives the same rows in both engines."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from cartolake.plans import catalog
from cartolake.sources.tables import BASE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{round(float(x), 6):.6f}"
    if isinstance(x, list):
        return str([plain(y) for y in x])
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    return str(x)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(plain(v) for v in r) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toArrow()) == rows(duck.execute(catalog.oracle_sql()[name]).to_arrow_table())


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_seeded_sample(spark):
    assert catalog.queries()["sample_random"](spark, SF).count() == 20
