import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lorekeep.plans import registry

DATA = os.environ.get("LOREKEEP_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, oracle, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    result = oracle.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
