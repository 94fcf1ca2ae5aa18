"""Every named query over empty tables, and over tables with rows of nothing but nulls, repeated rows and columns of clashing names."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = os.environ.get("LOREKEEP_TESTDATA", "/root/testdata/sf0.001")
#: Names that queries use for columns of their own.
CLASHING = ["pos", "n", "h", "x", "w", "k", "kind", "label", "slice", "sim", "shard", "part", "similarity", "canonical_id", "valid_to", "_n", "_part"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {name: tmp_path_factory.mktemp(name) for name in ("empty", "nulls")}
    for path in glob.glob(f"{DATA}/*.parquet"):
        name, rows = os.path.basename(path), spark.read.parquet(path)
        rows.limit(0).write.parquet(f"{made['empty']}/{name}")
        some = rows.limit(4)
        null = spark.createDataFrame([tuple([None] * len(rows.columns))], rows.schema)
        more = some.unionByName(some.limit(1)).unionByName(null).unionByName(null)
        for column in CLASHING:
            if column not in more.columns:
                more = more.withColumn(column, F.lit("clash"))
        more.coalesce(1).write.parquet(f"{made['nulls']}/{name}")
    return made


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_runs(spark, folders, name, kind):
    assert entry.queries()[name](spark, str(folders[kind])).count() >= 0
