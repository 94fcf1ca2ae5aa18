import pytest

from lorekeep.operators import clustering


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)], "a_id string, b_id string")
    assert {(r.id, r.component) for r in clustering._connected(chain).collect()} == {(f"n{i:03d}", "n000") for i in range(151)}
    with pytest.raises(RuntimeError):
        clustering._connected(chain, 2)
