import datetime as dt

from lorekeep.operators import memberships as M


def test_apply_and_restore(spark):
    none = spark.createDataFrame([], "membership_id string, canonical_id string, member_id string, fingerprint string, consolidated_at timestamp_ntz, deconsolidated_at timestamp_ntz")
    groups = lambda *x: spark.createDataFrame(list(x), "canonical_id string, member_id string, fingerprint string")
    one = M.apply(none, groups(("C", "a", "fa"), ("C", "b", "fb"), ("D", "d", "fd")), "2025-01-01 00:00:00")
    two = M.apply(one, groups(("E", "b", "fb"), ("E", "x", "fx"), ("F", "C", "fc"), ("G", "y", "fy")), "2025-02-01 00:00:00")
    assert {(r.canonical_id, r.member_id) for r in M.open_members(two).collect()} == {("C", "a"), ("C", "b"), ("D", "d"), ("G", "y")}  # E and F hold busy members
    current = spark.createDataFrame([("a", "fa"), ("b", "changed"), ("d", "fd")], "id string, fingerprint string")
    three, refused = M.restore(two, spark.createDataFrame([("C",), ("D",)], "canonical_id string"), current, "2025-03-01 00:00:00")
    assert [r.canonical_id for r in refused.collect()] == ["C"]
    assert {(r.member_id, r.deconsolidated_at) for r in three.collect()} == {("a", None), ("b", None), ("y", None), ("d", dt.datetime(2025, 3, 1))}
    again = M.apply(three, groups(("H", "d", "fd")), "2025-04-01 00:00:00")
    assert again.where("member_id = 'd'").count() == 2


def test_fingerprints(spark):
    frame = spark.createDataFrame([("a", None), ("a", ""), ("", "a"), ("a;1:b", None)], "x string, y string")
    assert frame.select(M.fingerprint("x", "y")).distinct().count() == 4
