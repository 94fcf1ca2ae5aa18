"""Writes as merges, with hand-made frames."""

import json

import pytest

from lorekeep.operators import evaluation, merges


def test_upsert_and_guards(spark):
    stored = spark.createDataFrame([("1", "k", "a", "old", None, "t0"), ("2", "k", "b", "old", "gone", "t0"), ("3", "k", "c", "old", None, "t0")], "id string, client string, key string, content string, deleted_at string, created_at string")
    batch = spark.createDataFrame([("k", "a", "new", "t1"), ("k", "b", "new", "t1"), ("k", "d", "new", "t1"), (None, "e", "new", "t1")], "client string, key string, content string, created_at string")
    got = {(r.key, r.id): (r.content, r.action, r.created_at) for r in merges.upsert(stored, batch, ["client", "key"]).collect()}
    assert got == {("a", "1"): ("new", "update", "t0"), ("b", "2"): ("old", "guarded", "t0"), ("c", "3"): ("old", None, "t0"), ("d", None): ("new", "insert", "t1"), ("e", None): ("new", "insert", "t1")}
    assert {r.key for r in merges.without_stale(stored, batch, "client", ["key"]).collect()} == {"a", "b"}
    assert merges.upsert(stored.limit(0), batch.limit(0), ["client", "key"]).count() == 0


def test_first_of_a_batch(spark):
    kind = "key string, ident string, at int"
    stored, batch = spark.createDataFrame([("k1", "i1", 0)], kind), spark.createDataFrame([("k1", "i9", 1), ("k2", "i1", 2), ("k3", "i3", 3), ("k3", "i4", 4), ("k5", "i3", 5), ("k6", None, 6), ("k7", None, 7)], kind)
    got = {(r.key, r.at): r.outcome for r in merges.insert_new(stored, batch, [["key"], ["ident"]], ["at"]).collect()}
    assert got == {("k1", 1): "stored", ("k2", 2): "stored", ("k3", 3): "inserted", ("k3", 4): "repeated", ("k5", 5): "repeated", ("k6", 6): "inserted", ("k7", 7): "repeated"}


def test_patches(spark):
    stored = spark.createDataFrame([("1", ["x"], "{}", 3, None), ("2", ["x"], "{}", 3, None), ("3", ["x"], "{}", 3, "gone"), ("4", ["x"], "{}", 3, None)], "id string, tags array<string>, metadata string, revision int, deleted_at string")
    patches = spark.createDataFrame([("1", 3, ["tags"], ["y", "z"], "ignored"), ("2", 2, ["tags"], ["y"], None), ("3", 3, ["tags"], ["y"], None), ("4", 3, ["metadata"], None, None)], "id string, expected_revision int, present array<string>, tags array<string>, metadata string")
    got = {r.id: (r.tags, r.metadata, r.revision, r.outcome) for r in merges.patch(stored, patches, ["tags", "metadata"]).collect()}
    assert got == {"1": (["y", "z"], "{}", 4, "patched"), "2": (["x"], "{}", 3, "conflict"), "3": (["x"], "{}", 3, "conflict"), "4": (["x"], None, 4, "patched")}


def test_registrations(spark):
    kind = "client string, name string, model string, metadata string, last_seen_at int"
    stored = spark.createDataFrame([("c", "a", "m1", '{"x": 1, "y": {"z": [1]}}', 5), ("c", "b", "m1", "{}", 5)], kind)
    batch = spark.createDataFrame([("c", "a", None, '{"x": "2", "n": null}', 4), ("c", "new", "m2", '{"q": true}', 4)], kind)
    got = {r.name: (r.model, r.metadata and json.loads(r.metadata), r.last_seen_at) for r in merges.register(stored, batch, ["client", "name"]).collect()}
    assert got == {"a": ("m1", {"x": "2", "y": {"z": [1]}, "n": None}, 5), "b": ("m1", {}, 5), "new": ("m2", {"q": True}, 4)}


def test_snapshots(spark):
    kind = "id string, content string, metadata string"
    old = spark.createDataFrame([("1", "a", '{"m": {"id": 1, "x": 2}, "b": 1}'), ("2", "a", None), ("3", None, "{}"), ("4", "a", "{}")], kind)
    new = spark.createDataFrame([("1", "a", '{"b": 1, "m": {"x": 2, "id": 9}}'), ("2", "b", None), ("3", None, "{}"), ("5", "a", "{}")], kind)
    got = {r.id: (r.same, r.keep_vector) for r in merges.snapshot_compare(old, new, ["id"], ["content", "metadata"], ("m.id", "absent.path")).collect()}
    assert got == {"1": (True, True), "2": (False, False), "3": (True, True)}


def test_judgements(spark):
    records = spark.createDataFrame([("1", "k1"), ("2", "k2"), ("3", "k2"), ("4", None)], "id string, source_key string")
    judged = spark.createDataFrame([("c", "k1", None), ("c", "k2", None), ("c", "k9", None), ("d", None, "4"), ("d", None, "9")], "case_id string, source_key string, id string")
    got = {(r.case_id, r.label): (r.state, r.id) for r in evaluation.resolve(judged, records).collect()}
    assert got == {("c", "k1"): ("resolved", "1"), ("c", "k2"): ("ambiguous", None), ("c", "k9"): ("missing", None), ("d", "4"): ("resolved", "4"), ("d", "9"): ("missing", None)}
    with pytest.raises(Exception, match="ambiguous"):
        evaluation.resolve(judged, records, strict=True).collect()
    twice = spark.createDataFrame([("c", "k1", None), ("c", None, "1")], "case_id string, source_key string, id string")
    with pytest.raises(Exception, match="ambiguous"):
        evaluation.resolve(twice, records, strict=True).collect()
    results = spark.createDataFrame([("c", x, i) for i, x in enumerate("xyz1", 1)] + [("e", "q", 1)], "case_id string, id string, pos int")
    relevant, cases = spark.createDataFrame([("c", "1"), ("c", "y"), ("e", "1")], "case_id string, id string"), spark.createDataFrame([("c", 3, False), ("e", 1, False), ("f", 1, True)], "case_id string, n_judged int, diagnostic boolean")
    got = {r.case_id: (r.recall, r.reciprocal_rank, r.hit, r.first_rank) for r in evaluation.case_metrics(results, relevant, cases, 3).collect()}
    assert got == {"c": (1 / 3, 0.5, True, 2), "e": (0.0, 0.0, False, None), "f": (None,) * 4}


def test_comparable_reports():
    one = {"dataset_hash": evaluation.stable_hash({"b": 1, "a": [2]}), "model": "m"}
    assert evaluation.stable_hash({"a": [2], "b": 1}) == one["dataset_hash"] and evaluation.baseline_mismatches(one, dict(one)) == []
    assert evaluation.baseline_mismatches(one, one | {"model": "n", "as_of": "x"}) == ["as_of", "embedding model"]
