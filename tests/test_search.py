"""The search entry with hand-made records and expectations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep import search
from lorekeep.operators import chunks, nearpairs

SPACE = search.Space("p", "m", 2)
NOW = dt.datetime(2026, 3, 1)
KIND = """id string, content string, namespace string, access_level string, embedding array<float>, embedding_provider string, embedding_model string, embedding_dimensions int, tags array<string>, metadata string, source string,
    created_at timestamp_ntz, event_at timestamp_ntz, expires_at timestamp_ntz, deleted_at timestamp_ntz, superseded_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, consolidated_into_id string,
    relevance_base_score double, decay_rate double, accessed_at timestamp_ntz, access_count int"""
NAMES = [x.split()[0] for x in KIND.replace("\n", " ").split(",")]


def record(id, content="", vector=None, **more):
    row = {"id": id, "content": content, "namespace": "work", "embedding": vector, "created_at": NOW, "event_at": NOW, "valid_from": dt.datetime(2025, 1, 1), "source": "chat", "tags": ["x"], "metadata": "{}"}
    row |= {"embedding_provider": "p", "embedding_model": "m", "embedding_dimensions": 2} if vector else {}
    return tuple((row | more).get(n) for n in NAMES)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        record("a", "the vault of tickets", [1.0, 0.0]),
        record("b", "nothing", [0.8, 0.6]),
        record("c", "ticket in a far and long text about another vault", [0.0, 1.0], access_level="sensitive"),
        record("d", "ticket vault", None, namespace="my-life"),
        record("e", "ticket vault", [1.0, 0.0], deleted_at=NOW),
        record("f", "ticket vault", [1.0, 0.0], expires_at=NOW),
        record("g", "ticket vault", [1.0, 0.0], access_level="secret"),
        record("h", "ticket vault", [1.0, 0.0], access_level="odd"),
        record("i", "old ticket vault", [1.0, 0.0], superseded_at=NOW, valid_to=dt.datetime(2025, 6, 1)),
        record("j", "part ticket vault", [1.0, 0.0], consolidated_into_id="a"),
        record("k", None, [0.0, 0.0]),
        record("l", "other", [1.0, 0.0, 0.0]),
    ]
    return spark.createDataFrame(rows + rows[:3] * 2, KIND)


def ask(**more):
    return search.Request(**({"text": "ticket vault", "vectors": {SPACE: [1.0, 0.0]}, "allowed": ("work", "my-life"), "ceiling": "sensitive"} | more))


def ids(found):
    return [r.id for r in found.collect()]


def test_rank_by_scope_level_and_lifecycle(frame):
    found = search.rank(frame, ask(), search.share_of_terms).collect()
    assert [r.id for r in found] == ["i", "c", "a", "b"]  # 'tickets' isn't 'ticket' without stems
    top = found[0]
    assert top.sim == 1.0 and top.text_score == pytest.approx(2 / 3) and top.relevance == 1.0 and top.final_score == pytest.approx(0.3 + 0.7 * 2 / 3 + 2)
    assert found[2].final_score == pytest.approx(0.3) and found[3].final_score == pytest.approx(0.24)
    stemmed = {r.id: r.text_score for r in search.rank(frame, ask()).collect()}
    assert stemmed["a"] > stemmed["c"] > 0 and stemmed["i"] > stemmed["c"]
    assert ids(search.rank(frame, ask(ceiling="normal", threshold=0.9), search.share_of_terms)) == ["i", "a"]
    assert ids(search.rank(frame, ask(requested=("my-life", "nowhere")), search.share_of_terms)) == ["d"]
    assert ids(search.rank(frame, ask(requested=("nowhere",)))) == [] == ids(search.rank(frame.limit(0), ask()))
    assert ids(search.rank(frame, ask(ceiling="odd"))) == []
    assert ids(search.rank(frame, ask(superseded_factor=0.1), search.share_of_terms))[-1] == "b" and ids(search.rank(frame, ask(superseded_factor=0.01), search.share_of_terms))[0] == "c"


def test_history_and_filters(spark, frame):
    at = lambda x, **m: set(ids(search.rank(frame, ask(filters=search.Filters(valid_at=x)), search.share_of_terms, **m)))
    assert {"i", "j"} <= at("2025-05-31 23:00:00") and "i" not in at("2025-06-01 00:00:00") and at("2024-12-31 00:00:00") == set()
    parts = spark.createDataFrame([("j", dt.datetime(2025, 2, 1), dt.datetime(2025, 4, 1))], "member_id string, consolidated_at timestamp_ntz, deconsolidated_at timestamp_ntz")
    assert "j" not in at("2025-03-01 00:00:00", memberships=parts) and "j" in at("2025-04-01 00:00:00", memberships=parts)
    rows = [record(str(n), "ticket vault", tags=["p", "q"][: n + 1], metadata=f'{{"service": "s{n}"}}', event_at=dt.datetime(2025, 1, 1 + n, 12), source=f"s{n}") for n in range(3)]
    some = spark.createDataFrame(rows, KIND)
    by = lambda **f: set(ids(search.rank(some, ask(vectors={}, filters=search.Filters(**f)), search.share_of_terms)))
    assert by(tags=("q", "q")) == {"1", "2"} and by(services=("s0", "s2")) == {"0", "2"} and by(services=("s0",), tags=("q",)) == set()
    assert by(event_before="2025-01-02") == {"0", "1"} and by(event_before="2025-01-02 11:00:00") == {"0"} and by(event_after="2025-01-02 12:00:00") == {"1", "2"}
    assert by(source="s1") == {"1"} and by(created_after="2026-03-02 00:00:00") == set() and by(created_before="2026-03-01 00:00:00") == {"0", "1", "2"}


def test_pools_limits_and_entries(spark, frame):
    visible = search.eligible(frame, ask())
    near = search.vector_candidates(visible, SPACE, [1.0, 0.0], 1).collect()
    assert {(r.id, r.pool) for r in near} == {("a", False), ("i", True)}  # one of each pool, each once
    assert search.space_present(visible, SPACE) and not search.space_present(visible, search.Space("p", "other", 2))
    assert [r.id for r in search.bounded_text_search(visible, "ticket vault", 500, scorer=search.share_of_terms).collect()] == ["c"]
    assert search.bounded_text_search(visible, "  ", 5).count() == 0 == search.bounded_text_search(visible, "ticket", 0).count()
    with pytest.raises(ValueError):
        search.bounded_text_search(visible, "x" * 8193, 5)
    with pytest.raises(ValueError):
        search.vector_candidates(visible, SPACE, [1.0, math.nan], 1)
    for bad in ({"vector_weight": -1}, {"vector_weight": 0, "text_weight": 0}, {"relevance_cap": 0}, {"text_bonus": math.inf}, {"most_results": 0}, {"text_candidates": 1001}, {"vector_candidates": 1.5}):
        with pytest.raises(ValueError):
            search.Ranking(**bad)
    assert search.scope((), ("a", "my-life")) == ["a"] and search.scope(("my-life", "z"), ("a", "my-life")) == ["my-life"]
    events = search.access_events(search.rank(frame, ask(limit=1), search.share_of_terms), "2026-03-01 00:00:00").collect()
    assert [(r.id, r.times) for r in events] == [("i", 1)]


def test_fusion(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, pos int")
    two = spark.createDataFrame([("c", 1), ("b", 2)], "id string, pos int")
    assert [(r.id, r.provider) for r in search.fuse([one, two], 3).collect()] == [("b", 0), ("a", 0), ("c", 1)]


def test_chunks_of_parents(spark):
    parents = spark.createDataFrame([("p", "n", 1), ("q", "n", 1), ("r", "n", 2), ("s", "o", 1)], "id string, namespace string, revision int")
    manifests = spark.createDataFrame([("p", 1, 2, "h1", True), ("q", 1, 1, "h2", True), ("r", 1, 1, "h3", True), ("s", 1, 1, "h2", True)], "parent_id string, source_revision int, chunk_count int, source_sha256 string, is_current boolean")
    parts = spark.createDataFrame([("p", 0, [1.0, 0.0]), ("p", 1, [0.0, 1.0]), ("q", 0, [0.6, 0.8]), ("r", 0, [0.0, 1.0]), ("s", 0, [0.6, 0.8])], "parent_id string, ordinal int, embedding array<float>")
    whole = chunks.complete_parents(parents, manifests, parts)
    assert {r.id: r.complete for r in whole.collect()} == {"p": True, "q": True, "r": False, "s": True}  # r's manifest is of an older revision
    assert {r.namespace: r.ready for r in chunks.scope_ready(whole, ["namespace"]).collect()} == {"n": False, "o": True}
    asked = spark.createDataFrame([("x", [0.0, 1.0]), ("x", [1.0, 0.0])], "query_id string, vector array<double>")
    assert chunks.parent_scores(asked, whole, parts).count() == 0  # all or nothing
    for exact in (True, False, None):
        got = chunks.parent_scores(asked, whole.where("complete"), parts, k=2, exact=exact).orderBy("pos").collect()
        assert [(r.parent_id, round(r.similarity, 6)) for r in got] == [("p", 1.0), ("q", 0.8)]
    assert chunks.parent_scores(asked, whole.where("complete"), parts, least=0.9).count() == 1 and chunks.exact_suffices(whole)
    again = spark.createDataFrame([("p", 0, [1.0, 0.0]), ("p", 1, [0.0, 1.0]), ("q", 0, [1.0, 0.0]), ("t", 0, [1.0, 0.0]), ("t", 1, [0.0, 1.0]), ("u", 0, [1.0, 0.01])], "parent_id string, ordinal int, embedding array<float>")
    olds = spark.createDataFrame([(x, "n", 1) for x in "pqtu"], "id string, namespace string, revision int")
    known = spark.createDataFrame([("p", 1, 2, "h", True), ("q", 1, 1, "g", True), ("t", 1, 2, "h", True), ("u", 1, 1, "f", True)], "parent_id string, source_revision int, chunk_count int, source_sha256 string, is_current boolean")
    found = {(r.a_id, r.b_id) for r in chunks.duplicates(olds, known, again, 0.95).collect()}
    assert found == {("q", "u"), ("u", "q"), ("p", "t"), ("t", "p")}  # a paragraph in common isn't enough


def test_parts_lose_nothing(spark):
    x = np.random.default_rng(1).normal(size=(90, 4)).astype(np.float32)
    rows = [(f"{i:03d}", "n", x[i].tolist(), i % 5 == 0) for i in range(90)]
    frame = spark.createDataFrame(rows + rows[:9], "id string, namespace string, embedding array<float>, q boolean")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {(f"{i:03d}", f"{j:03d}") for i, j in np.argwhere(unit @ unit.T >= 0.7) if i != j}
    for asks, want in (("true", near), ("q", {(a, b) for a, b in near if int(a) % 5 == 0})):
        out = nearpairs.near_pairs(frame, ["namespace"], 0.7, asks, part=16).collect()
        assert len(out) == len(want) and {(r.a_id, r.b_id) for r in out} == want
    sims = np.round(unit.astype(float) @ unit.astype(float).T, 9)
    np.fill_diagonal(sims, -2)
    want = {(f"{i:03d}", f"{j:03d}") for i in range(0, 90, 5) for j in np.argsort(-sims[i], kind="stable")[:6]}
    assert {(r.a_id, r.b_id) for r in nearpairs.near_top(frame, ["namespace"], 6, "q", part=16).collect()} == want


def test_no_whole_rows_are_shuffled(frame):
    plan = search.vector_candidates(search.eligible(frame, ask()), SPACE, [1.0, 0.0], 50)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "embedding" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert F is not None
