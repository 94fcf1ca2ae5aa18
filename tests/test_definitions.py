"""Named queries over small hand-made tables, with expectations that don't come from their SQL."""

import datetime as dt
import hashlib

import pytest

import __spark_entry__ as entry
from lorekeep.plans import lifecycle
from lorekeep.plans.dialect import SPARK

EVENT = "id string, service string, source_id string, event_key string, service_id string, event_type string, title string, artist string, album string, show_title string, season int, episode int, release_year int, genres array<string>, duration_ms int, played_ms int, completed boolean, played_at timestamp_ntz, metadata string, client_id string, memory_id string, namespace string, created_at timestamp_ntz"
MEMORY = """id string, content string, embedding array<float>, embedding_provider string, embedding_model string, embedding_dimensions int, source string, source_key string, namespace string, origin_namespace string, tags array<string>, metadata string, access_level string, client_id string,
    agent_id string, session_id string, created_at timestamp_ntz, updated_at timestamp_ntz, accessed_at timestamp_ntz, event_at timestamp_ntz, expires_at timestamp_ntz, deleted_at timestamp_ntz, access_count int, relevance_base_score double, relevance_score double, decay_rate double, memory_kind string, valid_from timestamp_ntz, revision int"""


def frame(spark, kind, rows):
    names = [x.split()[0] for x in kind.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kind)


@pytest.fixture
def tables(spark, tmp_path):
    def write(**frames):
        for name, (kind, rows) in frames.items():
            frame(spark, kind, rows).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return lambda name: entry.queries()[name](spark, str(tmp_path)).collect()

    return write


def event(id, day, month=11, **more):
    at = dt.datetime(2025, month, day, 12)
    return {"id": id, "service": "spotify", "event_type": "play", "title": "t", "played_at": at, "created_at": at, "metadata": "{}", "client_id": "c", "namespace": "media", "event_key": id} | more


def test_taste(tables):
    rows = [event(f"p{i:02d}", 1 + i % 28, artist="A" if i < 18 else "B", genres=["Rock", "Rock"]) for i in range(20)]
    rows += [event(f"q{i:02d}", 1 + i % 28, 10, artist="A" if i < 10 else "C") for i in range(20)]
    rows += [event("none", 3, artist=" ", metadata='{"played_precision": "day"}'), event("video", 4, service="plex", event_type="watch", show_title="S", artist=None), event("other", 4, service="plex", event_type="ping"), event("far", 1, 6, artist="A")]
    ask = tables(media_events=(EVENT, rows + rows[:5]))  # some rows were delivered twice
    count = {(r.category, r.win, r.dimension, r.label): r.n for r in ask("taste_windows")}
    assert count["music", "period", "total", "events"] == 21 and count["music", "previous", "total", "events"] == 20 and count["music", "allTime", "total", "events"] == 42 == count["music", "days365", "total", "events"]
    assert count["music", "period", "genre", "Rock"] == 20 and count["music", "period", "entity", "A"] == 18 and count["viewing", "period", "entity", "S"] == 1
    assert count["music", "days30", "total", "events"] == 21 and count["music", "days90", "total", "events"] == 41 and ("viewing", "period", "entity", "t") not in count
    assert {(r.category, r.warning) for r in ask("taste_warnings")} == {("music", "approximate_timestamps:1"), ("music", "missing_entity:1"), ("music", "single_service"), ("viewing", "single_service")}
    facts = [r.statement for r in sorted(ask("taste_trends"), key=lambda r: r.fact) if r.category == "music"]
    assert facts[0] == "21 accepted music events occurred in 2025-11." and facts[-1] == "Quality warning: single_service."
    trends = [x for x in facts if "creased" in x]
    assert trends == ["A increased from 10 of 20 accepted events in the previous month to 18 of 21 in 2025-11."]  # B has no earlier count, C no later one
    assert "A was the leading artist in the trailing 30 days with 18 accepted events." in facts


def test_duplicates_and_identity(tables):
    same = {"service_id": "x", "artist": "A"}
    rows = [event("1", 1, **same), event("2", 1, **same, title="other"), event("1", 1, **same), event("3", 1, artist=None, episode=1), event("4", 1, artist=None, episode=2), event("5", 1, artist="", episode=1), event("6", 1, artist=None, episode=1, service_id=" ")]
    ask = tables(media_events=(EVENT, rows))
    assert [(r.identity, r.group_size) for r in ask("event_duplicates")] == [("fallback:v1:" + hashlib.sha256(b"v1;V4:play;V1:t;N;N;N;N;V1:1;N;N;").hexdigest(), 2), ("id:x", 2)]
    identity = {r.id: r.identity for r in ask("event_identity")}
    assert identity["3"] == identity["6"] == "fallback:v1:" + hashlib.sha256(b"v1;V4:play;V1:t;N;N;N;N;V1:1;N;N;").hexdigest()
    assert len({identity[i] for i in "1345"}) == 4 and identity["1"] == identity["2"] == "id:x"


def test_upserts(tables):
    late = dt.datetime(2025, 11, 5)
    rows = [event("old", 1, 10, service_id="x", created_at=dt.datetime(2025, 10, 1)), event("again", 1, 10, service_id="x", created_at=late), event("new", 2, service_id="x", created_at=late), event("twice", 2, service_id="x", created_at=late + dt.timedelta(1)), event("other", 2, service_id="y", created_at=late)]
    assert {r.id: r.outcome for r in tables(media_events=(EVENT, rows))("event_upsert")} == {"again": "stored", "new": "inserted", "twice": "repeated", "other": "inserted"}


def test_retries(spark):
    ladder = [spark.sql(f"SELECT {lifecycle.ladder(str(n))}").first()[0] for n in range(8)]
    assert ladder == [60, 60, 300, 1800, 7200, 43200, 43200, 43200]
    assert spark.sql(f"SELECT {lifecycle.ladder('1', '900')}, {lifecycle.ladder('2', '10')}, {lifecycle.ladder('1', '999999')}").first()[:] == (900, 300, 43200)
    assert [spark.sql(f"SELECT {lifecycle.doubling(str(n))}").first()[0] for n in (0, 3, 9)] == [15, 120, 3600]


def test_document_states(spark):
    from lorekeep.plans.statistics import document_states

    rows = [("a", "ready", False, False), ("a", "deduplicated", False, False), ("a", None, True, False), ("b", "embedding_failed", False, False), ("b", "ready", False, False), ("c", "embedding_failed", False, False), ("c", "pending", False, False), ("d", "ready", False, True), ("e", None, False, False)]
    spark.createDataFrame([(d, s, v, dt.datetime(2025, 1, 1) if g else None, dt.datetime(2025, 1, 1)) for d, s, v, g in rows], "document_id string, status string, has_vector boolean, deleted_at timestamp_ntz, accepted_at timestamp_ntz").createOrReplaceTempView("hand_made_jobs")
    got = {r.document_id: r.state for r in spark.sql(document_states(SPARK, "hand_made_jobs")).collect()}
    assert got == {"a": "ready", "b": "embedding_failed", "c": "queued", "d": "queued", "e": "queued"}


def memory(id, angle, **more):
    import math

    at = dt.datetime(2025, 5, 1) + dt.timedelta(hours=int(id[1:] or 0) if id[1:].isdigit() else 0)
    return {"id": id, "content": f"text {id}", "embedding": [math.cos(angle), math.sin(angle)], "embedding_provider": "p", "embedding_model": "m", "embedding_dimensions": 2, "namespace": "n", "access_level": "normal", "memory_kind": "semantic", "client_id": f"c{id}", "created_at": at, "valid_from": at, "access_count": 0, "revision": 1} | more


def test_duplicates_of_records(tables):
    rows = [memory("a1", 0.0), memory("a2", 0.1, memory_kind="episodic"), memory("a3", 0.35), memory("a4", 0.01, namespace="o"), memory("a5", 0.02, access_level="sensitive"), memory("a6", 0.03, source_key="k"), memory("a7", 0.04, expires_at=dt.datetime(2030, 1, 1)), memory("a8", 0.05, embedding_model="z"), memory("a9", 0.0, deleted_at=dt.datetime(2025, 6, 1))]
    ask = tables(memories=(MEMORY, rows + rows[:2]))
    # clients don't matter; a6 and a7 look for a duplicate but are none; a3's nearest is a2
    assert {(r.a_id, r.b_id) for r in ask("nearest_duplicate")} == {("a1", "a2"), ("a2", "a1"), ("a3", "a2"), ("a6", "a1"), ("a7", "a1")}
    assert {(r.a_id, r.b_id) for r in ask("contradiction_candidates") if r.b_id == "a2"} == set()  # only claims are contradicted
    assert {(r.a_id, r.b_id) for r in ask("pairwise_sim")} == {("a1", "a3"), ("a1", "a7"), ("a3", "a7")}
    assert [(r.a_id, r.b_id, r.pos) for r in sorted(ask("similar_pairs"))] == [("a1", "a3", 2), ("a1", "a7", 3), ("a3", "a7", 2)]
    assert {(r.cluster_id, r.id) for r in ask("complete_link_clusters")} == {("a1", "a1"), ("a1", "a3"), ("a1", "a7")} and ask("cluster_violations")[0].violations == 0


def test_standing_queries(tables):
    ids = [f"s{i}" for i in range(400)]
    asks = [i for i in ids if int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % 50 == 0][:3]
    rows = [memory(asks[0], 0.0, client_id="k1", revision=3), memory(asks[1], 0.0, client_id="k2", revision=3), memory(asks[2], 0.0, client_id="off", revision=3)]
    rows += [memory("near", 0.1, client_id="k1"), memory("far", 1.5), memory("secret", 0.1, access_level="sensitive"), memory("else", 0.1, namespace="o")]
    keys = "id string, client_name string, namespaces array<string>, permissions array<string>, max_access_level string, enabled boolean, expires_at timestamp_ntz, requests_per_minute int"
    ask = tables(memories=(MEMORY, rows), api_keys=(keys, [{"id": "k1", "namespaces": ["n", "o"], "enabled": True}, {"id": "k2", "namespaces": ["n"], "enabled": True}, {"id": "off", "namespaces": ["n"], "enabled": False}]))
    got = {(r.subscription_id, r.memory_id) for r in ask("subscription_match")}
    # k1 excludes its own records, k2 has no access to the other namespace, a disabled key gets nothing
    assert got == {(asks[0], asks[1]), (asks[0], asks[2]), (asks[0], "else"), (asks[1], asks[0]), (asks[1], asks[2]), (asks[1], "near")}
    assert not any(r.truncated for r in ask("subscription_truncated"))
