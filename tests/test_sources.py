"""Provider records, exports and watched files, with hand-made files."""

import datetime as dt
import json

import pytest
from pyspark.sql import types as T

from lorekeep.sources import feeds, importers, providers
from lorekeep.streaming import files, log


def one(frame):
    (row,) = frame.collect()
    return row.asDict()


def test_providers(spark):
    items = lambda *x: spark.createDataFrame([(json.dumps(i), "srv", "den") for i in x], "item string, server_id string, server_name string")
    track = {"uri": "u:1", "id": "1", "name": "Song", "artists": [{"id": "a1", "name": "A"}, {"id": "a2", "name": "B"}], "album": {"name": "Al", "release_date": "1999-04"}, "duration_ms": 9, "external_ids": {"isrc": "I"}}
    got = one(providers.spotify_events(items({"track": track, "played_at": "2024-05-01T10:00:00.250+02:00", "context": None})))
    assert (got["service_id"], got["artist"], got["album"], got["release_year"], got["duration_ms"], got["played_ms"], got["completed"]) == ("u:1", "A, B", "Al", 1999, 9, None, None)
    assert got["played_at"] == dt.datetime(2024, 5, 1, 8, 0, 0, 250_000) and json.loads(got["metadata"])["isrc"] == "I" and got["genres"] == []
    episode = {"ratingKey": "7", "type": "episode", "title": "Pilot", "grandparentTitle": "Show", "parentTitle": "Season 1", "index": 2, "parentIndex": 1, "duration": 5, "viewedAt": 86_400}
    rows = providers.plex_events(items(episode, episode | {"type": "track"}, episode | {"type": "movie", "year": 2000}, episode | {"viewedAt": 0}, {"title": "x"})).collect()
    assert [(r.event_type, r.show_title, r.season, r.episode, r.artist, r.album, r.release_year) for r in rows] == [("watch", "Show", 1, 2, None, None, None), ("play", None, None, None, "Show", "Season 1", None), ("watch", None, None, None, None, None, 2000)]
    assert rows[0].service_id == "srv:7" and rows[0].played_at == dt.datetime(1970, 1, 2) and rows[0].completed and rows[0].played_ms == 5
    video = {"videoId": "v", "title": "T", "artists": [{"name": "A", "id": None}, {"name": None, "id": "q"}], "duration": "1:02:03", "played": "2024-05-01T00:00:00Z"}
    rows = providers.ytmusic_events(items(video, video | {"duration": "x:1"}, video | {"duration_seconds": 61}, video | {"played": "yesterday"}, video | {"title": ""})).collect()
    assert [(r.artist, r.duration_ms) for r in rows] == [("A", 3_723_000), ("A", None), ("A", 61_000)] and json.loads(rows[0].metadata)["artist_ids"] == ["q"]


def test_message_trees(spark, tmp_path):
    node = lambda parent, kids, role=None, *parts: {"parent": parent, "children": kids, "message": role and {"author": {"role": role}, "content": {"parts": list(parts)}, "create_time": 1.5}}
    tree = {"r": node(None, ["s"]), "s": node("r", ["a", "z"], "system", "no"), "a": node("s", ["b"], "user", "one", {"image": 1}, "two"), "b": node("a", [], "assistant", " "), "z": node("s", [], "user", "other branch")}
    for name in ("conversations-10.json", "conversations-2.json", "conversations.json", "conversations-x.json"):
        (tmp_path / name).write_text(json.dumps([{"conversation_id": "c", "title": "t", "create_time": 1.0, "mapping": tree}]))
    found = importers.discover(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["conversations.json", "conversations-2.json", "conversations-10.json"]
    assert [(r.doc_id, r.turn, r.role, r.said, r.at) for r in importers.read_chat_export(spark, found).collect()] == [("c", 0, "user", "one\ntwo", 1.5)]
    with pytest.raises(Exception, match="allowed bytes"):
        importers.read_chat_export(spark, found, 10).collect()
    with pytest.raises(FileNotFoundError):
        importers.discover(spark, str(tmp_path / ".."))
    assert importers.walk("{}") == []


def test_message_pairs(spark, tmp_path):
    message = lambda sender, text, **m: {"uuid": f"m-{sender}", "sender": sender, "text": text, "created_at": "x"} | m
    (tmp_path / "p.json").write_text(json.dumps([{"uuid": "u", "name": "n", "chat_messages": [message("human", "q"), message("assistant", "", content=[{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}])]}, {"uuid": "v", "name": "n"}]))
    assert [(r.role, r.said, r.message_id) for r in importers.read_pair_export(spark, str(tmp_path / "p.json")).orderBy("turn").collect()] == [("user", "q", "m-human"), ("assistant", "a\nb", "m-assistant")]
    text = "\n\n".join(["a" * 600, "short", "b" * 300, "c" * 300])
    assert [len(x) for x in importers.paragraph_pieces(text)] == [902, 300]


def test_pages_of_cells():
    cell = lambda x: f'<div class="outer-cell"><div><div class="content-cell mdl-cell--6-col x">{x}</div><div class="content-cell mdl-cell--6-col">no</div></div></div>'
    answer = "<p>long &amp; <strong>bold</strong> " + "word " * 20 + "</p>"
    page = cell(f"Prompted&nbsp;hello<br>Mar 3, 2025, 12:05:06 AM UTC+02:00<br>{answer}") + cell("Other") + cell(f"Prompted x<br>Tomorrow<br>{answer}") + cell("Prompted y<br>Mar 3, 2025, 4:05:06 PM Z<br>short")
    good, late, short = importers.page_cells(page)
    assert good["at"] == "2025-03-02T22:05:06.000Z" and good["content"].startswith("Q: hello\n\nA: long & **bold** word") and good["source_key"].startswith("gemini-conv:v2:")
    assert late["failure"] == "time" and short["failure"] == "text"
    at = importers.page_instant
    assert at("Feb 29, 2024, 1:00:00 PM NZDT") == dt.datetime(2024, 2, 29, 0) and at("Feb 29, 2023, 1:00:00 PM Z") is at("Feb 1, 2024, 13:00:00 PM Z") is at("Fev 1, 2024, 1:00:00 PM Z") is at("Feb 1, 2024, 1:00:00 PM +15:00") is at("Feb 1, 2024, 1:00:00 PM") is None


def test_session_messages(spark, tmp_path):
    line = lambda at, role, content, kind="message": json.dumps({"type": kind, "timestamp": at, "message": {"role": role, "content": content}})
    (tmp_path / "s.jsonl").write_text("\n".join([
        line("2024-01-01T10:00:00Z", "user", "hello"), line("2024-01-01T13:00:00+02:00", "assistant", [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}]), line("2024-01-01T12:00:00Z", "user", "end"),
        line("2024-01-01T10:00:00", "user", "no zone"), line("2024-01-01T10:00:00Z", "tool", "x"), line("2024-01-01T10:00:00Z", "user", " "), line("2024-01-01T10:30:00Z", "user", "y" * 1600), "not json", line("2024-01-01T10:00:00Z", "user", "x", "event"),
    ]))
    rows = importers.read_session_messages(spark, str(tmp_path / "s.jsonl"), "2024-01-01 10:00:00", "2024-01-01 12:00:00").orderBy("at").collect()
    assert [(r.role, r.said[:5], len(r.said)) for r in rows] == [("user", "hello", 5), ("user", "yyyyy", 1503), ("assistant", "a\nb", 3)]
    assert importers.memory_key("c", "s", "e", 0, {"b": 1, "a": 2}) == importers.memory_key("c", "s", "e", 0, {"a": 2, "b": 1})


def test_feed_limits(spark, tmp_path, monkeypatch):
    row = dict(type="memory", source_key="k", content="é", source="s", namespace="n")
    frame = spark.createDataFrame([row], "type string, source_key string, content string, source string, namespace string")
    feeds.write_transfer(frame, str(tmp_path / "good"))
    assert feeds.transfer_faults(spark, str(tmp_path / "good")).count() == 0
    (tmp_path / "bad.json").write_text('{"type":"manifest","records":5}\n{"type":"memory"}\n')
    assert {(r.fault, r.found) for r in feeds.transfer_faults(spark, str(tmp_path / "bad.json")).collect()} == {("stated records", 5)}
    monkeypatch.setattr(feeds, "MOST_LINE_BYTES", 20)
    monkeypatch.setattr(feeds, "MOST_RECORDS", 0)
    assert {r.fault for r in feeds.transfer_faults(spark, str(tmp_path / "bad.json")).collect()} == {"stated records", "long line", "records"}
    with pytest.raises(ValueError):
        feeds.write_transfer(frame, str(tmp_path / "worse"))


def test_archive_and_trailer(spark, tmp_path):
    lines = [{"type": "manifest"}, {"type": "record", "origin": "a", "content": "x"}, {"type": "record", "origin": "b", "content": "y"}, {"type": "trailer", "coverage": [{"origin": "a", "records": 1}, {"origin": "b", "records": 2}]}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)))
    records, trailer = feeds.read_archive(spark, str(tmp_path / "a.json"))
    assert {r.origin: r.complete for r in feeds.reconcile(records.withColumnRenamed("origin", "source"), trailer).collect()} == {"a": True, "b": False}


def test_log_of_batches(spark, tmp_path):
    kind, base = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("deleted", T.BooleanType())]), str(tmp_path / "log")
    put = lambda n, *rows: log.write_batch(spark.createDataFrame(list(rows), kind), base, n)
    assert log.latest(spark, base, kind, ["k"]).count() == 0
    put(0, ("a", 1, False), ("b", 1, False))
    put(1, ("a", 2, False))
    put(1, ("a", 2, False))  # the same batch once more
    put(2, ("b", 1, True))
    assert log.read_log(spark, base, kind).count() == 4
    assert [(r.k, r.v) for r in log.latest(spark, base, kind, ["k"], "deleted").collect()] == [("a", 2)]
    log.compact(spark, base, str(tmp_path / "small"), kind, ["k"], "deleted")
    assert log.read_log(spark, str(tmp_path / "small"), kind).count() == 1


def test_watched_folder(spark, tmp_path):
    folder, table, state = tmp_path / "notes", str(tmp_path / "table"), str(tmp_path / "state")
    folder.mkdir()
    write = lambda name, text: (folder / name).write_text(text)
    write("a.md", "## One\nfirst body\n## Two\nsecond body\n")
    write("b.md", "only a root text")
    files.sync(spark, str(folder), table, state)
    shown = lambda: {(r.file, r.heading): r.body.split("\n")[-1] for r in files.current_sections(spark, table).collect()}
    assert shown() == {("a.md", "## One"): "first body", ("a.md", "## Two"): "second body", ("b.md", "(root)"): "only a root text"}
    (folder / "a.md").unlink()
    write("a2.md", "## New\nanother file\n")
    files.sync(spark, str(folder), table, state)
    assert ("a2.md", "## New") in shown() and len(shown()) == 4
    current = files.current_sections(spark, table)
    gone = files.absent(current, spark.createDataFrame([("b.md",), ("a2.md",)], "file string"))
    assert {(r.file, r.deleted) for r in gone.collect()} == {("a.md", True)}
    text = lambda *rows: spark.createDataFrame([(f, t, dt.datetime(2024, 1, d)) for f, t, d in rows], "file string, text string, modified timestamp")
    changed = files.changes(current, text(("a.md", "## One\nfirst body\n## Two\nsecond body\n", 1), ("a.md", "## One\nchanged body\n", 2), ("b.md", "only a root text", 2))).collect()
    assert {(r.file, r.heading, r.deleted) for r in changed} == {("a.md", "## One", False), ("a.md", "## Two", True)}
