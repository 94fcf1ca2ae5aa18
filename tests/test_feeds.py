import json

from lorekeep.sources import feeds


def test_transfer_round_trip(spark, tmp_path):
    row = dict(type="memory", source_key="k", content="é", source="s", namespace="n", tags=["a"], metadata="{}", access_level=None)
    frame = spark.createDataFrame([row], "type string, source_key string, content string, source string, namespace string, tags array<string>, metadata string, access_level string")
    feeds.write_transfer(frame, str(tmp_path / "out"))
    back = feeds.read_transfer(spark, str(tmp_path / "out")).collect()
    assert len(back) == 1 and back[0].content == "é" and back[0].created_at is None
    assert feeds.oversized_lines(spark, str(tmp_path / "out"), 10).count() == 2  # the record and the manifest


def test_conversations_and_pages(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "title": "t", "messages": [{"role": "human", "text": "a", "at": "x"}, {"role": "assistant", "text": "b", "at": "y"}]}]))
    assert [r.text for r in feeds.read_conversations(spark, str(tmp_path / "c.json")).orderBy("turn").collect()] == ["a", "b"]
    (tmp_path / "p.html").write_text("<p>A&amp;B</p><script>x</script><b>c</b>")
    assert feeds.read_pages(spark, str(tmp_path / "p.html")).first().body.split() == ["A&B", "c"]


def test_reconcile(spark):
    records = spark.createDataFrame([("a",), ("a",)], "source string")
    trailer = spark.createDataFrame([("a", 2), ("b", 1)], "origin string, records long")
    assert {r.origin: r.complete for r in feeds.reconcile(records, trailer).collect()} == {"a": True, "b": False}
