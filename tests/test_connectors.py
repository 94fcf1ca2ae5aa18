import json

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import seams
from lorekeep.search import Space
from lorekeep.sources import connectors


def test_pages_of_accounts(spark):
    got = connectors.read_pages(spark, "tests.fetchers:numbers", accounts="a,b")
    assert got.groupBy("account").count().orderBy("account").collect() == [("a", 25), ("b", 25)]
    assert {r.account: r.cursor_at for r in connectors.next_cursors(got).collect()} == {"a": "2024-01-24", "b": "2024-01-24"}  # the last one doesn't count
    assert connectors.read_pages(spark, "tests.fetchers:numbers", cursor=20).count() == 5
    for name, more in (("stuck", {}), ("numbers", {"pages": 2})):
        with pytest.raises(Exception, match="CursorError"):
            connectors.read_pages(spark, f"tests.fetchers:{name}", **more).collect()


def test_pages_as_a_stream(spark, tmp_path):
    stream = connectors.stream_pages(spark, "tests.fetchers:numbers")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(json.loads(r.item)["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(25))


def test_browsers(spark):
    urls = spark.createDataFrame([(1, "http://a", "A")], "id long, url string, title string")
    chromium = spark.createDataFrame([(5, 1, 11_644_473_600_000_001), (6, 9, 1)], "id long, url long, visit_time long")
    firefox = spark.createDataFrame([(5, 1, 7)], "id long, place_id long, visit_date long")
    assert [tuple(r) for r in connectors.browser_visits(chromium, urls, "chromium").collect()] == [(5, "http://a", "A", 1)]
    assert [tuple(r) for r in connectors.browser_visits(firefox, urls, "firefox").collect()] == [(5, "http://a", "A", 7)]


def test_steps_are_checked(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, content string")
    answer = lambda text: lambda f: f.where("id = '1'").select("id", F.lit(text).alias("answer"))
    good = {r.id: r.output for r in seams.generate(rows, answer('{"label": "a", "score": 0.5}'), "label string, score double").collect()}
    assert good["1"].label == "a" and good["2"] is None
    for bad in ('{"label": "a"}', "no json", '{"label": "' + "x" * 200 + '", "score": 1}'):
        with pytest.raises(Exception, match="out of shape"):
            seams.generate(rows, answer(bad), "label string, score double", most_bytes=100).collect()
    vector = lambda *x: lambda f: f.select("id", F.array(*map(F.lit, x)).alias("vector"))
    done = seams.embed(rows, vector(0.6, 0.8), Space("p", "m", 2), unit=True).first()
    assert (done.embedding_model, done.embedding_dimensions, round(done.embedding[1], 6)) == ("m", 2, 0.8)
    for bad in ((1.0,), (0.0, 0.0), (float("nan"), 1.0), (3.0, 4.0)):
        with pytest.raises(Exception, match="out of contract"):
            seams.embed(rows, vector(*bad), Space("p", "m", 2), unit=True).collect()


def test_deliveries_are_signed_once(spark):
    matches = spark.createDataFrame([("s", "m", "n", 0.91)] * 2, "subscription_id string, memory_id string, namespace string, similarity double")
    (one,) = seams.deliveries(matches, b"secret").collect()
    assert one.delivery_key == "s:m:1" and json.loads(one.payload)["similarity"] == 0.91 and one.signature.startswith("sha256=")
