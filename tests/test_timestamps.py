import datetime as dt

from lorekeep.operators import timestamps as T

FEEDS = [("us", "America/New_York", False), ("de", "Europe/Berlin", True), ("in", "Asia/Kolkata", True), ("none", None, False), ("odd", "Mars/Base", False)]
CASES = [
    ("us", "2024-03-10 02:30:00", "2024-03-10T07:30:00"),  # skipped: read with the offset before
    ("us", "2024-11-03 01:30:00", "2024-11-03T05:30:00"),  # twice: the first
    ("us", "2024-11-03 01:30:00 EST", "2024-11-03T06:30:00"),
    ("us", "03/04/2024 05:06:07", "2024-03-04T10:06:07"),
    ("de", "03/04/2024 05:06:07", "2024-04-03T03:06:07"),
    ("de", "24. März 2023, 00:03:53 Uhr", "2023-03-23T23:03:53"),
    ("de", "27 de febrero de 2026 10:39:58", "2026-02-27T09:39:58"),
    ("in", "19 Jul 2021 11:53 IST", "2021-07-19T06:23:00"),
    ("in", "20250306 2059", "2025-03-06T15:29:00"),
    ("us", "20220506T051129Z", "2022-05-06T05:11:29"),
    ("us", "2022-317T03:09:39Z", "2022-11-13T03:09:39"),
    ("us", "Sat Feb  8 13:56:03 CST 2020", "2020-02-08T19:56:03"),
    ("us", "Mon, 04 Mar 2024 12:09:25 -0530", "2024-03-04T17:39:25"),
    ("us", "2020-01-10T14:32:33.813946854Z", "2020-01-10T14:32:33.813946"),
    ("us", "2024-12-27T13:46:03[America/Chicago]", "2024-12-27T19:46:03"),
    ("us", "2022-07-01T19:38:10+05:30[Asia/Kolkata]", "2022-07-01T14:08:10"),
    ("us", "1736342299.092", "2025-01-08T13:18:19.092"),
    ("us", "1697731245856385", "2023-10-19T16:00:45.856385"),
    ("us", "02/04/26, 7:57:23 PM", "2026-02-05T00:57:23"),
    ("us", "\xa02025-05-22T13:35:17 Z\n", "2025-05-22T13:35:17"),
    ("us", "2021-04-26", "2021-04-26T12:00:00"),
    ("us", "April 21, 2020 at 12:31:22 a.m.", "2020-04-21T04:31:22"),
    ("none", "2024-05-01 08:00:00", "2024-05-01T08:00:00"),
    ("nobody", "2024-05-01 08:00:00", "2024-05-01T08:00:00"),
    *(("us", bad, None) for bad in (None, "", "  ", "n/a", "2024-13-05T08:00:00Z", "2025-02-30 10:15:00", "2025-04-12T25:61:00Z", "31/02/2025 09:00", "0000-00-00 00:00:00", "[object Object]", "2024-05-01 08:00:00 QQQQ", "2024-05-01T08:00:00[Mars/Base]")),
    ("odd", "2024-05-01 08:00:00", "2024-05-01T08:00:00"),
]


def frames(spark, cases=CASES):
    rows = [(str(i), feed, value, dt.datetime(2026, 6, 1)) for i, (feed, value, _) in enumerate(cases)]
    imports = spark.createDataFrame(rows + rows[:2], "import_id string, feed_id string, played_at string, received_at timestamp_ntz").selectExpr("*", "'x' AS zone", "1 AS p_local")
    return imports, spark.createDataFrame(FEEDS, "feed_id string, source_timezone string, day_first boolean")


def test_notations(spark):
    got = {int(r.import_id): r.utc_us for r in T.normalise(*frames(spark)).collect()}
    epoch = dt.datetime(1970, 1, 1)
    want = {i: None if t is None else (dt.datetime.fromisoformat(t) - epoch) // dt.timedelta(microseconds=1) for i, (_, _, t) in enumerate(CASES)}
    assert {CASES[i]: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert len(got) == len(CASES)


def test_empty(spark):
    imports, feeds = frames(spark)
    assert T.instants(imports.limit(0), feeds).collect() == []
    assert T.instants(imports, feeds.limit(0)).count() > 0


def test_zone_is_estimated_where_default_is_contradicted(spark):
    # local times of Los Angeles, seen seven hours later: as UTC they would lie before, as Tokyo after
    rows = [(str(i), "silent", f"2024-06-{1 + i % 28:02d} {i % 24:02d}:00:00", dt.datetime(2024, 6, 1 + i % 28, i % 24) - dt.timedelta(hours=8, minutes=50)) for i in range(60)]
    imports = spark.createDataFrame(rows, "import_id string, feed_id string, played_at string, received_at timestamp_ntz")
    feeds = spark.createDataFrame([("silent", None, False)], "feed_id string, source_timezone string, day_first boolean")
    got = T.normalise(imports, feeds).where("import_id = '0'").collect()[0].utc_us
    assert dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=got) == dt.datetime(2024, 5, 31, 15)
