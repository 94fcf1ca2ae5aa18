"""Paged providers as Spark data sources: batch and stream readers around a page fetcher that the caller names.

The fetcher is ``module:function`` and is imported where it runs: ``fetch(options, cursor) -> Page``. It does the network; here
are the rules of paging. A page's next cursor must lie beyond the one before, a read has at most ``pages`` pages, and
events that don't count for the cursor don't move it. Credentials stay in the fetcher's own environment.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MOST_PAGES = 100


@dataclass
class Page:
    """Items of a page as JSON texts, where the next page begins (None: there is none)."""

    items: list[str]
    next_cursor: int | None = None
    eligible: list[bool] = field(default_factory=list)


class CursorError(RuntimeError):
    """A provider gave the same cursor again, or more pages than a read may have."""


def _fetcher(options: dict):
    module, name = options["fetcher"].split(":")
    return getattr(importlib.import_module(module), name)


def pages(options: dict, cursor: int) -> Iterator[tuple[int, Page]]:
    """The pages from a cursor on, each with the cursor that it began at."""
    fetch, limit = _fetcher(options), int(options.get("pages", MOST_PAGES))
    for _ in range(limit):
        page = fetch(options, cursor)
        yield cursor, page
        if page.next_cursor is None:
            return
        if page.next_cursor <= cursor:
            raise CursorError(f"the cursor did not advance beyond {cursor}")
        cursor = page.next_cursor
    raise CursorError(f"more than {limit} pages")


class _Account(InputPartition):
    """One account or server, which has a cursor of its own."""

    def __init__(self, account: str) -> None:
        self.account = account


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self):
        return [_Account(a) for a in self.options.get("accounts", "default").split(",")]

    def read(self, partition):
        options = self.options | {"account": partition.account}
        for cursor, page in pages(options, int(self.options.get("cursor", 0))):
            for i, item in enumerate(page.items):
                yield (partition.account, cursor, item, page.eligible[i] if page.eligible else True)


class _StreamReader(SimpleDataSourceStreamReader):
    """One account as a stream, page by page; Spark keeps the cursor and reads a page again after a failure."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"cursor": int(self.options.get("cursor", 0)), "done": False}

    def _page(self, start: dict) -> tuple[list, dict]:
        account = self.options.get("accounts", "default").split(",")[0]
        page = _fetcher(self.options)(self.options | {"account": account}, start["cursor"])
        if page.next_cursor is not None and page.next_cursor <= start["cursor"]:
            raise CursorError(f"the cursor did not advance beyond {start['cursor']}")
        rows = [(account, start["cursor"], item, page.eligible[i] if page.eligible else True) for i, item in enumerate(page.items)]
        return rows, {"cursor": page.next_cursor if page.next_cursor is not None else start["cursor"], "done": page.next_cursor is None}

    def read(self, start: dict):
        if start["done"]:
            return iter([]), start
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._page(start)[0])

    def commit(self, end: dict) -> None:
        """Nothing to do: the provider keeps its items."""


class PagedSource(DataSource):
    """``account, cursor, item, eligible`` of a provider's pages."""

    @classmethod
    def name(cls) -> str:
        return "lorekeep_pages"

    def schema(self) -> str:
        return "account string, cursor long, item string, eligible boolean"

    def reader(self, schema):
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema):
        return _StreamReader(dict(self.options))


def read_pages(spark: SparkSession, fetcher: str, **options) -> DataFrame:
    """All pages of a provider from a cursor on; each account is read by a task of its own."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("lorekeep_pages").options(fetcher=fetcher, **{k: str(v) for k, v in options.items()}).load()


def stream_pages(spark: SparkSession, fetcher: str, **options) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("lorekeep_pages").options(fetcher=fetcher, **{k: str(v) for k, v in options.items()}).load()


def next_cursors(read: DataFrame, at: str = "played_at") -> DataFrame:
    """``account, cursor_at``: the latest time among the items that count for the cursor; an account without any keeps its cursor."""
    return read.groupBy("account").agg(F.max(F.when(F.col("eligible"), F.get_json_object("item", f"$.{at}"))).alias("cursor_at"))


#: Microseconds from the beginning of a browser's clock to 1970.
_EPOCHS = {"chromium": 11_644_473_600_000_000, "firefox": 0}


def browser_visits(visits: DataFrame, urls: DataFrame, family: str) -> DataFrame:
    """``visit_id, url, title, visited_us`` (from 1970) of the two kinds of browser history; a visit without its address is left out.

    Chromium: ``visits(id, url, visit_time)`` and ``urls(id, url, title)``; Firefox: ``visits(id, place_id, visit_date)`` and
    ``urls(id, url, title)``.
    """
    key, at = ("url", "visit_time") if family == "chromium" else ("place_id", "visit_date")
    places = urls.select(F.col("id").alias("_place"), F.col("url").alias("_url"), "title")
    joined = visits.join(places, visits[key] == places["_place"])
    return joined.select(F.col("id").alias("visit_id"), F.col("_url").alias("url"), "title", (F.col(at) - F.lit(_EPOCHS[family])).alias("visited_us"))


def as_items(rows: list[dict]) -> list[str]:
    """Items of a fetcher as the JSON texts that a page holds."""
    return [json.dumps(r) for r in rows]
