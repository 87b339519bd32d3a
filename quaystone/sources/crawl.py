"""A paged crawl as a Spark data source.

``spark.read.format("channel_pages").option("channel", "a,b")`` gives pages, one
partition a channel and one request at a time in it; ``readStream`` gives a page of
each channel a batch. The last page says why its walk stopped. How pages are fetched
is injected by the name of a function, so that nothing here needs a network.
"""

import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "channel string, before bigint, url string, status int, html string, stop string"
PAUSE = 1.0


class _Channel(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Walk:
    """The steps of a walk down one channel, shared by the batch and the stream reader."""

    def __init__(self, options: dict):
        self.channels = [c.strip().lstrip("@").lower() for c in options["channel"].split(",") if c.strip()]
        self._fetch, self.most = options["fetcher"], int(options.get("maxpages", 500))
        self.pause = float(options.get("pause", PAUSE))
        self.resume = int(options["resumefrom"]) if "resumefrom" in options else None
        self.since = int(options["since"]) if "since" in options else None

    def page(self, name: str, before: int | None, n: int) -> tuple[tuple, int | None]:
        """(row of the ``n``-th page, where the next one starts); the row says why the walk stops here, if it does."""
        import importlib
        import re

        module, _, function = self._fetch.partition(":")
        url = f"https://t.me/s/{name}" + (f"?before={before}" if before else "")
        status, html = getattr(importlib.import_module(module), function)(url)
        if not 200 <= status < 300:
            raise ConnectionError(f"{url} answered {status}")
        posts = re.findall(r'(?i)data-post="([^"/]*)/?([^"]*)"', html or "")
        ids = [int(i) for c, i in posts if c.lower() == name and i.isdigit() and 1 <= int(i) < 2**31]
        low = min(ids, default=None)
        if not ids:
            stop = "end" if not posts else "foreign" if any(i.isdigit() and c.lower() != name for c, i in posts) else "unreadable"
        elif self.since is not None and max(ids) <= self.since:
            stop = "reached"
        elif before is not None and low >= before:
            stop = "repeated"
        elif low <= 1:
            stop = "end"
        else:
            stop = "cap" if n + 1 >= self.most else None
        return (name, before, url, status, html, stop), low


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self._walk = _Walk(options)

    def partitions(self):
        return [_Channel(c) for c in self._walk.channels]

    def read(self, partition):
        before, n, walk = self._walk.resume, 0, self._walk
        while n < walk.most:
            if n:
                time.sleep(walk.pause)
            row, low = walk.page(partition.name, before, n)
            yield row
            if row[5]:
                return
            before, n = low, n + 1


class _Stream(SimpleDataSourceStreamReader):
    """A page of each channel a batch, until its walk stops; offsets say where each stands."""

    def __init__(self, options: dict):
        self._walk = _Walk(options)

    def initialOffset(self):
        return {c: [self._walk.resume, 0, False] for c in self._walk.channels}

    def read(self, start):
        rows, after = [], {}
        for name, (before, n, done) in start.items():
            if done:
                after[name] = [before, n, True]
                continue
            if n:
                time.sleep(self._walk.pause)
            row, low = self._walk.page(name, before, n)
            rows.append(row)
            after[name] = [low if low is not None else before, n + 1, row[5] is not None]
        return iter(rows), after

    def readBetweenOffsets(self, start, end):
        rows = []
        while start != end:
            more, start = self.read(start)
            rows += more
        return iter(rows)

    def commit(self, end):
        pass


class ChannelPages(DataSource):
    """Options: channel (comma-separated), fetcher (module:function of url, giving status and html), maxpages, since, resumefrom, pause (seconds)."""

    @classmethod
    def name(cls):
        return "channel_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema):
        return _Stream(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(ChannelPages)
