"""Listing pages over HTTP as a Python data source: one row for each URL of the option ``urls``.

Requests are paced for each host, repeated after passing failures with growing pauses, and
bounded in size. It needs a network and is used only where it is registered.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGAIN = (408, 425, 429, 500, 502, 503, 504)
MOST = 4 << 20


class Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class ListingSource(DataSource):
    """Register with ``spark.dataSource.register(ListingSource)`` and read format ``listing``."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "url string, status int, content binary, content_type string, error string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.urls = options["urls"].split()
        self.rate, self.retries = float(options.get("rate", "2")), int(options.get("retries", "4"))

    def partitions(self) -> list[Host]:
        """One for each host, so its requests can be paced in one place."""
        hosts: dict[str, list[str]] = {}
        for url in self.urls:
            hosts.setdefault(urllib.parse.urlsplit(url).netloc.lower(), []).append(url)
        return [Host(urls) for urls in hosts.values()]

    def read(self, partition: Host):
        for url in partition.urls:
            yield self.fetch(url)
            if self.rate > 0:
                time.sleep(1 / self.rate)

    def fetch(self, url: str) -> tuple:
        for attempt in range(self.retries + 1):
            pause = min(60.0, 2.0**attempt + random.random())
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "ledgerleaf"}), timeout=60) as r:
                    return (url, r.status, r.read(MOST), r.headers.get("Content-Type"), None)
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or attempt == self.retries:
                    return (url, e.code, None, None, str(e))
                told = e.headers.get("Retry-After", "")
                pause = min(120.0, float(told)) if told.isdigit() else pause
            except OSError as e:
                if attempt == self.retries:
                    return (url, None, None, None, str(e))
            time.sleep(pause)
        return (url, None, None, None, "no attempt was made")
