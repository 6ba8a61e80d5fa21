"""Optional live reader: ``spark.read.format("pages").option("urls", "https://a/,https://b/")``.

One partition per host, so that a host is asked by one task at a time. Never used by tests or queries.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, status_code int, headers map<string,array<string>>, html string, response_ms bigint, http_redirects boolean"
#: Tries, first pause and time limit of a fetch, in seconds.
TRIES, PAUSE, LIMIT = 3, 1.0, 15.0


class _Host(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        super().__init__(urls)
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = defaultdict(list)
        for u in self.urls:
            hosts[urlsplit(u).netloc.lower()].append(u)
        return [_Host(v) for v in hosts.values()]

    def read(self, partition: _Host) -> Iterator[tuple]:
        for url in partition.urls:
            for attempt in range(TRIES):
                began = time.monotonic()
                try:
                    with urllib.request.urlopen(url, timeout=LIMIT) as r:  # noqa: S310
                        headers: dict[str, list[str]] = defaultdict(list)
                        for k, v in r.headers.items():
                            headers[k.lower()].append(v)
                        body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                        ms = int(1000 * (time.monotonic() - began))
                        yield url, r.geturl(), r.status, dict(headers), body, ms, url.startswith("http://")
                        break
                except urllib.error.HTTPError as e:
                    if e.code < 500 and e.code not in (408, 429):
                        yield url, url, e.code, {}, None, None, url.startswith("http://")
                        break
                except OSError:
                    pass
                time.sleep(PAUSE * 2**attempt)


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([u for u in self.options.get("urls", "").split(",") if u])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
