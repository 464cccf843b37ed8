"""Remote scans: requests with retries, paged listings as a data source, ranged reads of large files."""

from __future__ import annotations

import http.client
import io
import json
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def get(url: str, headers: Mapping[str, str] | None = None, retries: int = 4, timeout: float = 60, length: int | None = None) -> tuple[bytes, dict]:
    """Body and headers of a URL; retried with doubling pauses, also if the body is not ``length`` bytes."""
    pause = 0.5
    for attempt in range(retries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers or {})), timeout=timeout) as answer:
                body = answer.read()
                if length is not None and len(body) != length:
                    raise OSError(f"{url}: {len(body)} bytes instead of {length}")
                return body, {k.lower(): v for k, v in answer.headers.items()}
        except urllib.error.HTTPError as bad:
            if bad.code < 500 and bad.code != 429 or attempt == retries - 1:
                raise
        except OSError:
            if attempt == retries - 1:
                raise
        time.sleep(pause)
        pause *= 2
    raise AssertionError("unreachable")


class Session:
    """Requests to one server over a connection that stays open: one a thread, as connections are not shared.

    ``token`` becomes the authorisation header of every request, if there is one. A connection that the server has closed
    is opened anew once; answers of 500 and more, and 429, are retried like those of ``get``.
    """

    def __init__(self, base: str, token: str | None = None, timeout: float = 60, retries: int = 4):
        self.base, self.timeout, self.retries = urllib.parse.urlsplit(base), timeout, retries
        self.headers = {"Connection": "keep-alive"} | ({"Authorization": f"Bearer {token}"} if token else {})
        self._own = threading.local()

    def _connection(self, anew: bool = False) -> http.client.HTTPConnection:
        if anew or getattr(self._own, "connection", None) is None:
            kind = http.client.HTTPSConnection if self.base.scheme == "https" else http.client.HTTPConnection
            self._own.connection = kind(self.base.netloc, timeout=self.timeout)
        return self._own.connection

    def get(self, path: str, headers: Mapping[str, str] | None = None) -> tuple[bytes, dict]:
        """Body and headers of a path on the server."""
        pause = 0.5
        for attempt in range(self.retries):
            last = attempt == self.retries - 1
            try:
                link = self._connection(anew=attempt > 0)
                link.request("GET", path, headers=self.headers | dict(headers or {}))
                answer = link.getresponse()
                body = answer.read()
                if answer.status < 400:
                    return body, {k.lower(): v for k, v in answer.getheaders()}
                if last or (answer.status < 500 and answer.status != 429):
                    raise urllib.error.HTTPError(path, answer.status, answer.reason, answer.headers, None)
            except (http.client.HTTPException, ConnectionError, TimeoutError):
                if last:
                    raise
            time.sleep(pause)
            pause *= 2
        raise AssertionError("unreachable")


def next_page(link: str | None) -> str | None:
    """The address that a Link header names as next."""
    found = re.search(r'<([^>]+)>\s*;\s*rel="?next"?', link or "")
    return found[1] if found else None


def pages(url: str, headers: Mapping[str, str] | None = None) -> Iterator[list]:
    """JSON lists of a paged listing."""
    while url:
        body, head = get(url, headers)
        yield json.loads(body)
        link = next_page(head.get("link"))
        url = urllib.parse.urljoin(url, link) if link else None


class ListingSource(DataSource):
    """``spark.read.format("paged_listing").option("urls", "a b").load()``: a partition for each address."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "url string, path string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)


class _ListingReader(DataSourceReader):
    def __init__(self, options):
        self.urls = options.get("urls", "").split()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in pages(partition.value):
            for entry in page:
                yield partition.value, entry.get("path"), entry.get("size")


class RangeFile(io.RawIOBase):
    """A remote file that seeks: reads become range requests, so members of a large archive are read alone."""

    def __init__(self, url: str, headers: Mapping[str, str] | None = None):
        self.url, self.headers, self.at = url, dict(headers or {}), 0
        _, head = get(url, self.headers | {"Range": "bytes=0-0"})
        self.size = int(head["content-range"].rpartition("/")[2])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def readinto(self, buffer) -> int:
        want = min(len(buffer), self.size - self.at)
        if want <= 0:
            return 0
        body, _ = get(self.url, self.headers | {"Range": f"bytes={self.at}-{self.at + want - 1}"}, length=want)
        buffer[:want] = body
        self.at += want
        return want
