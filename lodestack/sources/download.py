"""Files' bytes by id over HTTP: capped while they arrive, tried again where that may help, as a function and as a data source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import MOST_BYTES
from .tree import retryable

ATTEMPTS, PIECE = 4, 1 << 20


class TooLarge(ValueError):
    """The file has more bytes than are read."""


def read_capped(stream: BinaryIO, most: int = MOST_BYTES, announced: int | None = None) -> bytes:
    """All bytes of a stream; more than ``most`` raise TooLarge, and not many more than that are ever read."""
    if announced is not None and announced > most:
        raise TooLarge(f"{announced} bytes are announced, {most} are read at most")
    pieces, size = [], 0
    while piece := stream.read(min(PIECE, most + 1 - size)):
        size += len(piece)
        if size > most:
            raise TooLarge(f"more than {most} bytes")
        pieces.append(piece)
    return b"".join(pieces)


class Downloader:
    """id -> bytes of ``endpoint``/id, with a bearer token. OSError: not to be had, after the attempts that help; TooLarge: too many bytes."""

    def __init__(self, endpoint: str, token: str = "", most: int = MOST_BYTES, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, timeout: float = 60):
        self.endpoint, self.token, self.most, self.attempts, self.sleep, self.timeout = endpoint.rstrip("/"), token, most, attempts, sleep, timeout

    def __repr__(self) -> str:
        return f"Downloader({self.endpoint!r})"

    def __call__(self, key: str) -> bytes:
        url = f"{self.endpoint}/{urllib.parse.quote(key, safe='')}?alt=media"
        for attempt in range(self.attempts):
            last = attempt == self.attempts - 1
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"Authorization": f"Bearer {self.token}"}), timeout=self.timeout) as reply:
                    length = reply.headers.get("Content-Length")
                    return read_capped(reply, self.most, int(length) if length else None)
            except urllib.error.HTTPError as e:
                if last or not retryable(e.code, e.read(2000).decode(errors="replace")):
                    raise OSError(f"the server answered {e.code} for {key}") from None
            except OSError as e:
                if last:
                    raise OSError(f"could not download {key}: {e}") from None
            self.sleep(2**attempt)
        raise OSError(f"no attempt was made for {key}")


def downloaded(ids: DataFrame, fetch: Callable[[str], bytes], id_col: str = "id") -> DataFrame:
    """(id, content, error) of a table of ids, fetched where the rows lie, one file at a time; one of content and error is null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key in batch["id"]:
                content, error = _attempt(fetch, key)
                yield pd.DataFrame({"id": [key], "content": [content], "error": [error]})

    return ids.selectExpr(f"cast(`{id_col}` as string) as id").mapInPandas(work, "id string, content binary, error string")


def _attempt(fetch: Callable[[str], bytes], key: str) -> tuple[bytes | None, str | None]:
    try:
        return fetch(key), None
    except (OSError, ValueError) as e:
        return None, f"{type(e).__name__}: {e}"


class IdsPartition(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class DownloadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        ids = json.loads(self.options["ids"])
        n = max(1, min(len(ids), int(self.options.get("partitions", "8"))))
        return [IdsPartition(ids[k::n]) for k in range(n)]

    def read(self, partition: IdsPartition) -> Iterator[tuple]:
        fetch = Downloader(self.options["endpoint"], self.options.get("token", ""), int(self.options.get("most", MOST_BYTES)), int(self.options.get("attempts", ATTEMPTS)))
        for key in partition.ids:
            yield (key, *_attempt(fetch, key))


class DownloadSource(DataSource):
    """``spark.read.format("downloads").option("endpoint", ...).option("ids", '["a", "b"]')``: a list of ids in ``partitions``
    parts. Further options: token, most (bytes of a file), attempts. For a table of ids there is ``downloaded``."""

    @classmethod
    def name(cls) -> str:
        return "downloads"

    def schema(self) -> str:
        return "id string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return DownloadReader(self.options)
