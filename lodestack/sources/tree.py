"""Folder trees: a walk over an edge table, and a paged REST listing as a Spark data source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.listing import FOLDER_MIME, SHORTCUT_MIME, file_extension, is_indexable
from ..scratch import staged

MOST_FOLDERS = 20_000
ATTEMPTS, PAUSES = 5, (1, 2, 4, 8)
GENERIC_LINK = "https://drive.google.com/open?id="


def walk(edges: DataFrame, root: str, most_folders: int = MOST_FOLDERS) -> DataFrame:
    """(folder, path, depth) of all folders below root, level by level.

    edges: parent, child, name. Folders met before are not entered again, so cycles end; of several ways to a folder
    the shallowest counts, then the smallest path. More than ``most_folders`` is an error.
    """
    level = edges.sparkSession.createDataFrame([(root, "", 0)], "folder string, path string, depth int")
    seen, n = level, 1
    while True:
        below = edges.join(level, edges["parent"] == level["folder"]).select(F.col("child").alias("folder"), F.concat("path", F.lit("/"), "name").alias("path"), (F.col("depth") + 1).alias("depth"))
        fresh = below.join(seen.select("folder"), "folder", "left_anti").groupBy("folder").agg(F.min("path").alias("path"), F.min("depth").alias("depth"))
        level = staged(fresh, "level")
        if not (found := level.count()):
            return seen
        n += found
        if n > most_folders:
            raise ValueError(f"more than {most_folders} folders")
        seen = staged(seen.unionByName(level), "folders")


def listed_files(items: DataFrame, folders: DataFrame) -> DataFrame:
    """Raw files of the walked folders. Items: folder, id, name, mime_type, target_id, target_mime, modified, url.

    Shortcuts to files stand for their target and get a generic link; blank names are skipped; a file that is met
    several times counts once, at its smallest path.
    """
    shortcut = F.col("mime_type") == SHORTCUT_MIME
    mime = F.when(shortcut, F.col("target_mime")).otherwise(F.col("mime_type"))
    rows = items.where((F.trim("name") != "") & (mime != FOLDER_MIME) & mime.isNotNull()).join(folders.select("folder", "path"), "folder")
    ext = file_extension(F.col("name"))
    target = F.when(shortcut, F.col("target_id")).otherwise(F.col("id"))
    files = rows.select(
        target.alias("drive_file_id"), "path", "name", ext.alias("extension"), mime.alias("mime_type"), F.try_to_date(F.substring("modified", 1, 10)).alias("modified_on"),
        F.when(shortcut, F.concat(F.lit(GENERIC_LINK), target)).otherwise(F.col("url")).alias("url"), is_indexable(ext, mime, F.col("path")).alias("is_indexable"),
    )
    others = [c for c in files.columns if c != "drive_file_id"]
    return files.groupBy("drive_file_id").agg(F.min_by(F.struct(*others), F.struct("path", "name")).alias("r")).select("drive_file_id", *[F.col("r")[c].alias(c) for c in others])


class FileSource(Protocol):
    """Anything that lists raw files, as schemas.RAW_FILE."""

    def fetch(self) -> DataFrame: ...


class Listed:
    """A source whose listing was fetched already, written once and given again."""

    def __init__(self, files: DataFrame):
        self.files = staged(files, "listing")

    def fetch(self) -> DataFrame:
        return self.files


class RestTree:
    """The files below a folder of a REST listing, level by level: every folder of a level is a partition of one read.

    Folders and shortcuts to folders are entered once, which ends cycles, at the shallowest and then smallest path;
    blank names are skipped. A folder that cannot be listed fails the whole listing, as do more than ``most_folders``.
    """

    def __init__(self, spark: SparkSession, root: str, endpoint: str, token: str = "", prefix: str = "", most_folders: int = MOST_FOLDERS):
        self.spark, self.root, self.prefix, self.most = spark, root, prefix, most_folders
        self.options = {"endpoint": endpoint, "token": token}
        spark.dataSource.register(FolderSource)

    def fetch(self) -> DataFrame:
        paths, frontier, items = {self.root: self.prefix}, [self.root], None
        while frontier:
            level = staged(self.spark.read.format("folders").options(**self.options, folders=",".join(frontier)).load(), "items")
            items = level if items is None else items.unionByName(level)
            short = F.col("mime_type") == SHORTCUT_MIME
            inner = level.where((F.trim("name") != "") & ((F.col("mime_type") == FOLDER_MIME) | (short & (F.col("target_mime") == FOLDER_MIME))))
            rows = inner.select("folder", F.when(short, F.col("target_id")).otherwise(F.col("id")).alias("child"), "name").limit(self.most + 1).collect()
            found: dict[str, str] = {}
            for r in rows:
                path = f"{paths[r['folder']]}/{r['name']}"
                if r["child"] not in paths:
                    found[r["child"]] = min(path, found.get(r["child"], path))
            paths |= found
            if len(paths) > self.most or len(rows) > self.most:
                raise ValueError(f"more than {self.most} folders")
            frontier = sorted(found)
        folders = self.spark.createDataFrame(list(paths.items()), "folder string, path string")
        return listed_files(items, folders)


def retryable(status: int, body: str) -> bool:
    return status == 429 or status >= 500 or (status == 403 and "ateLimitExceeded" in body)


def http_get(url: str, token: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"}), timeout=60) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def fetch(url: str, get: Callable[[str], tuple[int, str]], sleep: Callable[[float], None] = time.sleep) -> dict:
    """JSON of a URL; what may pass is tried again after pauses, all else raises with its explanation."""
    for attempt in range(ATTEMPTS):
        status, body = get(url)
        if status == 200:
            return json.loads(body)
        if not retryable(status, body) or attempt == ATTEMPTS - 1:
            hint = {401: "the token is no longer valid", 404: "no such folder, or no access to it"}.get(status, body[:200])
            raise OSError(f"listing failed with {status}: {hint}")
        sleep(PAUSES[attempt])
    raise AssertionError


class FolderPartition(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class FolderReader(DataSourceReader):
    """One partition for each folder of the frontier; pages of a folder follow each other."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [FolderPartition(f) for f in self.options["folders"].split(",") if f]

    def read(self, partition: FolderPartition) -> Iterator[tuple]:
        base, token = self.options["endpoint"], self.options.get("token", "")
        page = ""
        while True:
            reply = fetch(f"{base}?folder={partition.folder}&pageSize=1000&pageToken={page}", lambda u: http_get(u, token))
            for f in sorted(reply.get("files", []), key=lambda f: f.get("name", "")):
                target = f.get("shortcutDetails", {})
                yield (partition.folder, f["id"], f.get("name", ""), f.get("mimeType", ""), target.get("targetId"), target.get("targetMimeType"), f.get("modifiedTime", ""), f.get("webViewLink", ""))
            page = reply.get("nextPageToken", "")
            if not page:
                return


class FolderSource(DataSource):
    """``spark.read.format("folders").option("folders", "a,b").option("endpoint", ...)``: children of the given folders."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "folder string, id string, name string, mime_type string, target_id string, target_mime string, modified string, url string"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)
