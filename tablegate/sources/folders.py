"""Folder listings as a data source: ``spark.read.format("release_folders")``.

The folders are listed once, when the scan is planned.  Entries are dealt into splits of about ``SPLIT_BYTES``
of content (where it is hashed) or ``SPLIT_ENTRIES`` entries, so one large folder spreads over many
tasks and one large file does not wait behind others.  A file is hashed in chunks, in constant memory.

The entries' names, lengths and times pass through the driver, as with Spark's own file sources, whose
listings leave out empty and hidden files that a release folder may well hold.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 256 << 20
SPLIT_ENTRIES = 20_000
CHUNK_BYTES = 1 << 20
#: Schemes that Spark and Arrow name differently.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}
SCHEMA = "path string, length bigint, modified timestamp, sha1 string"


def opened(path: str):
    """Arrow's file system of a path, the path in it, and what Spark writes before it."""
    from pyarrow import fs

    scheme, found, rest = path.rstrip("/").partition("://")
    system, location = fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}{found}{rest}")
    return system, location, path.rstrip("/").removesuffix(location)


def readable(path: str) -> bool:
    """Whether tasks can open a path's file system by themselves."""
    try:
        opened(path)
        return True
    except Exception:  # noqa: BLE001  (whatever the library says about a scheme it does not know)
        return False


def sha1_of(path: str) -> str:
    system, location, _ = opened(path)
    digest = hashlib.sha1()
    with system.open_input_stream(location) as stream:
        while chunk := stream.read(CHUNK_BYTES):
            digest.update(chunk)
    return digest.hexdigest()


def entries(folder: str) -> list[tuple[str, int | None, int]]:
    """``path, length, microseconds`` of what lies directly in a folder; subfolders have no length."""
    from pyarrow import fs

    system, location, before = opened(folder)
    return [(before + info.path, info.size if info.type == fs.FileType.File else None, info.mtime_ns // 1000)
            for info in system.get_file_info(fs.FileSelector(location))]


class Split(InputPartition):
    def __init__(self, held: list):
        self.held = held


class FolderReader(DataSourceReader):
    def __init__(self, folders: list[str], hashed: bool):
        self.folders, self.hashed = folders, hashed

    def partitions(self) -> list[Split]:
        found = [entry for folder in self.folders for entry in entries(folder)]
        if self.hashed:
            found.sort(key=lambda e: -(e[1] or 0))  # the largest first, so that a last split is a small one
        splits, held, size = [], [], 0
        for entry in found:
            held.append(entry)
            size += (entry[1] or 0) if self.hashed else 0
            if size >= SPLIT_BYTES or len(held) >= SPLIT_ENTRIES:
                splits.append(Split(held))
                held, size = [], 0
        return splits + [Split(held)] if held or not splits else splits

    def read(self, partition: Split) -> Iterator[tuple]:
        for path, length, changed in partition.held:
            when = datetime.fromtimestamp(changed // 1_000_000, timezone.utc).replace(microsecond=changed % 1_000_000)
            yield path, length, when, sha1_of(path) if self.hashed and length is not None else None


class FolderSource(DataSource):
    """Options: ``folders`` (a JSON list of folders), ``hashed`` (true: with the files' SHA-1)."""

    @classmethod
    def name(cls) -> str:
        return "release_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(json.loads(self.options["folders"]), self.options.get("hashed", "false") == "true")
