"""The archive as a data source of its own: files dealt to tasks by size, as a table and as a stream.

It reads mounted folders.  An error of the file system fails the task, which is tried again; only
what is wrong with a file's content makes the file a broken one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from archivemill.sources.unpacking import STEPS, unpacked

#: Compressed bytes that a task is dealt, some 50 to 100 MB of text, and what opening a file counts for.
SPLIT_BYTES = 4 * 1024 * 1024
OPEN_BYTES = 256 * 1024

# Characters that stand for themselves in the path of a file's URI.
_PLAIN = "/=:@!$&'()*+,;"


@dataclass(frozen=True, order=True)
class File:
    time: int
    path: str
    size: int


class StoreError(Exception):
    """The file system failed; the file itself may be whole."""


class _Raw:
    """A file whose errors are not taken for faults of its content."""

    def __init__(self, path: str):
        try:
            self.file = open(path, "rb")
        except OSError as error:
            raise StoreError(str(error)) from error

    def _try(self, call, *args):
        try:
            return call(*args)
        except OSError as error:
            raise StoreError(str(error)) from error

    def read(self, size: int = -1) -> bytes:
        return self._try(self.file.read, size)

    def readinto(self, buffer) -> int:
        return self._try(self.file.readinto, buffer)

    def seek(self, *args) -> int:
        return self._try(self.file.seek, *args)

    def tell(self) -> int:
        return self.file.tell()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> _Raw:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def local_path(root: str) -> str:
    return unquote(urlparse(root).path) if root.startswith("file:") else root


def files_below(roots: list[str]) -> list[File]:
    """The ``.bz2`` files below the folders, or the files themselves, in the order of their paths."""
    found = {}

    def add(path: str) -> None:
        state = os.stat(path)
        found[path] = File(state.st_mtime_ns, path, state.st_size)

    for root in map(local_path, roots):
        if os.path.isfile(root):
            add(root)
            continue
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        for folder, folders, names in os.walk(root):
            folders[:] = [f for f in folders if not f.startswith(("_", "."))]
            for name in names:
                if name.endswith(".bz2") and not name.startswith(("_", ".")):
                    add(os.path.join(folder, name))
    return [found[path] for path in sorted(found)]


@dataclass
class Share(InputPartition):
    """Files of one task."""

    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def shares(files: list[File], split_bytes: int) -> list[Share]:
    """Files that follow each other, as many as a task takes; a larger file is a task's only one."""
    out, held, size = [], [], 0
    for file in files:
        cost = file.size + OPEN_BYTES
        if held and size + cost > split_bytes:
            out.append(Share(held))
            held, size = [], 0
        held.append(file.path)
        size += cost
    return [*out, Share(held)] if held else out


def read_files(paths: list[str]) -> Iterator[pa.RecordBatch]:
    for path in paths:
        yield from unpacked("file:" + quote(path, safe=_PLAIN), lambda path=path: _Raw(path))


class ArchiveSource(DataSource):
    """Options: ``roots`` (a JSON list of folders or files) or ``path``, and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "message_archive"

    def schema(self) -> str:
        return STEPS

    def roots(self) -> list[str]:
        return json.loads(self.options["roots"]) if "roots" in self.options else [self.options["path"]]

    def split_bytes(self) -> int:
        return int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.roots(), self.split_bytes())

    def streamReader(self, schema) -> ArchiveStream:  # noqa: N802 - Spark's name
        return ArchiveStream(self.roots(), self.split_bytes())


class ArchiveReader(DataSourceReader):
    def __init__(self, roots: list[str], split_bytes: int):
        self.roots, self.split_bytes = roots, split_bytes

    def partitions(self) -> list[Share]:
        return shares(files_below(self.roots), self.split_bytes) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return read_files(partition.paths)


class ArchiveStream(DataSourceStreamReader):
    """Offsets are the time and path of a file; a batch holds the files after one offset up to another."""

    def __init__(self, roots: list[str], split_bytes: int):
        self.roots, self.split_bytes = roots, split_bytes

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        last = max(files_below(self.roots), default=File(0, "", 0))
        return {"time": last.time, "path": last.path}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return shares([f for f in files_below(self.roots) if low < (f.time, f.path) <= high], self.split_bytes)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return read_files(partition.paths)

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the checkpoint."""
