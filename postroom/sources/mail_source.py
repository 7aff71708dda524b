"""Mailbox trees as a Spark data source of their own: ``spark.read.format("mailtree")``.

The driver lists the first level of the tree, the mailboxes; tasks list and read what lies
below.  A mailbox is ``splits`` partitions, which take its files by a hash of their path, so that the mail
of a large one is dealt to several tasks.  Filters on ``mailbox_key`` (=, in) leave
out whole partitions.

As a stream, an offset is a time of modification: a batch holds the files
modified after its start and up to its end, which lags ``settle`` seconds behind the clock, so that
files still being written at the same time wait for the next one.  A batch that is run again
lists the same times.  Files put there with an older time than that are not seen.

Options: ``root`` (or the path given to ``load``), any place that ``pyarrow.fs`` opens; for
stores that only the JVM reads there is ``maildir.read_maildir``, which gives the same rows.
``maxFilesPerMailbox``: the first by path, as there.  Hidden names and files at the top are
left out; an empty tree has no rows; a root that is not there, or no directory, raises.
"""

from __future__ import annotations

import posixpath
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from postroom.sources.maildir import SCHEMA

NAME = "mailtree"
ROWS, BYTES = 500, 32_000_000  # of an Arrow batch
_ARROW = pa.schema([("mailbox_key", pa.string()), ("source_file", pa.string()), ("relative_path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


@dataclass
class Part(InputPartition):
    """Files of a mailbox whose path falls to split ``at`` of ``splits``, modified after ``since`` and up to ``until`` (ns)."""

    mailbox: str
    at: int = 0
    splits: int = 1
    since: int | None = None
    until: int | None = None


class _Tree:
    def __init__(self, options: dict):
        root = options.get("root") or options.get("path")
        if not root:
            raise ValueError("say which tree: option root, or the path of load()")
        self.root, self.splits = root.rstrip("/"), int(options.get("splits", 4))
        most = options.get("maxfilespermailbox", options.get("maxFilesPerMailbox"))
        self.most = None if most is None else int(most)
        self.settle = float(options.get("settle", 1))

    def open(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the tree's path in it, and what its files' names begin with."""
        local = "://" not in self.root and not self.root.startswith("file:")
        files, path = (fs.LocalFileSystem(), self.root) if local else fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + self.root[5:])
        is_local = isinstance(files, fs.LocalFileSystem)
        return files, path.rstrip("/"), "file:" if is_local else self.root[: self.root.index("://") + 3] + self.root.split("://", 1)[1][: -len(path) or None].rstrip("/")

    def mailboxes(self) -> list[str]:
        files, path, _ = self.open()
        there = files.get_file_info(path)
        if there.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        if there.type != fs.FileType.Directory:
            raise NotADirectoryError(self.root)
        found = files.get_file_info(fs.FileSelector(path))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith("."))

    def below(self, files: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
        for f in files.get_file_info(fs.FileSelector(folder)):
            if not f.base_name.startswith("."):
                if f.type == fs.FileType.Directory:
                    yield from self.below(files, f.path)
                elif f.type == fs.FileType.File:
                    yield f

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        files, path, begin = self.open()
        home = f"{path}/{part.mailbox}"
        found = sorted(((f.path, f) for f in self.below(files, home)), key=lambda x: x[0])
        if part.since is not None or part.until is not None:
            found = [x for x in found if (part.since is None or x[1].mtime_ns > part.since) and (part.until is None or x[1].mtime_ns <= part.until)]
        rows, held = [], 0
        for name, f in found[: self.most]:
            if zlib.crc32(f.path.encode("utf-8", "surrogateescape")) % part.splits != part.at:
                continue
            with files.open_input_stream(f.path) as stream:
                content = stream.read()
            rows.append({"mailbox_key": part.mailbox, "source_file": begin + name, "relative_path": posixpath.relpath(f.path, home), "length": len(content), "content": content})
            held += len(content)
            if len(rows) >= ROWS or held >= BYTES:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class MailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.tree, self.wanted = _Tree(options), None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("mailbox_key",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Part]:
        return [Part(m, k, self.tree.splits) for m in self.tree.mailboxes() if self.wanted is None or m in self.wanted for k in range(self.tree.splits)] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.read(part) if part.splits else iter(())


class MailStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.tree = _Tree(options)

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - round(self.tree.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(m, k, self.tree.splits, start["ns"], end["ns"]) for m in self.tree.mailboxes() for k in range(self.tree.splits)] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.read(part) if part.splits else iter(())

    def commit(self, end: dict) -> None:
        """Nothing to let go of: what a batch holds is told by its offsets."""


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailReader:
        return MailReader(self.options)

    def streamReader(self, schema) -> MailStream:
        return MailStream(self.options)


def register(spark) -> None:
    """Make the format known to a session, and let Spark offer filters to such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)
