"""Zip archives as a Spark data source: a partition an entry, found in the archive's directory.

An archive is opened by random access through Arrow's file systems (local paths, s3, gs, hdfs), so that each task
reads the directory and its own entries only, whatever the archive's size; ``binaryFile`` would hand all of it, 2 GB
at most, to a single task."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auditweave.sources import ingest

FORMAT = "audit_archives"
#: Entries whose packed bytes come to this much together are read by one task.
TASK_BYTES = 32 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it. The schemes of Hadoop's S3 clients are S3's."""
    scheme, colon, rest = path.partition("://")
    if not colon:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def archive(path: str) -> zipfile.ZipFile:
    system, inner = opened(path)
    try:
        return zipfile.ZipFile(io.BufferedReader(system.open_input_file(inner), 1 << 20))
    except pa.ArrowInvalid as error:  # a seek to before the start of a short file
        raise zipfile.BadZipFile("File is not a zip file") from error


def archives_below(root: str) -> list[str]:
    """The addresses of the archives below ``root``, or of the file itself."""
    system, inner = opened(root)
    head = root[: len(root) - len(inner)] if root.endswith(inner) else ""
    if system.get_file_info(inner).type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(head + info.path for info in found if info.type == fs.FileType.File and info.path.lower().endswith(".zip"))


class Entries(InputPartition):
    """Some entries, as (number among the log entries, name), of an archive; or why its directory can't be read."""

    def __init__(self, path: str, entries: list[tuple[int, str]], error: str | None = None) -> None:
        self.path, self.entries, self.error = path, entries, error


class ArchiveReader(DataSourceReader):
    def __init__(self, root: str, task_bytes: int, lenient: bool) -> None:
        self.root, self.task_bytes, self.lenient = root, task_bytes, lenient

    def partitions(self) -> list[InputPartition]:
        """Reads the directories only."""
        out: list[InputPartition] = []
        for path in archives_below(self.root):
            try:
                with archive(path) as held:
                    infos = [info for info in held.infolist() if info.filename.lower().endswith(ingest.ENTRY_NAMES)]
            except ingest.UNREADABLE as error:
                out.append(Entries(path, [], f"zip: {error}"))
                continue
            some: list[tuple[int, str]] = []
            size = 0
            for k, info in enumerate(infos):
                some.append((k, info.filename))
                size += info.compress_size
                if size >= self.task_bytes or k == len(infos) - 1:
                    out.append(Entries(path, some))
                    some, size = [], 0
        return out or [Entries(self.root, [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from ingest.row_batches(self.rows(partition))

    def rows(self, part: Entries) -> Iterator[ingest.Row]:
        if part.error:
            yield ingest.UNIT, part.path, None, None, None, part.error, *ingest.NO_FIELDS
        if not part.entries:
            return
        try:
            with archive(part.path) as held:
                for k, name in part.entries:
                    yield from ingest.archive_entry(part.path, k, partial(held.open, name), self.lenient)
        except ingest.UNREADABLE as error:
            yield ingest.UNIT, part.path, None, None, None, f"zip: {error}", *ingest.NO_FIELDS


class ArchiveSource(DataSource):
    """Options: path; task_bytes; lenient (true leaves out records that do not fit)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return ingest.DECODED

    def reader(self, schema) -> DataSourceReader:
        lenient = str(self.options.get("lenient", "false")).lower() == "true"
        return ArchiveReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)), lenient)


def read(spark: SparkSession, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Decoded rows, as of ingest.decode(), of the archives below ``root``, for ingest.load(). An entry that can't be
    unpacked rejects its archive, in whichever task it is read."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).option("task_bytes", task_bytes).load(root)
