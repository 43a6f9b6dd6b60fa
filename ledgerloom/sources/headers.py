"""Files by name, size and leading bytes, without their contents.

Where executors can open a path themselves (a local or mounted folder), a Python data source lists the files and
reads ``head`` bytes of each. In any other store Spark's own file reader lists names and sizes without reading; it has no way to read a
part of a file, so there it reads files up to ``most`` bytes, and none that is larger. It leaves out empty files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import MAX_UPLOAD_BYTES

#: The longest signature ends at byte 12.
HEAD_BYTES = 16
FILES_A_TASK = 2_000
SHAPE = "path string, length bigint, modificationTime timestamp, head binary"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = os.path.abspath(options["path"].removeprefix("file://").removeprefix("file:"))
        self.head = int(options.get("head", HEAD_BYTES))
        self.files_a_task = int(options.get("filesATask", FILES_A_TASK))

    def partitions(self) -> list[InputPartition]:
        """Names only; sizes and bytes are read by the tasks. Names that start with ``_`` or ``.`` are no data."""
        hidden = lambda name: name.startswith(("_", "."))
        found = []
        for place, folders, names in os.walk(self.folder):
            folders[:] = sorted(f for f in folders if not hidden(f))
            found += [os.path.join(place, n) for n in sorted(names) if not hidden(n)]
        if os.path.isfile(self.folder):
            found = [self.folder]
        cuts = range(0, len(found), self.files_a_task)
        return [_Files(found[a : a + self.files_a_task]) for a in cuts] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows = [(f"file:{path}", *header_of(path, self.head)) for path in partition.paths]
        kinds = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary())
        names = ("path", "length", "modificationTime", "head")
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], list(names))


class HeaderSource(DataSource):
    """``spark.read.format("file_headers").load(folder)``; options ``head`` and ``filesATask``."""

    @classmethod
    def name(cls) -> str:
        return "file_headers"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def header_of(path: str, head: int) -> tuple[int, datetime, bytes]:
    """Size, time of change and leading bytes of a file."""
    with open(path, "rb", buffering=0) as file:
        seen = os.fstat(file.fileno())
        start = b""
        while len(start) < head and (more := file.read(head - len(start))):
            start += more
    return seen.st_size, datetime.fromtimestamp(seen.st_mtime, timezone.utc), start


def _opens(path: str) -> bool:
    """Whether executors can open the path themselves."""
    return path.startswith("file:") or "://" not in path


def read_headers(spark: SparkSession, path: str, most: int = MAX_UPLOAD_BYTES, by_spark: bool | None = None) -> DataFrame:
    """(path, length, modificationTime, head) of every file under ``path``.

    ``by_spark`` says which way; by default it follows the scheme of the path. By Spark, ``head`` is null for files over ``most``.
    """
    if by_spark is None:
        by_spark = not _opens(path)
    if not by_spark:
        spark.dataSource.register(HeaderSource)
        return spark.read.format("file_headers").load(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = ("path", "length", "modificationTime")
    # The bound on the length reaches the reader, which then opens no larger file; without the content it opens none at all.
    small = files.filter(F.col("length") <= most).select(*names, F.substring("content", 1, HEAD_BYTES).alias("head"))
    large = files.filter(F.col("length") > most).select(*names, F.lit(None).cast("binary").alias("head"))
    return small.unionByName(large)
