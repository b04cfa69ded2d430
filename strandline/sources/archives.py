"""Zips as a data source of Spark's: members are read by many tasks, one member at a time, and only the columns asked for.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").option("pattern", "*.html").schema("member string, size bigint").load(folder)

A zip's directory stands at its end, so a task opens a zip, reads that, and then only the members it is to read. Zips beyond
``PARTITION_BYTES`` are read by several tasks, each taking every so-manieth member; small ones share a task. Folders may be in
any file system that pyarrow reaches (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.sources.documents import to_text

PARTITION_BYTES = 64_000_000
#: Fixed value: the size of a zip without members, which holds its end record only.
_EMPTY = 22
_SCHEMA = "path string, member string, size bigint, content binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


class _Share(InputPartition):
    """Some zips, and which of every ``of`` members of them."""

    def __init__(self, paths: list[str], share: int = 0, of: int = 1):
        super().__init__(None)
        self.paths, self.share, self.of = paths, share, of


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        unknown = set(self.columns) - {"path", "member", "size", "content"}
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)}")
        self.folder, self.pattern, self.zips = options["path"], options.get("pattern", "*"), options.get("zips", "*.zip")

    def partitions(self):
        system, base = opened(self.folder)
        info = system.get_file_info(base)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and f.size > _EMPTY and (f.path == base or fnmatch(os.path.basename(f.path), self.zips)))
        out, held, size = [], [], 0
        for path, length in files:
            shares = -(-length // PARTITION_BYTES)
            if shares > 1:
                out += [_Share([path], k, shares) for k in range(shares)]
                continue
            if held and size + length > PARTITION_BYTES:
                out.append(_Share(held))
                held, size = [], 0
            held.append(path)
            size += length
        return out + [_Share(held)] if held or not out else out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        kinds = {"path": pa.string(), "member": pa.string(), "size": pa.int64(), "content": pa.binary()}
        kind = pa.schema([(c, kinds[c]) for c in self.columns])
        for path in partition.paths:
            with system.open_input_file(path) as handle, zipfile.ZipFile(handle) as z:
                members = [m for m in z.infolist() if not m.is_dir()]
                for m in members[partition.share :: partition.of]:
                    if fnmatch(m.filename, self.pattern):
                        row = {"path": lambda: path, "member": lambda: m.filename, "size": lambda: m.file_size, "content": lambda: z.read(m)}
                        yield pa.RecordBatch.from_pydict({c: [row[c]()] for c in self.columns}, kind)


class ZipMembers(DataSource):
    """Rows (path, member, size, content), or the columns of a schema given; options pattern (of members) and zips (of files)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)


def members(spark: SparkSession, folder: str, pattern: str = "*", columns: tuple[str, ...] = ("path", "member", "size", "content")) -> DataFrame:
    """The members of all zips under a folder whose names fit a pattern; what ``columns`` leaves out isn't read."""
    kinds = dict(c.split() for c in _SCHEMA.split(", "))
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("pattern", pattern).schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(folder)


def member_texts(found: DataFrame) -> DataFrame:
    """Rows (path, member, text, error) of ``members`` (path, member, content): documents read by their extension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for name, content in zip(batch.column("member").to_pylist(), batch.column("content")):
                try:
                    texts.append(to_text(content.as_py(), os.path.splitext(name)[1]))
                    errors.append(None)
                except Exception as e:  # a broken document is a row with its error
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("member"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "member", "text", "error"])

    return found.select("path", "member", "content").mapInArrow(work, "path string, member string, text string, error string")


def write_zips(rows: DataFrame, folder: str, member: str, content: str) -> int:
    """A zip for each of Spark's partitions, of a member for each row (content: bytes or text; null: empty). Returns the number of
    members. A zip appears whole: what a lost task has begun has another name, which ``members`` doesn't read."""
    system, base = opened(folder)
    system.create_dir(base, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n = TaskContext.get().partitionId(), 0
        system, base = opened(folder)
        begun = f"{base}/part-{number:05d}.{uuid.uuid4().hex}.begun"
        with system.open_output_stream(begun) as out, zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    z.writestr(name, value.as_py() or b"")
                    n += 1
        system.move(begun, f"{base}/part-{number:05d}.zip")
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    return rows.select(F.col(member).alias("m"), F.col(content).alias("c")).mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0


class _Forward(io.RawIOBase):
    """A stream that can't go back, as zipfile writes to."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def inner_name(page: Column, extension: str) -> Column:
    """A member's name for a key."""
    return F.concat(F.lit("pages/"), page.cast("string"), F.lit(extension))
