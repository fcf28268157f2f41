"""Single named files below a folder of archives, as a Spark data source.

Spark's own file readers pass over empty files and names that begin with ``_`` or ``.``, and have
every name listed on the driver. Here the driver sees no more than the archives' own folders; a
task lists and reads the files of one archive, or of a slice of them. Written rows become one file
each, put in place by a rename, so that a repeated task does no harm. Tables of one Parquet file a
row are read the same way, as their files are as many as their rows.

The root may be any URI that ``pyarrow.fs`` reads (local, ``s3://``, ``gs://``, ``hdfs://``).
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
                                    WriterCommitMessage)

SLICES = 4  # tasks per archive
BATCH_BYTES = 8 << 20
LARGEST = (1 << 31) - (1 << 20)  # bytes of a file that fit in a row
_STEP = 1 << 20

COLUMNS = "archive_id string, path string, size_bytes long, content binary, sha256 string, error string"
ROW_COLUMNS = "archive_id string, name string, n long, row_hash binary, payload_jcs binary"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the path in it."""
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def can_open(root: str) -> bool:
    """Whether ``pyarrow.fs`` knows the file system of a root and can reach it from here."""
    try:
        opened(root)
    except (OSError, pa.ArrowException):
        return False
    return True


def _matches(path: str, pattern: str) -> bool:
    """Glob by path parts; ``**`` stands for any number of them."""
    def fits(names: list[str], globs: list[str]) -> bool:
        if not globs:
            return not names
        if globs[0] == "**":
            return any(fits(names[i:], globs[1:]) for i in range(len(names) + 1))
        return bool(names) and fnmatch.fnmatchcase(names[0], globs[0]) and fits(names[1:], globs[1:])

    return fits(path.split("/"), pattern.split("/"))


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, fs.FileInfo | os.DirEntry]]:
    """Name, whether it is a folder, and more of what lies in a folder; nothing if there is no such folder.

    A local folder is gone through entry by entry. Others come as a whole, as ``pyarrow.fs`` lists them.
    """
    if isinstance(system, fs.LocalFileSystem):
        try:
            found = os.scandir(folder)
        except (FileNotFoundError, NotADirectoryError):
            return
        with found:
            for x in found:
                if x.is_dir() or x.is_file():
                    yield x.name, x.is_dir(), x
        return
    for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if x.type in (fs.FileType.File, fs.FileType.Directory):
            yield x.base_name, x.type == fs.FileType.Directory, x


@dataclass
class ArchiveSlice(InputPartition):
    archive_id: str
    folder: str
    slice: int
    slices: int


class ArchiveFilesReader(DataSourceReader):
    """Files of every archive whose path fits a pattern.

    ``content`` says what is read of a file: nothing, its bytes (``bytes``), or only its digest
    (``digest``), which takes files of any size. A file that cannot be read is a row with the
    error's name, as is one too large for a row.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.pattern = options["root"], options["pattern"]
        self.content = options.get("content", "none")
        self.slices = int(options.get("slices", SLICES))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of ``archive_id`` choose folders."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("archive_id",):
                found = {f.value}
            elif isinstance(f, In) and f.attribute == ("archive_id",):
                found = set(f.value)
            elif isinstance(f, IsNotNull) and f.attribute == ("archive_id",):
                continue  # a folder has a name
            else:
                yield f
                continue
            self.wanted = found if self.wanted is None else self.wanted & found

    def partitions(self) -> list[ArchiveSlice]:
        system, root = opened(self.root)
        folders = [x.base_name for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True))
                   if x.type == fs.FileType.Directory]
        archives = [(unquote(x.removeprefix("archive_id=")) if x.startswith("archive_id=") else x, x) for x in sorted(folders)]
        return [ArchiveSlice(a, f"{root}/{x}", i, self.slices) for a, x in archives
                if self.wanted is None or a in self.wanted for i in range(self.slices)]

    def _files(self, system: fs.FileSystem, part: ArchiveSlice) -> Iterator[fs.FileInfo]:
        """Files of the slice that fit; only folders that may lead to one are listed."""
        globs = self.pattern.split("/")
        # Parts of the pattern without a wildcard are gone into directly; the first other one is what slices share out.
        fixed = 0
        while fixed < len(globs) - 1 and not any(c in globs[fixed] for c in "*?["):
            fixed += 1

        def walk(folder: str, depth: int, deep: bool) -> Iterator[fs.FileInfo]:
            for name, is_folder, x in _entries(system, folder):
                if depth == fixed and zlib.crc32(name.encode()) % part.slices != part.slice:
                    continue
                path = f"{folder}/{name}"
                if not is_folder:
                    if (deep or depth == len(globs) - 1) and _matches(path[len(part.folder) + 1:], self.pattern):
                        yield x if isinstance(x, fs.FileInfo) else system.get_file_info(path)
                else:
                    into = deep or globs[depth] == "**"
                    if into or depth < len(globs) - 1 and fnmatch.fnmatchcase(name, globs[depth]):
                        yield from walk(path, depth + 1, into)

        yield from walk("/".join([part.folder, *globs[:fixed]]), fixed, globs[fixed] == "**")

    def _read(self, system: fs.FileSystem, file: fs.FileInfo) -> tuple[bytes | None, str | None, str | None]:
        try:
            if self.content == "bytes":
                if file.size > LARGEST:
                    return None, None, "too_large"
                with system.open_input_stream(file.path, compression=None) as f:
                    return f.read(), None, None
            if self.content == "digest":
                state = hashlib.sha256()
                with system.open_input_stream(file.path, compression=None) as f:
                    while step := f.read(_STEP):
                        state.update(step)
                return None, state.hexdigest(), None
        except (OSError, pa.ArrowException) as e:
            return None, None, type(e).__name__
        return None, None, None

    def read(self, partition: ArchiveSlice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no archive
            return
        system, _ = opened(self.root)
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            names = ["archive_id", "path", "size_bytes", "content", "sha256", "error"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for file in self._files(system, partition):
            more = file.size if self.content == "bytes" else 0
            if rows and size + more > BATCH_BYTES:
                yield batch()
                rows, size = [], 0
            content, digest, error = self._read(system, file)
            rows.append((partition.archive_id, file.path[len(partition.folder) + 1:], file.size, content, digest, error))
            size += len(content or b"") + 200
        if rows:
            yield batch()


def _as_uri(name: str) -> str:
    """A file's name as Spark's ``_metadata.file_path`` has it."""
    def kept(c: str) -> bool:
        return c in "_-!.~'()*,;:$&+=@" or c.isalnum() if c.isascii() else unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp")

    return "".join(c if kept(c) else quote(c, safe="") for c in name)


def _passed_over(name: str) -> bool:
    """Whether Spark's own readers leave out a file of this name."""
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def _stored_row(file: pa.NativeFile) -> tuple[int, bytes | None, bytes | None] | None:
    """How many rows a Parquet file has, and ``row_hash`` and ``payload_jcs`` of a single one; None if it is no such file.

    A missing column is null; capital letters in names don't matter.
    """
    try:
        table = parquet.ParquetFile(file)
        n = table.metadata.num_rows
        if n != 1:
            return n, None, None
        values: list[bytes | None] = []
        for wanted in ("row_hash", "payload_jcs"):
            names = [c for c in table.schema_arrow.names if c.lower() == wanted]
            if len(names) > 1:
                return None
            column = table.read(columns=names, use_threads=False).column(0) if names else None
            values.append(None if column is None else column.cast(pa.binary())[0].as_py())
        return n, values[0], values[1]
    except (OSError, pa.ArrowException):
        return None


class ArchiveRowsReader(ArchiveFilesReader):
    """Rows of tables that have a Parquet file for each: the file's name, its number of rows and the row of a single one.

    Files are left out as Spark's Parquet reader does: by name, and where they are empty or no Parquet.
    """

    def read(self, partition: ArchiveSlice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no archive
            return
        system, _ = opened(self.root)
        # Not decoded, as paths of other scans by Spark's readers are not.
        archive = partition.folder.rpartition("/")[2].removeprefix("archive_id=")
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            names = ["archive_id", "name", "n", "row_hash", "payload_jcs"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for file in self._files(system, partition):
            name = file.path.rpartition("/")[2]
            if _passed_over(name) or not file.size:
                continue
            with system.open_input_file(file.path) as f:
                found = _stored_row(f)
            if found is None or not found[0]:
                continue
            more = len(found[1] or b"") + len(found[2] or b"")
            if rows and size + more > BATCH_BYTES:
                yield batch()
                rows, size = [], 0
            rows.append((archive, _as_uri(name), *found))
            size += more + 200
        if rows:
            yield batch()


class ArchiveFilesWriter(DataSourceArrowWriter):
    """A file per row: ``archive_id``, ``path`` below the archive, ``content``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["root"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.root)
        made: set[str] = set()
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("archive_id", "path", "content")]
            for archive, path, content in zip(*columns):
                if any(x in ("", ".", "..") for x in [archive, *path.split("/")]) or "/" in archive:
                    raise ValueError(f"no file name: {archive}/{path}")
                folder = f"{root}/{archive}/{path}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                # Not below the archive, where a scan would see it.
                waiting = f"{root}/.waiting-{uuid.uuid4().hex}"
                with system.open_output_stream(waiting, compression=None) as f:
                    f.write(content or b"")
                system.move(waiting, f"{root}/{archive}/{path}")
        return WriterCommitMessage()


class ArchiveFiles(DataSource):
    """``spark.read.format("archive_files")`` with ``root``, ``pattern``, ``content`` and ``slices``."""

    @classmethod
    def name(cls) -> str:
        return "archive_files"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: Any) -> DataSourceReader:
        return ArchiveFilesReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> ArchiveFilesWriter:
        if overwrite:
            raise ValueError("archive files are only added")
        return ArchiveFilesWriter(self.options)


class ArchiveRows(DataSource):
    """``spark.read.format("archive_rows")`` with ``root``, ``pattern`` and ``slices``."""

    @classmethod
    def name(cls) -> str:
        return "archive_rows"

    def schema(self) -> str:
        return ROW_COLUMNS

    def reader(self, schema: Any) -> DataSourceReader:
        return ArchiveRowsReader(self.options)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveFiles)
    spark.dataSource.register(ArchiveRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_files(spark: SparkSession, root: str, pattern: str, content: str = "none", slices: int = SLICES) -> DataFrame:
    """Files below the archives of ``root`` by path pattern: archive_id, path, size_bytes, content, sha256, error.

    Empty files and names that begin with ``_`` or ``.`` count like others. Filters on
    ``archive_id`` decide which folders are listed at all.
    """
    _registered(spark)
    return (spark.read.format("archive_files").option("root", root).option("pattern", pattern)
            .option("content", content).option("slices", str(slices)).load())


def read_rows(spark: SparkSession, root: str, table: str, slices: int = SLICES) -> DataFrame:
    """Files of one table below the archives of ``root``, in the columns that ``ArchiveRowsReader`` gives."""
    _registered(spark)
    return (spark.read.format("archive_rows").option("root", root).option("pattern", f"tables/{table}/*")
            .option("slices", str(slices)).load())


def write_files(files: DataFrame, root: str) -> None:
    """Write each row of ``archive_id, path, content`` as a file of its own; a file of that name is replaced.

    Strings are written as UTF-8, a null content as an empty file. Two rows of one path leave one of them.
    """
    _registered(files.sparkSession)
    (files.select("archive_id", "path", F.col("content").cast("binary").alias("content"))
     .write.format("archive_files").option("root", root).mode("append").save())
