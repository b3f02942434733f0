"""Byte ranges of files: tasks open the files that Spark listed and read only the parts they need.

Executors reach the files through Arrow's file systems (local or mounted folders, hdfs, s3, gs), so nothing but the
bytes asked for is read, and files of any size can be looked into.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

BATCH_BYTES = 32 * 1024 * 1024
BLOCK_BYTES = 64 * 1024
SCAN_BYTES = 1024 * 1024
#: Longest value a binary column holds.
MOST_BYTES = 2**31 - 64
ZIP_TAIL = 65_557
TEXT_HEAD = "head binary, valid boolean"


@lru_cache
def _system(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/")


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark lists it, and its name there."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        local = rest if scheme == "file" and colon else path
        return fs.LocalFileSystem(), "/" + local.lstrip("/")
    authority, _, name = rest.lstrip("/").partition("/")
    system, base = _system(scheme, authority)
    return system, f"{base.rstrip('/')}/{name}"


def open_file(path: str) -> pa.NativeFile:
    """A file of a path as Spark lists it, for reading at any place."""
    system, name = place_of(path)
    return system.open_input_file(name)


def range_of(path: str, start: int, size: int) -> bytes:
    """``size`` bytes from ``start``, or from the end where that is negative; less where the file ends."""
    with open_file(path) as file:
        length = file.size()
        file.seek(max(0, length + start) if start < 0 else min(start, length))
        return file.read(size)


class FileView:
    """An open file that can be cut like bytes; every cut reads one block at most, or itself if it is longer."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.at, self.block = file, file.size(), 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if start < self.at or stop > self.at + len(self.block):
            self.file.seek(start)
            self.at, self.block = start, self.file.read(max(stop - start, BLOCK_BYTES))
        return self.block[start - self.at : max(start, stop) - self.at]

    def startswith(self, head: bytes) -> bool:
        return self[: len(head)] == head


def with_range(files: DataFrame, column: str, start: Column, size: Column) -> DataFrame:
    """``files`` (with path) and a binary column of a byte range each; a null size opens no file.

    Rows leave in batches of 32 MB of content, or one row where a range is longer.
    """
    names = files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch, parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(parts, pa.binary())], names=[*names, column])

        for batch in batches:
            rows, at, held, parts = batch.select(names), 0, 0, []
            for path, begin, n in zip(*(batch.column(c).to_pylist() for c in ("path", "_start", "_size"))):
                data = None if n is None or path is None else range_of(path, begin or 0, n)
                if parts and held + len(data or b"") > BATCH_BYTES:
                    yield out(rows.slice(at, len(parts)), parts)
                    at, held, parts = at + len(parts), 0, []
                parts.append(data)
                held += len(data or b"")
            yield out(rows.slice(at, len(parts)), parts)

    sized = files.withColumn("_start", start.cast("bigint")).withColumn("_size", size.cast("bigint"))
    return sized.mapInArrow(read, StructType([*files.schema.fields, StructField(column, BinaryType())]))


def text_head(path: Column, size: int) -> Column:
    """First ``size`` bytes of a text file, and whether the whole file is UTF-8; it is read in blocks of 1 MB."""

    def look(name: str) -> dict:
        with open_file(name) as file:
            head = file.read(size)
            decoder = codecs.getincrementaldecoder("utf-8")()
            try:
                block = head
                while block:
                    decoder.decode(block)
                    block = file.read(SCAN_BYTES)
                decoder.decode(b"", final=True)
            except UnicodeDecodeError:
                return {"head": head, "valid": False}
        return {"head": head, "valid": True}

    @F.pandas_udf(TEXT_HEAD)
    def read(paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([look(p) for p in paths], columns=["head", "valid"], dtype=object)

    return read.asNondeterministic()(path)


def zip_at_end(path: Column) -> Column:
    """Whether the file ends with an end-of-archive record (in its last 64 KiB and its own length)."""
    mark = struct.pack("<I", 0x06054B50)

    @F.pandas_udf("boolean")
    def read(paths: pd.Series) -> pd.Series:
        return pd.Series([mark in range_of(p, -ZIP_TAIL, ZIP_TAIL) for p in paths], dtype=object)

    return read.asNondeterministic()(path)
