"""Gates for zipped packages that come from outside, as a data source: a row for each gate of each file.

    spark.dataSource.register(PackageGates)
    spark.read.format("package_gates").load("hdfs:///uploads")

Files are dealt to partitions by their bytes. A reader seeks: it takes the directory at the end of a file and the beginnings of
members, and unpacks members piece by piece for their checksums, so no file or member is held whole.
"""

from __future__ import annotations

import io
import os
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a package's name ends with, what its first member says, and bounds on sizes.
ENDINGS = (".hwpx", ".hwp")
KINDS = ("application/hwp+zip", "application/vnd.hancom.hwpx", "application/owpml", "application/owpml-package+xml")
BOUNDS = {"file_bytes": 100 << 20, "member_bytes": 500 << 20, "total_bytes": 1 << 30, "ratio": 100, "members": 10_000, "head_bytes": 2048}
#: Bytes of files that a partition reads, about; how many names a gate's value lists.
PARTITION_BYTES, SHOWN = 64 << 20, 5
SCHEMA = "path string, gate string, ok boolean, value string"


def gates(name: str, size: int, file: BinaryIO, bounds: dict[str, int] = BOUNDS) -> Iterator[tuple[str, bool, str]]:
    """(gate, ok, value) of one file, in this order: extension, magic, size, zip_integrity; for files that are zips also entry_count,
    path_traversal, zip_bomb_ratio, entry_size, mimetype_first and xml_entities.

    A file of more bytes than bounds say is not unpacked: its integrity is that of its directory alone, and other gates refuse it.
    """
    ending = os.path.splitext(name)[1]
    yield "extension", ending.lower() in ENDINGS, ending
    head = file.read(4)
    yield "magic", head[:2] == b"PK", head.hex()
    yield "size", 0 < size <= bounds["file_bytes"], str(size)
    try:
        package = zipfile.ZipFile(file)
        members = package.infolist()
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, UnicodeDecodeError) as error:
        yield "zip_integrity", False, str(error)[:120]
        return
    total = sum(m.file_size for m in members)
    large = [m.filename for m in members if m.file_size > bounds["member_bytes"]]
    ratio, worst = max(((m.file_size / m.compress_size, m.filename) for m in members if m.compress_size), default=(0.0, ""))
    small = not large and total <= bounds["total_bytes"] and len(members) <= bounds["members"] and ratio <= bounds["ratio"]
    try:
        broken = package.testzip() if small else None
    except (zipfile.BadZipFile, zlib.error, OSError, ValueError, RuntimeError, NotImplementedError, EOFError) as error:
        broken = str(error)[:120]
    yield "zip_integrity", broken is None, broken or "ok"
    if broken is not None:
        return
    yield "entry_count", len(members) <= bounds["members"], str(len(members))
    outside = [m.filename for m in members if ".." in m.filename.split("/") or m.filename[:1] in ("/", "\\")]
    yield "path_traversal", not outside, ", ".join(outside[:SHOWN])
    yield "zip_bomb_ratio", ratio <= bounds["ratio"], f"{ratio:.2f} {worst}".strip()
    yield "entry_size", not large and total <= bounds["total_bytes"], f"{total} {', '.join(large[:SHOWN])}".strip()
    first = members[0].filename if members else ""
    kind = _head(package, members[0], 256).decode("utf-8", "ignore").strip() if first == "mimetype" else first
    yield "mimetype_first", first == "mimetype" and kind in KINDS, kind
    marked = [m.filename for m in members if m.filename.endswith((".xml", ".hpf")) and any(x in _head(package, m, bounds["head_bytes"]).lower() for x in (b"<!doctype", b"<!entity"))]
    yield "xml_entities", not marked, ", ".join(marked[:SHOWN])


def _head(package: zipfile.ZipFile, member: zipfile.ZipInfo, size: int) -> bytes:
    try:
        with package.open(member) as body:
            return body.read(size)
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
        return b"<!doctype"  # what can't be read isn't let through


class Stored(io.RawIOBase):
    """A stored file that can be sought in; a place before its beginning is an OSError, as it is for files of one's own."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.bytes = file, size

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + (0, self.file.tell(), self.bytes)[whence]
        if place < 0:
            raise OSError("a place before the file's beginning")
        return self.file.seek(place)

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class GateReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.bounds = {name: int(options.get(name, bound)) for name, bound in BOUNDS.items()}

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), os.path.abspath(self.root))

    def partitions(self) -> list[InputPartition]:
        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)
        out, held, size = [], [], 0
        for path, n in files:
            if held and size + n > self.bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, n))
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for path, size in partition.files:
            with io.BufferedReader(Stored(store.open_input_file(path), size)) as file:
                for gate, ok, value in gates(path, size, file, self.bounds):
                    yield path, gate, ok, value


class PackageGates(DataSource):
    """Options: partition_bytes, and each of BOUNDS by its name."""

    @classmethod
    def name(cls) -> str:
        return "package_gates"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GateReader(self.options)


def gates_of(files: DataFrame, bounds: dict[str, int] = BOUNDS) -> DataFrame:
    """The same rows for files that Spark has read (path, content), where a store is open to Spark's readers alone; a file is held by
    its task then. Null contents are empty files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *gate) for path, content in zip(batch.column(0).to_pylist(), batch.column(1)) for gate in gates(path or "", len(content.as_py() or b""), pa.BufferReader(content.as_py() or b""), bounds)]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string()))], ["path", "gate", "ok", "value"])

    return files.select("path", "content").mapInArrow(read, SCHEMA)
