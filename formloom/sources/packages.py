"""Zipped document packages: an inventory of files and their members."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROKEN = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, ValueError)


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256, copies, first_copy): files under a folder; copies share their content. Spark's reader leaves out
    files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    hashed = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    groups = hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))  # counted before it is shuffled
    return hashed.join(groups, "sha256").select("path", "length", "sha256", "copies", (F.col("first_path") == F.col("path")).alias("first_copy"))


def members(files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """(path, ok, member, size, body): each member of each zipped file (path, content); a broken file gives one row, and so
    does a broken member. most_bytes: members of more bytes are listed without their body; None unpacks all."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ok", "member", "size", "body"]
        kinds = [pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for i in z.infolist():  # a batch each, so that bodies don't add up
                            try:
                                yield row(path, True, i.filename, i.file_size, z.read(i) if most_bytes is None or i.file_size <= most_bytes else None)
                            except (*BROKEN, EOFError):
                                yield row(path, False, i.filename, i.file_size, None)
                        if not z.infolist():
                            yield row(path, True, None, None, None)
                except BROKEN:
                    yield row(path, False, None, None, None)

    return files.select("path", "content").mapInArrow(unzip, "path string, ok boolean, member string, size long, body binary")


def paragraphs(parts: DataFrame) -> DataFrame:
    """(path, member, paragraph, text) of section members: the text runs of each paragraph element, joined."""
    xml = F.decode(F.col("body"), "UTF-8")
    found = parts.where("ok AND member RLIKE '^Contents/section[0-9]+[.]xml$'").select("path", "member", F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?p[ >](.*?)</(?:\w+:)?p>"), F.lit(1))).alias("paragraph", "inner"))
    return found.select("path", "member", "paragraph", F.array_join(F.regexp_extract_all("inner", F.lit(r"(?s)<(?:\w+:)?t>(.*?)</(?:\w+:)?t>"), F.lit(1)), "").alias("text"))
