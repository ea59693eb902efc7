"""Cells of the tables inside section parts of document packages, and JSON or CSV schedules."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, member string, ok boolean, tbl int, row int, col int, row_span int, col_span int, text string"


def _own(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def cells_of(body: bytes) -> Iterator[tuple]:
    """(table, row, col, row_span, col_span, text) of each cell; tables inside cells are tables of their own."""
    tables = [e for e in ElementTree.fromstring(body).iter() if _own(e.tag) == "tbl"]
    for n, table in enumerate(tables):
        for r, line in enumerate(e for e in table if _own(e.tag) == "tr"):
            for c, cell in enumerate(e for e in line if _own(e.tag) == "tc"):
                marks = {_own(e.tag): e.attrib for e in cell}
                at, span = marks.get("cellAddr", {}), marks.get("cellSpan", {})
                text = "\n".join(filter(None, ("".join(_texts(p)) for p in _paragraphs(cell))))
                yield n, int(at.get("rowAddr", r)), int(at.get("colAddr", c)), int(span.get("rowSpan", 1)), int(span.get("colSpan", 1)), text


def _paragraphs(cell) -> Iterator:
    for e in cell:
        if _own(e.tag) == "p":
            yield e
        elif _own(e.tag) != "tbl":
            yield from _paragraphs(e)


def _texts(paragraph) -> Iterator[str]:
    for e in paragraph:
        if _own(e.tag) == "t":
            yield "".join(e.itertext())
        elif _own(e.tag) != "tbl":
            yield from _texts(e)


def table_cells(parts: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """A row for each cell of the section parts among parts (path, ok, member, body); a part that can't be parsed, or has more
    than most_bytes (None: all are parsed), gives one row with ok false."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.bool_(), *[pa.int32()] * 5, pa.string()]
        for batch in batches:
            rows = []
            for path, member, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    if most_bytes is not None and len(body or b"") > most_bytes:
                        raise ValueError("too large")
                    rows += [(path, member, True, *cell) for cell in cells_of(body or b"")]
                except (ElementTree.ParseError, ValueError):
                    rows.append((path, member, False, *[None] * 6))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    sections = parts.where("ok AND member RLIKE '^Contents/section[0-9]+[.]xml$'").select("path", "member", "body")
    return sections.mapInArrow(read, SCHEMA)


def schedule_items(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """(task, start, end) from JSON lines or CSV with a header; days that can't be read are null."""
    rows = spark.read.json(path) if kind == "json" else spark.read.option("header", True).csv(path)
    return rows.select(F.trim("task").alias("task"), F.col("start").try_cast("date").alias("start"), F.col("end").try_cast("date").alias("end"))
