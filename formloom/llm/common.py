"""Helpers shared by the training-data operators: tables, checkpoints and hashed document blocks."""

from __future__ import annotations

import ctypes
import inspect
import math
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: Code points of text that one block holds, about; a block is what one Python task works on at a time.
BLOCK_CHARS = 6_000_000
#: Tasks that write a checkpoint, at least.
LEAST_TASKS = 12
#: Bytes of text that a packing task gathers before it writes its pieces.
PACK_BYTES = 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; only a local session without one (tests) gets a temporary folder."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir() is not None:
        return
    if not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="formloom-checkpoint-"))


def checkpointed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Written once to the shared checkpoint folder; later uses survive lost executors and don't compute it again.

    parts: what the table needs, where the cluster deals out more, so that neither it nor what is made of it is written in
    many small files; LEAST_TASKS at least.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df.coalesce(max(LEAST_TASKS, parts)) if parts else df).checkpoint(eager=True)


def written(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df written as a table in the shared checkpoint folder and read from there: unlike a checkpoint it has the sizes of its files,
    so that what is joined to it again and again is planned by them. parts: as in checkpointed()."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    (df.coalesce(max(LEAST_TASKS, parts)) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(rows: int, rows_per_task: int = 50_000) -> int:
    """Tasks for a table of so many rows of ids."""
    return max(1, math.ceil(rows / rows_per_task))


def text_hash(text: str = "text") -> Column:
    """128 bits of the SHA-256 of a text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(text_of(text), 256), 1, 32))


def row_key(doc_id: Column, hashed: Column) -> Column:
    """One non-null name for a row's id and text hash, so that one exchange serves the joins and the windows on both."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.hex(hashed))))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def staying_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose row_key() is in kept (key), once each: of rows that repeat both id and text the one whose
    other columns come first as JSON. docs is shuffled once; copies are thinned out before that.
    """
    key, copy = fresh(docs, "row_key"), fresh(docs, "copy")
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    order = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest))) if rest else F.lit("")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), text_hash()))
    first = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col(copy) == 1)
    wanted = kept.select(F.col("key").alias(key)).distinct()
    return first.join(wanted, key, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def block_count(docs: DataFrame, text: str = "text", chars: int = BLOCK_CHARS) -> int:
    """Blocks needed so that each holds about `chars` code points, however large the input."""
    total = docs.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    return max(1, math.ceil(total / chars))


def packed_blocks(docs: DataFrame, blocks: int, level: int = 1) -> DataFrame:
    """(block int, payload binary): rows dealt by a hash of doc_id and packed, compressed, for one exchange.

    level: of the compression; a higher one takes more time and less disk.

    A payload is an Arrow stream of docs' columns. A row's block depends on its doc_id alone, so equal ids meet
    and a task that runs again gives the same pieces. Rows without an id are dealt by their text, so that they don't
    all fall into one block.
    """
    cols = docs.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            block = rows.column("_block").to_numpy()
            order = np.argsort(block, kind="stable")
            rows, block = rows.select(cols).take(pa.array(order)), block[order]
            cuts = [*np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
            out = [to_payload(rows.slice(a, b - a), level) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int32()), pa.array(out, pa.binary())], ["block", "payload"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        held = []
        release()

    named = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
    dealt = docs.withColumn("_block", F.pmod(named, F.lit(blocks)).cast("int"))
    return dealt.mapInArrow(pack, "block int, payload binary")


def release() -> None:
    """Give freed memory back at the end of a task; a worker serves many tasks and several stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(f):
    """A group function (key, one or two tables) that ends with release()."""
    if len(inspect.signature(f).parameters) == 2:

        def one(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            try:
                return f(key, group)
            finally:
                release()

        return one

    def two(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(key, left, right)
        finally:
            release()

    return two


def to_payload(rows: pa.Table, level: int = 1) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def from_payloads(payloads: pa.ChunkedArray) -> pa.Table:
    """The rows of a block's payloads, in an order that doesn't depend on how the pieces arrived."""
    parts = sorted(x.as_py() for x in payloads)
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in parts)


def texts_as_bytes(column: pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 of each text, without decoding it; null is empty."""
    for chunk in column.cast(pa.binary()).chunks:
        for x in chunk:
            yield x.as_py() or b""


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value, for a shuffle of few large rows instead of many small ones."""
    parts = [a.tobytes() for a in arrays]
    raw = b"".join(parts)
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(value: bytes, *types: str) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(types)}I", value)
    raw = pa.decompress(value[4 * len(types) :], sum(sizes), codec="zstd", asbytes=True)
    out, at = [], 0
    for n, kind in zip(sizes, types):
        out.append(np.frombuffer(raw[at : at + n], kind))
        at += n
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for each ordered pair of 64-bit names."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019) + (a >> np.uint64(7)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shard_cuts(names: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted 64-bit names fall into `shards` equal ranges of the name space."""
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.r_[0, np.searchsorted(names, bounds), len(names)]
