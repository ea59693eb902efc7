"""Exact dedup: two Bloom passes single out possibly repeated text hashes; only those rows are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import checkpointed, parts_of, release, releasing, row_key, squeeze, staying_rows, table, text_of, unsqueeze

#: Filter bits for each row, and the bits of the filter of one range of hashes, which is what is sent to the executors
#: at a time (128 MB). A larger input has more ranges, one after another; nothing else depends on its size.
BITS_PER_ROW, RANGE_BITS = 16, 1 << 30
#: Bits of one row of a filter, and of the pieces in which one task merges it.
BITMAP_BITS, PIECE_BITS = 32768, 1 << 23
#: A group of at least this share of all rows is joined by broadcast: there are at most as many of these as its inverse.
HOT_SHARE = 1000


def filter_bits(rows: int) -> int:
    """A power of two of at least BITS_PER_ROW bits a row."""
    return max(BITMAP_BITS, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length())


def _slots(bits: int, range_bits: int) -> tuple[Column, Column]:
    """A hash's two slots, both in the range of hashes that the first one falls into."""
    first = F.pmod(F.xxhash64("text_hash"), F.lit(bits))
    second = F.floor(first / F.lit(range_bits)) * F.lit(range_bits) + F.pmod(F.xxhash64("text_hash", F.lit("second")), F.lit(range_bits))
    return first, second


def _marked(slots: DataFrame) -> DataFrame:
    """(bucket, bitmap) of the slots (first, second) that more than one row sets.

    Each task sends, for each piece of the filter, the slots that its rows set once and those they set again, as sorted
    compressed numbers; a piece's are merged by OR, and a slot that two tasks set is one that is set again.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for x in batches:
            first, second = x.column(0).to_numpy(), x.column(1).to_numpy()
            held += [first, second[second != first]]
        slot, n = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
        piece = slot // PIECE_BITS
        cuts = np.r_[np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]), len(slot)] if len(slot) else np.zeros(1, int)
        inside = (slot % PIECE_BITS).astype(np.uint32)
        values = [squeeze(np.diff(inside[a:b], prepend=np.uint32(0)), n[a:b] > 1) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(piece[cuts[:-1]], pa.int64()), pa.array(values, pa.binary())], ["piece", "value"])
        release()

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        once, again = np.zeros(PIECE_BITS, bool), np.zeros(PIECE_BITS, bool)
        for value in group.column("value"):
            steps, more = unsqueeze(value.as_py(), "u4", "?")
            slot = np.cumsum(steps, dtype=np.int64)
            again[slot] |= once[slot] | more
            once[slot] = True
        bits = np.packbits(again, bitorder="little").reshape(-1, BITMAP_BITS // 8)
        some = np.flatnonzero(bits.any(1))
        buckets = key[0].as_py() * (PIECE_BITS // BITMAP_BITS) + some
        return pa.table({"bucket": pa.array(buckets, pa.int64()), "bitmap": pa.array([bits[i].tobytes() for i in some], pa.binary())})

    return slots.mapInArrow(gather, "piece long, value binary").groupBy("piece").applyInArrow(releasing(merge), "bucket long, bitmap binary")


def possibly_repeated(digests: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """digests (with text_hash) with a column `maybe`: false only where no other row has the same hash.

    Pass one marks each slot of a two-hash Bloom filter that more than one row sets; pass two holds each row against the
    marks. The filter is built and sent for one range of hashes at a time, so what is broadcast has range_bits bits at
    most, however many rows there are. Each range's rows are written before the next range begins.
    """
    n = digests.count()
    bits = filter_bits(n)
    range_bits = min(bits, range_bits)
    first, second = _slots(bits, range_bits)
    slotted = digests.withColumn("first", first).withColumn("second", second)
    done = []
    for i in range(bits // range_bits):
        rows = slotted.where(F.floor(F.col("first") / F.lit(range_bits)) == i)
        side = F.broadcast(_marked(rows.select("first", "second")))  # range_bits / 8 bytes at most
        rows = rows.withColumn("maybe", F.lit(True))
        for slot in ("first", "second"):
            at = F.pmod(F.col(slot), F.lit(BITMAP_BITS))
            byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
            rows = rows.join(side, F.floor(F.col(slot) / F.lit(BITMAP_BITS)) == side.bucket, "left").withColumn("maybe", F.col("maybe") & hit).drop("bucket", "bitmap")
        done.append(checkpointed(rows.drop("first", "second"), parts_of(n)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bits: int = RANGE_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The largest id of a group stays (null ids are smallest). Of
    rows that repeat both id and text, one is kept; group_size counts rows. Empty input gives an empty result; other
    columns of docs are not read, so their names can't clash.

    A group of a thousandth of all rows or more, of which there are a thousand at most, is joined by broadcast, so its
    rows are not shuffled; the rows of all other groups are.
    """
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("text_hash"))
    n = docs.count()
    digests = checkpointed(hashed.withColumn("row", F.monotonically_increasing_id()), parts_of(n, 10_000))
    seen = possibly_repeated(digests, range_bits)
    alone = seen.where(~F.col("maybe")).select("doc_id", "text_hash", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = seen.where("maybe")
    groups = checkpointed(again.groupBy("text_hash").agg(F.max(F.struct("doc_id", F.negative("row").alias("back"))).alias("top"), F.count(F.lit(1)).alias("group_size")), parts_of(n))
    large = F.col("group_size") * HOT_SHARE >= F.lit(n)
    hot = groups.where(large)
    settled = [again.join(F.broadcast(hot), "text_hash"), again.join(F.broadcast(hot.select("text_hash")), "text_hash", "left_anti").join(groups.where(~large), "text_hash")]
    out = alone
    for rows in settled:
        out = out.unionByName(rows.select("doc_id", "text_hash", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("top.back")).alias("kept")))
    return out.withColumn("text_sha256", F.lower(F.hex("text_hash"))).drop("text_hash")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies over all documents, by two-pass Bloom filtering."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of equal texts only the document with the largest doc_id goes on.

    Null texts count as empty, null ids as smallest. Rows repeated in both id and text go on once, as staying_rows()
    says. An empty table stays empty; any other columns go along under their own names.
    """
    kept = exact_groups(docs).where("kept").select(row_key(F.col("doc_id"), F.unhex(F.substring("text_sha256", 1, 32))).alias("key"))
    return staying_rows(docs, kept)
