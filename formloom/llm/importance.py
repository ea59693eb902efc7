"""Importance resampling towards a target: hashed n-gram counts in CSR blocks, gains by their column sums, weights by a
sparse matrix-vector product, and the highest scores of a seeded random draw."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import checkpointed, parts_of, release, squeeze, table, text_of, texts_as_bytes, unsqueeze

#: Words of a feature at most, hash buckets, seed of the draw, least words of a document that may be drawn, percent drawn.
NGRAM, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of text and rows that one CSR block is made of, about.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 8192
#: Scores are binned by this much to find where the draw ends; ranks are exact.
BIN = 64
#: What each byte of a text becomes before it is cut at spaces: A-Z in lower case; ASCII but letters and digits separates.
LETTERS = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def feature_hashes(text: bytes, ngram: int = NGRAM) -> tuple[np.ndarray, int]:
    """(crc32 of every run of 1 to ngram words of a UTF-8 text, its number of words)."""
    words = text.translate(LETTERS).split()
    runs = [words] + [[b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, ngram + 1)]
    return np.concatenate([np.fromiter(map(zlib.crc32, r), np.uint32, len(r)) for r in runs]), len(words)


def csr_blocks(docs: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rows long, doc_ids, matrix binary): the document-by-bucket counts as CSR blocks, in the order of the rows as read.

    doc_ids: ids, whether there is one, words, features. matrix: where each row begins, bucket numbers (rising in a row), counts.
    Null texts are rows without entries. A block is made of about BLOCK_BYTES of text; a row has `buckets` entries at most, however
    long its text is. Other columns aren't read; a table without rows has no blocks.
    """

    def block(ids: list, hashes: list[np.ndarray], words: list[int]) -> dict:
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        cell = np.repeat(np.arange(len(hashes), dtype=np.int64), sizes) * buckets + np.concatenate(hashes) % np.uint32(buckets)
        cell, n = np.unique(cell, return_counts=True)
        start = np.searchsorted(cell, np.arange(len(hashes) + 1, dtype=np.int64) * buckets)
        named = np.array([i is not None for i in ids])
        about = squeeze(np.array([i or 0 for i in ids], np.int64), named, np.array(words, np.int64), sizes)
        return {"rows": len(ids), "doc_ids": about, "matrix": squeeze(start.astype(np.uint32), (cell % buckets).astype(np.uint32), n.astype(np.uint32))}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, words, size = [], [], [], 0
        for x in batches:
            for i, text in zip(x.column(0).to_pylist(), texts_as_bytes(pa.chunked_array([x.column(1)]))):
                found, n = feature_hashes(text, ngram)
                ids.append(i), hashes.append(found), words.append(n)
                size += len(text)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                    yield pa.RecordBatch.from_pylist([block(ids, hashes, words)], schema)
                    ids, hashes, words, size = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([block(ids, hashes, words)], schema)
        release()

    schema = pa.schema([("rows", pa.int64()), ("doc_ids", pa.binary()), ("matrix", pa.binary())])
    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(gather, "rows long, doc_ids binary, matrix binary")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket that has any; a task adds up its blocks before it sends `buckets` rows at most."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for x in batches:
            for value in x.column(0):
                _, at, n = unsqueeze(value.as_py(), "u4", "u4", "u4")
                np.add.at(total, at, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])
        release()

    return blocks.select("matrix").mapInArrow(add_up, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of its share in target over its share in source, both add-one smoothed.

    source, target: (bucket, n). There are `buckets` rows, whatever the input.
    """
    spark = source.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    totals = F.broadcast(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(totals).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def block_weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row per row of the blocks' matrix: the floored mean gain of its features, 0
    where it has none. gains: one number for each bucket."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for about, matrix in zip(x.column(0), x.column(1)):
                ids, named, words, features = unsqueeze(about.as_py(), "i8", "?", "i8", "i8")
                start, at, n = unsqueeze(matrix.as_py(), "u4", "u4", "u4")
                upto = np.r_[0, np.cumsum(gains[at] * n.astype(np.int64))]
                weight = (upto[start[1:]] - upto[start[:-1]]) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~named), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
        release()

    return blocks.select("doc_ids", "matrix").mapInArrow(product, "doc_id long, n_words long, n_features long, weight long")


def draw_noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, from the first 32 bits of a hash of seed and id (a null id's is that of `null`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with a column rank: 1, 2, 3, ... for the highest scores among the rows with at
    least min_words words, percent of them (floored); null for the others. Ties go to the smaller doc_id, null last; rows that
    share id and score too are taken as they come.

    A count by bins of scores shows how far down the draw can reach. Only rows above that are ordered: by ranges of (score,
    doc_id), within each range, and by what stands in the ranges before it, so no task sees more than its range.
    """
    n = scored.count()
    rows = checkpointed(scored.withColumn("row", F.monotonically_increasing_id()), parts_of(n, 20_000))
    able = rows.where(F.col("n_words") >= min_words)
    bins = able.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Scores are sums of two logarithms of counts in thousandths, so their bins are a few thousand at any size.
    upto = checkpointed(bins.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("bin")))), 1)
    quota = percent * (upto.agg(F.sum("n")).first()[0] or 0) // 100
    if not quota:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("row")
    least = upto.where(F.col("upto") >= quota).agg(F.max("bin")).first()[0] * BIN
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    top = able.where(F.col("score") >= least).select("row", "doc_id", "score")
    ranges = checkpointed(top.repartitionByRange(parts_of(max(1, top.count()), 20_000), *order).withColumn("range", F.spark_partition_id()))
    before = ranges.groupBy("range").count().select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    ranked = ranges.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order))).join(F.broadcast(before), "range")  # a row for each range
    ranked = ranked.select("row", (F.col("before") + F.col("place")).cast("long").alias("rank")).where(F.col("rank") <= quota)
    return rows.join(ranked, "row", "left").drop("row")


def resampled(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS, target_id: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row per row of docs (doc_id, text).

    target: (target_id, text), whose distribution of features the draw leans to. Weight is the mean gain of a document's features,
    score adds seeded noise, rank counts the documents drawn. Null texts count as empty; repeated rows are rows of their own with
    the same score; ids that are null share one noise. Other columns aren't read; without documents there are no rows, and
    without target text every bucket's gain compares with equal shares.

    The matrix is written once to the checkpoint folder; its column sums and its product with the gains read it from there.
    """
    blocks = checkpointed(csr_blocks(docs, ngram, buckets))
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(column_sums(blocks, buckets), column_sums(csr_blocks(target, ngram, buckets, target_id), buckets), buckets).collect():  # `buckets` rows
        gains[r.bucket] = r.gain
    scored = block_weights(blocks, gains).withColumn("score", F.col("weight") + draw_noise(F.col("doc_id"), seed))
    return drawn(scored, percent, min_words)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighted towards the benchmark's words; a tenth of those with at least twenty words is drawn."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of UTF-8 bytes: a table of 256 numbers by eight shifts each, then a fold over the bytes. {0} is a list of bytes.
CRC_TABLE = "ct AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i))"
CRC_FOLD = "xor(list_reduce(list_prepend(4294967295::BIGINT, {0}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"
BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"

OP12_SQL = (
    r"""WITH RECURSIVE {crc_table},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
m AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM d) GROUP BY r, w),
mw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM m) GROUP BY w),
b AS (SELECT w, {crc} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM mw), ct),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM mw JOIN b USING (w) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM mw)::DOUBLE AS all_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), z),
v AS (SELECT r, sum(n) AS features, sum(n * gain) AS total FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
p AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / features), 0)::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d LEFT JOIN v USING (r)),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM p),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n FROM q WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM q LEFT JOIN k USING (r)
""".replace("{crc_table}", CRC_TABLE).replace("{crc}", CRC_FOLD.replace("{0}", BYTES.replace("{0}", "w")))
)
