"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import WORD, checkpointed, fresh, parts_of, table, text_of

#: Sources in order take these weights in turn; no target is above CAP times its source's size.
WEIGHTS, CAP = (1, 2, 3), 3
SEED = "mix-1"
#: Rows of all sources that share a range of random keys, about, and the least number of ranges of a source.
ROWS_PER_RANGE, MIN_RANGES = 500, 16


def word_count(text: Column) -> Column:
    """The number of words; cheaper than cutting them out: a word ends where white space or the end follows."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ranked_sources(sizes: DataFrame, parts: int | None = None) -> DataFrame:
    """(source, source_size, rank): ranks from 0 by code point, null last, without putting all sources in one task.

    Ranges of sources are sorted on their own and the rows of the ranges before are added; only a row for each range
    meets in one task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), parts)
    before = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("place", place).join(before.select("part", "before"), "part").select("source", "source_size", (F.col("before") + F.col("place") - 1).alias("rank"))


def with_targets(ranked: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, parts: int | None = None) -> DataFrame:
    """Adds target: the total of all sizes shared by weight; what a source can't take is shared again among the rest."""
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = checkpointed(ranked.withColumn("weight", weight), parts)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # each round only adds sources that are full, so the level rises to its end in a few rounds
        open_ = ~(F.lit(cap) * F.col("source_size") < F.col("weight") * F.lit(level))
        held, weights_left, n = sources.agg(
            F.sum(F.when(~open_, cap * F.col("source_size"))), F.sum(F.when(open_, F.col("weight"))), F.count(F.when(~open_, 1))
        ).first()
        if n == full or not weights_left:
            break
        level, full = (total - (held or 0)) / weights_left, n
    return sources.withColumn("target", F.least((cap * F.col("source_size")).cast("double"), F.col("weight") * F.lit(level)))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, epochs, before, budget, taken.

    Size is the number of words (null text: 0). A source gives its documents in the order of a seeded hash of doc_id:
    whole epochs first, then a last part that ends at its exact budget (its target, rounded), inside a document if need
    be. So taken = epochs * size + what the last part reaches of the document. Null ids, null sources (ranked last),
    empty texts and repeated rows are rows like any other; empty input gives no rows. Reruns agree.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    n = docs.count()
    sizes = checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size")).withColumn("key", key), parts_of(n, 10_000))
    ranges = max(MIN_RANGES, 1 << (n // ROWS_PER_RANGE).bit_length())
    targets = with_targets(ranked_sources(sizes, parts_of(n)), weights, cap, parts_of(n)).select("source", "source_size", "target")
    # Hex digits are random, so equal ranges of their first eight hold about equally many documents of any source.
    spread = sizes.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges), 32))
    sums = spread.groupBy("source", "range").agg(F.sum("size").alias("words"))
    # Prefix sums in two steps: within groups of ranges, and over the groups' sums, so no task sees all ranges of a source.
    group = F.floor(F.col("range") / F.lit(1 << ((ranges.bit_length() - 1) // 2)))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = checkpointed(sums.withColumn("group", group), parts_of(n))
    of_groups = grouped.groupBy("source", "group").agg(F.sum("words").alias("of_group")).withColumn("ahead_group", before("of_group", Window.partitionBy("source").orderBy("group")))
    led = of_groups.join(targets, of_groups.source.eqNullSafe(targets.source)).select(of_groups.source.alias("_source"), F.col("group").alias("_group"), "ahead_group", "source_size", "target")
    inner = grouped.withColumn("ahead", before("words", Window.partitionBy("source", "group").orderBy("range")))
    starts = inner.join(led, inner.source.eqNullSafe(F.col("_source")) & (F.col("group") == F.col("_group"))).select("_source", F.col("range").alias("_range"), (F.col("ahead") + F.col("ahead_group")).alias("ahead"), "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    rows = placed.join(starts, placed.source.eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))).withColumn("before", F.col("ahead") + F.col("inside"))
    rows = rows.withColumn("budget", budget).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")))
    rows = rows.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "before", "budget", "taken", "key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 of their sources."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


OP4_SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
r AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s GROUP BY source),
w AS (SELECT source, source_size, (rk % 3) + 1 AS weight FROM r),
o AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total,
  coalesce(sum(3 * source_size) OVER p, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS left_w
  FROM w WINDOW p AS (ORDER BY 3.0::DOUBLE * source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min((total - held)::DOUBLE / left_w, ratio) FILTER (WHERE (total - held)::DOUBLE / left_w <= ratio), 0) AS level FROM o),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * level) AS target FROM w, l),
b AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document goes on as often as the mix takes it, whole.

    A document that the budget ends inside goes on whole if the mix takes at least half of its words, so a source
    misses its target by half a document at most. Documents without words (null and empty texts) are taken with the epochs
    alone. Rows that repeat id, source and size share what their group takes: the first ones, by text and then the other
    columns as JSON, go on once more where it can't be shared evenly. An empty table stays empty; any other columns go
    along under their own names.
    """
    mix = mixed(docs)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    times = F.col("epochs") + F.when((part > 0) & (2 * part >= F.col("size")), 1).otherwise(0)
    named = lambda source, size: F.unhex(F.md5(F.to_json(F.struct(F.col("doc_id").cast("string").alias("i"), source.cast("string").alias("s"), size.alias("n")))))
    key, copies, rows, nth, share, copy = (fresh(docs, c) for c in ("mix_key", "mix_copies", "mix_rows", "mix_nth", "mix_share", "mix_copy"))
    taken = mix.select(named(F.col("source"), F.col("size")).alias(key), times.cast("int").alias("times")).groupBy(key).agg(F.sum("times").alias(copies), F.count(F.lit(1)).alias(rows))
    keyed = docs.withColumn(key, named(F.col("source"), word_count(text_of()))).join(taken, key)
    rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "text")))
    # Only rows that stand beside others of the same id, source and size are numbered.
    order = Window.partitionBy(key).orderBy(F.when(F.col(rows) > 1, text_of()), F.when(F.col(rows) > 1, rest))
    even = F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(nth) <= F.col(copies) % F.col(rows), 1).otherwise(0)
    numbered = keyed.withColumn(nth, F.row_number().over(order)).withColumn(share, even.cast("int")).where(F.col(share) > 0)
    return numbered.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(share)))).select(*(f"`{c}`" for c in docs.columns))
