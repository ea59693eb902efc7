"""Filter interaction audit: every order of the filters is replayed on every document, and what each step removes is counted."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import WORD, checkpointed, fresh, parts_of, table, text_hash, text_of

#: Fewest words, least share of distinct words and largest share of capitals (both in percent), and marks that no text may hold.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
#: A group of equal texts with at least this share of all rows is joined by broadcast; there are at most as many as its inverse.
HOT_SHARE = 1000
#: Documents that one task replays; each of them becomes a row for every order and step before it is counted.
DOCS_PER_TASK = 20_000


def text_failures(text: Column) -> dict[str, Column]:
    """Filter -> whether a text fails it, for the filters that look at one text alone. An empty text fails A only."""
    # Cutting at white space leaves an empty string where a text begins or ends with it.
    words = F.array_remove(F.split(text, WORD.replace("[^", "[")), "")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }


def repeats_smaller(rows: DataFrame, found: str = "repeats") -> DataFrame:
    """rows (doc_id, text_hash, ...) with a column that says whether a smaller doc_id has the same text_hash.

    Rows without an id neither repeat nor are repeated. The smallest ids are found with map-side combining; groups of a
    thousandth of all rows or more, a thousand at most, are joined by broadcast, all others by their hash. So no task gets
    all rows of a large group. An empty table stays empty.
    """
    n = rows.count()
    groups = rows.where("doc_id IS NOT NULL").groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = checkpointed(groups, parts_of(n))
    large = F.col("copies") * HOT_SHARE >= F.lit(n)
    hot = groups.where(large).select("text_hash", F.col("first_id").alias("hot_id"))
    rest = groups.where(~large).select("text_hash", "first_id")
    led = rows.join(F.broadcast(hot), "text_hash", "left")
    led = led.withColumn("known", F.col("hot_id").isNotNull() | F.col("doc_id").isNull())
    settled = led.where("known").withColumn("first_id", F.col("hot_id"))
    joined = settled.unionByName(led.where("NOT known").join(rest, "text_hash", "left"))
    return joined.withColumn(found, F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("known", "hot_id", "first_id")


def replay_orders(spark: SparkSession, names: list[str]) -> DataFrame:
    """(filter_order, bits): every order of the filters, its filters' bits in that order. names in order take bits 1, 2, 4, ..."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    return spark.createDataFrame([("".join(p), [bit[x] for x in p]) for p in permutations(names)], "filter_order string, bits array<int>")


def audited(flagged: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    flagged: part string, one boolean column for each filter (true: fails it), good and toxic booleans; no nulls among them
    but in part, which counts as an empty string. Other columns aren't read. Every document is crossed with all orders and every
    step of each; the first step that fails decides where it goes. Counts are combined before they are shuffled, so a
    task sends as many rows as there are parts, orders and steps. A table without rows has no parts and gives none.
    """
    spark, n = flagged.sparkSession, flagged.count()
    mask = reduce(lambda a, b: a + b, (F.when(F.col(f"`{name}`"), 1 << i).otherwise(0) for i, name in enumerate(names)))
    docs = flagged.select(F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), "good", "toxic")
    docs = docs.repartition(max(1, -(-n // DOCS_PER_TASK)))  # the rows are few bytes, the work is hundreds of rows for each
    orders = F.broadcast(replay_orders(spark, names))  # as many rows as the filters have orders, whatever the input
    steps = len(names)
    bit = lambda i: F.element_at("bits", i)
    # The first step whose filter the document fails; behind the last one if it fails none.
    first = reduce(lambda later, i: F.when(F.col("mask").bitwiseAND(bit(i)) != 0, i).otherwise(later), range(steps, 0, -1), F.lit(steps + 1))
    replayed = docs.crossJoin(orders).withColumn("first", first).select("*", F.posexplode("bits").alias("at", "own"))
    step, fails = F.col("at") + 1, F.col("mask").bitwiseAND(F.col("own")) != 0
    removed = F.col("first") == step
    counted = replayed.groupBy("part", "filter_order", step.alias("step")).agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(fails & (F.col("first") < step)).alias("redundant"),
        F.count_if(F.col("mask") == F.col("own")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    counted = checkpointed(counted.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))), 1)
    shapley = counted.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counted.join(shapley, ["part", "filter"]).drop("filter")


def flagged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E, good, toxic), one row per row of docs (doc_id, text, lang); see text_failures().

    E: a smaller doc_id has the same text, anywhere in the table. Null texts count as empty. A document is good or toxic if any row of
    labels with its id says so; rows without an id have no labels. Repeated rows are rows of their own, with the same id, so
    they don't make each other fail. Other columns aren't read. Texts are read once and not shuffled: their hashes and flags are.
    """
    text = fresh(docs, "text_")
    shown = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of().alias(text))
    flags = [value.alias(name) for name, value in text_failures(F.col(text)).items()]
    rows = checkpointed(shown.select(F.col("doc_id").cast("long").alias("doc_id"), "part", text_hash(text).alias("text_hash"), *flags))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    # Ids that are null have no partner; they are dealt by their text's hash, so that they don't meet in one task.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text_hash")).otherwise(0)
    led = repeats_smaller(rows, "E").withColumn("spread", spread).join(told.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    return led.select("doc_id", "part", "A", "B", "C", "D", "E", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over all documents, by language."""
    return audited(flagged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), list("ABCDE"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT part, good, toxic, fails, filter_order, step, substr(filter_order, step, 1) AS filter,
  length(regexp_extract(filter_order, CASE WHEN fails = '' THEN '.*' ELSE '^[^' || fails || ']*' END)) + 1 AS first
  FROM f, o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
c AS (SELECT part, filter_order, step, any_value(filter) AS filter, count(*) FILTER (WHERE first > step)::BIGINT AS kept, count(*) FILTER (WHERE first = step)::BIGINT AS removed,
  count(*) FILTER (WHERE first < step AND contains(fails, filter))::BIGINT AS redundant, count(*) FILTER (WHERE fails = filter)::BIGINT AS unique_fails,
  count(*) FILTER (WHERE first = step AND good)::BIGINT AS good_lost, count(*) FILTER (WHERE first = step AND toxic)::BIGINT AS toxic_lost
  FROM s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM c
"""
