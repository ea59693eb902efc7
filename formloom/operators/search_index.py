"""A kept inverted index over named entries: entries counted once by their keys, sorted postings by token, tokens by pairs of letters.

The index is a folder of generations. A batch of new records adds a generation with what is new alone; nothing that stands there is
written again. A search reads the postings of the tokens that are asked for, never the records. Files of a bucket are as large as adaptive execution makes them, so a frequent token is many files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.sinks.tables import finish_generation, generations

#: What parts the tokens of a name, the fewest letters of a token, what a token inside a longer one counts.
SEPARATORS, SHORTEST, PARTIAL = r"[\s_\-·/]+", 2, 0.4
#: Folders by hash of token or pair of letters, and entries in one row of postings at most.
BUCKETS, SEGMENT = 16, 10_000


def tokens_of(text: Column) -> Column:
    """The tokens of a text in order, repeats kept; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"(?U){SEPARATORS}"), lambda x: F.length(x) >= SHORTEST)


def _bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def extend_index(spark: SparkSession, path: str, records: DataFrame, keys: list[str], named: list[str]) -> int:
    """Adds records to the index at path as its next generation, whose number is returned; the first call begins the index.

    keys: the columns that make an entry, null being an empty string; named: those of them whose tokens find it. Records that
    share all keys are one entry, whose files are counted over all generations. Entries that the index has get their files
    counted alone. Other columns aren't kept; a batch without records adds an empty generation.
    """
    made = generations(spark, f"{path}/done")
    number = (made[-1] if made else 0) + 1
    out = lambda name: f"{path}/{name}/generation={number}"
    plain = records.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys))
    batch = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("files")).withColumn("entry", F.unhex(F.md5(F.to_json(F.struct(*keys)))))
    batch.select("entry", "files").write.parquet(out("files"))
    fresh = batch.drop("files")
    if made:
        fresh = fresh.join(index_table(spark, path, "entries").select("entry"), "entry", "left_anti")
    fresh.write.parquet(out("entries"))
    fresh = spark.read.schema(fresh.schema).parquet(out("entries"))
    found = fresh.select("entry", F.explode(F.array_distinct(tokens_of(F.concat_ws(" ", *named)))).alias("token"))
    postings = found.repartitionByRange("token", "entry").sortWithinPartitions("token", "entry").mapInArrow(_segments, "token string, n int, entries array<binary>")
    postings.withColumn("bucket", _bucket("token")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(out("postings"))
    tokens = spark.read.schema("token string, bucket int").parquet(out("postings")).select("token").distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    tokens.select("token", F.explode(F.array_distinct(pairs)).alias("pair")).withColumn("bucket", _bucket("pair")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(out("pairs"))
    finish_generation(spark, out("done"))
    return number


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entry, token) sorted by token as rows of at most SEGMENT entries; a run that goes on in another task is a row there."""
    last, held = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([len(held)], pa.int32()), pa.array([held], pa.list_(pa.binary()))], ["token", "n", "entries"])

    for x in batches:
        for entry, token in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
            if held and (token != last or len(held) == SEGMENT):
                yield row()
                held = []
            last = token
            held.append(entry)
    if held:
        yield row()


def index_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the index's tables over all whole generations: entries, files, postings or pairs."""
    whole = [f"{path}/{name}/generation={g}" for g in generations(spark, f"{path}/done")]
    return spark.read.option("basePath", f"{path}/{name}").parquet(*whole).drop("generation")


def index_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: entries, records counted into them, tokens, and rows of postings."""
    count = lambda name, c: index_table(spark, path, name).agg(c)
    parts = [count("entries", F.count(F.lit(1)).alias("entries")), count("files", F.sum("files").alias("records")), count("postings", F.countDistinct("token").alias("tokens")), count("postings", F.sum("n").alias("postings"))]
    out = parts[0]
    for more in parts[1:]:
        out = out.crossJoin(F.broadcast(more))  # one row each
    return out


def search_index(spark: SparkSession, path: str, queries: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """(query_id, rank, keys, files, score, matched): the entries with the highest scores for each query (query_id, text).

    An entry scores 1 for each token of the query that it has and PARTIAL for each longer token of its own that has it inside,
    over the number of the query's tokens. matched lists tokens in the query's order, with ~ before those found inside others
    alone. Equal scores go by the entry's hash. Queries without tokens, or without hits, give no rows.
    """
    texts = queries.select("query_id", tokens_of(F.col("text")).alias("tokens"))
    asked = texts.select("tokens").distinct().select("tokens", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))
    want = asked.select("token").distinct()
    pairs = index_table(spark, path, "pairs")
    inside = want.withColumn("pair", F.substring("token", 1, 2)).withColumn("bucket", _bucket("pair")).join(pairs.withColumnRenamed("token", "held"), ["bucket", "pair"])
    inside = inside.where(F.col("held").contains(F.col("token")) & (F.col("held") != F.col("token"))).select("token", "held").distinct()
    both = want.select("token", F.col("token").alias("held"), F.lit(1).alias("whole")).unionByName(inside.withColumn("whole", F.lit(0)))
    postings = index_table(spark, path, "postings").select("bucket", F.col("token").alias("held"), "entries")
    hits = both.withColumn("bucket", _bucket("held")).join(postings, ["bucket", "held"]).select("token", "whole", F.explode("entries").alias("entry"))
    by_token = hits.groupBy("token", "entry").agg(F.sum("whole").alias("whole"), F.sum(1 - F.col("whole")).alias("parts"))
    points = F.round(F.sum(F.col("whole") + PARTIAL * F.col("parts")) / F.col("n"), 3).alias("score")
    ranked = asked.join(by_token, "token").groupBy("tokens", "n", "entry").agg(points)
    top = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tokens").orderBy(F.desc("score"), "entry"))).where(F.col("rank") <= most)
    # What matched is put together for the entries alone that are shown.
    shown = F.when(F.col("whole") > 0, F.array("token")).otherwise(F.array_repeat(F.concat(F.lit("~"), "token"), F.col("parts").cast("int")))
    hit = top.select("tokens", "rank", "score", "entry", F.posexplode("tokens").alias("place", "token")).join(by_token, ["token", "entry"])
    hits = F.array_sort(F.collect_list(F.struct("place", shown.alias("shown"))))  # as many as the query has tokens
    top = hit.groupBy("tokens", "rank", "score", "entry").agg(F.flatten(F.transform(hits, lambda x: x["shown"])).alias("matched"))
    top = texts.join(top, "tokens").drop("tokens")
    chosen = top.select("entry").distinct()
    files = index_table(spark, path, "files").join(chosen, "entry", "left_semi").groupBy("entry").agg(F.sum("files").alias("files"))
    named = index_table(spark, path, "entries").join(chosen, "entry", "left_semi")
    return top.join(named, "entry").join(files, "entry").select("query_id", "rank", *keys, "files", "score", "matched")


def compact_index(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """The index written anew at target as one generation, postings of a token in as few rows as they need."""
    out = lambda name: f"{target}/{name}/generation=1"
    index_table(spark, path, "files").groupBy("entry").agg(F.sum("files").alias("files")).write.parquet(out("files"))
    index_table(spark, path, "entries").select(*keys, "entry").write.parquet(out("entries"))
    found = index_table(spark, path, "postings").select(F.explode("entries").alias("entry"), "token")
    found.repartitionByRange("token", "entry").sortWithinPartitions("token", "entry").mapInArrow(_segments, "token string, n int, entries array<binary>").withColumn("bucket", _bucket("token")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(out("postings"))
    index_table(spark, path, "pairs").select("token", "pair", "bucket").distinct().hint("rebalance", "bucket").write.partitionBy("bucket").parquet(out("pairs"))
    finish_generation(spark, out("done"))
