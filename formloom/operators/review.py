"""Operators of review work: majorities, resolution, routing by decisions, stratified samples, multiset coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.operators.relational import fresh, numbered


def majority(rows: DataFrame, by: list[str], value: str, item: str) -> DataFrame:
    """(by, value, agreed, conflicts, first_id): the most frequent value of a group, the smaller among equals.

    Rows are counted by value before groups are formed, so a group of many rows is a few counts.
    """
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("agreed"), F.min(item).alias("first_id"))
    group = Window.partitionBy(*by)
    place = fresh(counted, "place")
    placed = counted.withColumn(place, F.row_number().over(group.orderBy(F.col("agreed").desc(), F.col(value))))
    return placed.withColumn("conflicts", F.sum("agreed").over(group) - F.col("agreed")).where(F.col(place) == 1).select(*by, value, "agreed", "conflicts", "first_id")


def resolved(asked: DataFrame, candidates: DataFrame, keys: list[str], item: str) -> DataFrame:
    """asked with status RESOLVED, NOT_FOUND or AMBIGUOUS and the target where there is exactly one candidate."""
    n, one = fresh(asked, "candidates"), fresh(asked, "candidate")
    found = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.min(item).alias(one))
    status = F.when(F.col(n).isNull(), "NOT_FOUND").when(F.col(n) == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return asked.join(found, keys, "left").select(*asked.columns, status.alias("status"), F.when(F.col(n) == 1, F.col(one)).alias("target"))


def routed(items: DataFrame, decisions: DataFrame, key: str, seq: str) -> DataFrame:
    """items (key, blocked) with their route; of several decisions on an item the last counts."""
    last = decisions.groupBy(key).agg(F.max_by("decision", seq).alias("decision"))
    route = F.when(F.col("blocked"), "blocked").when(F.col("decision").isNull(), "pending").when(F.col("decision") == "approve", "operation").when(F.col("decision") == "reject", "skipped").otherwise("deferred")
    return items.join(last, key, "left").withColumn("route", route)


def stratified(rows: DataFrame, by: str, order: list[Column], bucket: Column, largest: int) -> DataFrame:
    """The first rows, the median and the last of each group in an order that leaves no choice, with the reason; numbered
    by buckets, as numbered() does it."""
    place, n = fresh(rows, "place"), fresh(rows, "group_rows")
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias(n)).withColumnRenamed(by, "of_group")
    placed = numbered(rows, [by], order, bucket, place).join(sizes, F.col(by).eqNullSafe(F.col("of_group"))).drop("of_group")
    p, last = F.col(place), F.col(n)
    chosen = placed.where((p <= largest) | (p == F.floor(last / 2) + 1) | (p == last))
    return chosen.withColumn("reason", F.when(p <= largest, "largest").when(p == last, "smallest").otherwise("median"))


def coverage(ours: DataFrame, truth: DataFrame, value: str) -> DataFrame:
    """(common, total, coverage): the size of the multiset intersection and its share of ours; one row.

    The share is rounded to six places as a double, not by its decimal digits, as round() does it: halves may differ.
    """
    a, b = (side.groupBy(value).agg(F.count(F.lit(1)).alias(n)) for side, n in ((ours, "n_ours"), (truth, "n_truth")))
    least = F.least("n_ours", F.coalesce("n_truth", F.lit(0)))
    sums = a.join(b, value, "left").agg(F.sum(least).alias("common"), F.sum("n_ours").alias("total"))
    return sums.withColumn("coverage", F.floor(F.col("common") / F.col("total") * 1000000 + 0.5) / 1000000)
