"""Keyed operators: upserts, work lists, anti joins, as-of and interval joins, islands, top rows, set overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, by: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """rows with their number, from 1, in the order of their group.

    bucket: a whole number that never falls along the order. Rows are numbered inside their bucket, and the rows of the
    buckets before are added from counts, so a large group is many tasks and only its counts meet in one.
    """
    b, n, ahead = (fresh(rows, c) for c in ("bucket", "bucket_rows", "rows_ahead"))
    placed = rows.withColumn(b, bucket)
    counts = placed.groupBy(*by, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(ahead, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    inside = placed.withColumn(name, F.row_number().over(Window.partitionBy(*by, b).orderBy(*order)))
    keys = [*by, b]
    side = starts.select(*(F.col(k).alias(f"{k}__of") for k in keys), ahead)
    same = [inside[k].eqNullSafe(side[f"{k}__of"]) for k in keys]
    return inside.join(side, same).withColumn(name, F.col(name) + F.col(ahead)).select(*rows.columns, name)


def latest_wins(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """base with changes put in by key: of rows with one key the largest version stays."""
    new, n = fresh(base, "is_new"), fresh(base, "nth")
    rows = base.withColumn(new, F.lit(0)).unionByName(changes.withColumn(new, F.lit(1)))
    top = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col(new).desc())
    return rows.withColumn(n, F.row_number().over(top)).where(F.col(n) == 1).drop(n, new)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows of new whose key it doesn't have."""
    return base.unionByName(new.join(base.select(*keys).distinct(), keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of old, less those of parents in new, and all of new."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def work_list(items: DataFrame, done: DataFrame, key: str, shard: int, shards: int) -> DataFrame:
    """Items of a shard that are not done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti").where(F.pmod(F.col(key), F.lit(shards)) == shard)


def promoted(base: DataFrame, staged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns of staged where it has the key; a staged null overwrites."""
    new, there = {c: fresh(base, f"new_{c}") for c in columns}, fresh(base, "is_staged")
    side = staged.select(key, *(F.col(c).alias(new[c]) for c in columns)).withColumn(there, F.lit(True))
    joined = base.join(side, key, "left")
    return joined.select(*(F.when(F.col(there), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def as_of(rows: DataFrame, by: list[str], order: list[Column], mark: Column, value: Column, name: str) -> DataFrame:
    """rows with the value of the last marked row before or at each row, in the order of its group."""
    back = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(F.when(mark, value), ignorenulls=True).over(back))


def neighbours(rows: DataFrame, by: list[str], order: list[Column], value: str, before: str, after: str) -> DataFrame:
    """rows with the value before and after each in the order of its group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(before, F.lag(value).over(w)).withColumn(after, F.lead(value).over(w))


def islands(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """(by, first, last, n): runs of consecutive whole-number positions; repeated positions count once."""
    once = rows.select(*by, position).distinct()
    run = F.col(position) - F.row_number().over(Window.partitionBy(*by).orderBy(position))
    name = fresh(once, "run")
    return once.withColumn(name, run).groupBy(*by, name).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop(name)


def runs(rows: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """(by, value, n): lengths of the runs of equal values in the order of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    new, run = fresh(rows, "is_new"), fresh(rows, "run")
    marked = rows.withColumn(new, changed).withColumn(run, F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, run, value).agg(F.count(F.lit(1)).alias("n")).select(*by, value, "n")


def overlapping(rows: DataFrame, by: list[str], order: list[Column], start: str, end: str) -> DataFrame:
    """rows with whether an earlier one of the group still runs when the row starts."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("overlaps", F.coalesce(F.max(end).over(before) >= F.col(start), F.lit(False)))


def top_rows(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, numbered."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def first_of_pair(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in an order that leaves no choice."""
    return top_rows(rows, by, order, 1).drop("place")


def set_overlap(items: DataFrame, item: str, tokens: Column, query: list[str], least: float) -> DataFrame:
    """(item, common, jaccard) of items whose distinct tokens (an array) overlap the query's enough; no shuffle."""
    wanted = sorted(set(query))
    sets = items.select(item, F.array_distinct(tokens).alias("tokens"))
    by_item = sets.select(item, F.size("tokens").alias("tokens"), F.size(F.array_intersect("tokens", F.array(*(F.lit(w) for w in wanted)))).cast("long").alias("common")).where("common > 0")
    jaccard = F.col("common") / (F.col("tokens") + len(wanted) - F.col("common"))
    return by_item.withColumn("jaccard", F.round(jaccard, 6)).where(F.col("jaccard") >= least).select(item, "common", "jaccard")


def disagreements(rows: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Pairs of versions of a key, the smaller first, whose values differ."""
    a = rows.select(key, F.col(version).alias("version_a"), F.col(value).alias("value_a"))
    b = rows.select(key, F.col(version).alias("version_b"), F.col(value).alias("value_b"))
    return a.join(b, key).where("version_a < version_b AND value_a <> value_b")
