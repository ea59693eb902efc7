"""Marks on a line: clusters linked by small gaps, intervals joined to points, and the nearest mark within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.operators.boxes import touching

#: Letters of an upright name stand left of this, are linked over gaps up to the next number, and a name reaches from
#: this much above its first letter to this much below its last one.
MARGIN, LETTER_GAP, ABOVE, LETTER, BELOW = 82, 20, 5, 15, 60


def gap_clusters(marks: DataFrame, by: list[str], position: str, gap: float, order: list[str] | None = None) -> DataFrame:
    """marks with `cluster`, from 0: a mark is in the cluster of the one before it while it lies within `gap` of it.

    by: columns of the line, such as a page, which one task holds. order: further columns that order marks at one position. Marks
    without a position are clusters of their own before all others.
    """
    line = Window.partitionBy(*by).orderBy(F.col(position).asc_nulls_first(), *(order or []))
    new = F.when(F.col(position) - F.lag(position).over(line) <= gap, 0).otherwise(1)
    return marks.withColumn("new_", new).withColumn("cluster", F.sum("new_").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("new_")


def cluster_spans(clustered: DataFrame, by: list[str], position: str, text: str, order: list[str] | None = None, before: float = 0, after: float = 0) -> DataFrame:
    """(by, cluster, start, end, name, n): each cluster's reach, widened by before and after, and its marks' texts in their order."""
    item = F.struct(F.col(position).alias("p"), *(F.col(c) for c in order or []), F.col(text).alias("text_"))
    name = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text_"]), "")  # a cluster is part of a page
    return clustered.groupBy(*by, "cluster").agg((F.min(position) - before).alias("start"), (F.max(position) + after).alias("end"), name.alias("name"), F.count(F.lit(1)).alias("n"))


def points_in(points: DataFrame, intervals: DataFrame, by: list[str], least: float = 1.0) -> DataFrame:
    """(by, point, x, interval, start, end): each point (by, id, x) with every interval (by, id, start, end) that holds it, ends included.

    Intervals of any length, lying on each other or not: both are cut into ranges as long as the interval, rounded up to a power of
    two, and meet on the range that holds the point. Points and intervals with nulls meet nothing, nor do intervals that end before
    they start.
    """
    flat = lambda x, w: (F.col("id"), x.cast("double").alias("x"), F.lit(0.0).alias("y"), w.cast("double").alias("w"), F.lit(0.0).alias("h"))
    a = points.select(*by, *flat(F.col("x"), F.lit(0.0)))
    b = intervals.where("end >= start").select(*by, *flat(F.col("start"), F.col("end") - F.col("start")))
    met = touching(a, b, by, least)
    return met.select(*by, F.col("a.id").alias("point"), F.col("a.x").alias("x"), F.col("b.id").alias("interval"), F.col("b.x").alias("start"), (F.col("b.x") + F.col("b.w")).alias("end"))


def nearest_within(points: DataFrame, marks: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """(by, point, mark, distance): the nearest mark (by, id, x) of each point (by, id, x) within tolerance, the smaller mark among
    equals; points without one have no row."""
    reach = marks.select(*by, "id", (F.col("x") - tolerance).alias("start"), (F.col("x") + tolerance).alias("end"))
    far = F.abs(F.col("x") - (F.col("start") + F.col("end")) / 2)
    best = points_in(points, reach, by, max(1.0, tolerance)).groupBy(*by, "point").agg(F.min(F.struct(far.alias("distance"), F.col("interval").alias("mark"))).alias("b"))
    return best.select(*by, "point", "b.mark", "b.distance")


def upright_names(spans: DataFrame, by: list[str], letter: Column | None = None) -> DataFrame:
    """(by, cluster, start, end, name): names written downwards in the left margin, one Korean letter under the other, two at least.

    spans: by, x, y, text. start and end are the reach in which rows belong to the name."""
    is_letter = F.col("text").rlike("^[가-힣]$") if letter is None else letter
    rows = gap_clusters(spans.where(is_letter & (F.col("x") < MARGIN)), by, "y", LETTER_GAP, ["x"])
    named = cluster_spans(rows, by, "y", "text", ["x"], ABOVE, LETTER + BELOW).where(F.length("name") >= 2)
    return named.drop("n")


def named_rows(rows: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, name): the upright name that each row (by, id, y) belongs to, the first on the page where several reach it; rows that none
    reaches are left out."""
    found = points_in(rows.withColumnRenamed("y", "x"), names.withColumnRenamed("cluster", "id"), by, 32.0)
    first = found.groupBy(*by, "point").agg(F.min("interval").alias("cluster"))
    return first.join(names.select(*by, "cluster", "name"), [*by, "cluster"]).select(*by, F.col("point").alias("id"), "name")
