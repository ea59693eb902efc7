"""Boxes on the plane (x, y, w, h): which ones touch, whatever their sizes, and the cell that an object belongs to.

A box lies on the tiles that it covers, tiles being as large as the larger box of a pair, so it covers four of them at most on each
level; a pair is found on one tile alone, the one that holds the upper left corner of what they share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.session import shared_folder

#: Candidates whose shares differ by less are ambiguous; most confidence of each way of matching.
AMBIGUOUS, INSIDE_MOST, OVERLAP_MOST, NEAREST_MOST = 0.05, 0.8, 0.8, 0.6


def _level(extent: Column, least: float) -> Column:
    """The power of two of tiles that an extent covers two of in each direction at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(least)) / least))).cast("int")


def _tiled(boxes: DataFrame, by: list[str], side: str, least: float, top: int) -> DataFrame:
    """by, box as a struct named side, level of the box, and a row for each level from its own to top and each tile on it."""
    placed = boxes.select(*by, F.struct("id", "x", "y", "w", "h").alias(side), _level(F.greatest("w", "h"), least).alias(f"level_{side}"))
    placed = placed.select("*", F.explode(F.sequence(F.col(f"level_{side}"), F.greatest(F.lit(top), F.col(f"level_{side}")))).alias("level"))
    tile = lambda at: F.floor(at / (least * F.pow(F.lit(2.0), "level"))).cast("long")
    span = lambda at, size: F.sequence(tile(F.col(f"{side}.{at}")), tile(F.col(f"{side}.{at}") + F.col(f"{side}.{size}")))
    return placed.select("*", F.explode(span("x", "w")).alias("tile_x")).select("*", F.explode(span("y", "h")).alias("tile_y"))


def touching(left: DataFrame, right: DataFrame, by: list[str], least: float = 1.0) -> DataFrame:
    """(by, a, b): each pair of a box of left and one of right (by, id, x, y, w, h) that share a point, edges included, once.

    by: columns that both must share, such as a document. least: extents below it count as this much, so points are boxes too. A
    pair meets on the level of its larger box; a box is on as many levels as there are powers of two between it and the largest
    box, and on four tiles of each at most. Boxes with nulls touch nothing.
    """
    whole = lambda df: df.dropna(subset=["x", "y", "w", "h"])
    top = max((d.agg(F.max(_level(F.greatest("w", "h"), least))).first()[0] or 0) for d in (whole(left), whole(right)))
    a, b = _tiled(whole(left), by, "a", least, top), _tiled(whole(right), by, "b", least, top)
    met = a.join(b, [*by, "level", "tile_x", "tile_y"]).where(F.col("level") == F.greatest("level_a", "level_b"))
    met = met.where((F.col("a.x") <= F.col("b.x") + F.col("b.w")) & (F.col("b.x") <= F.col("a.x") + F.col("a.w")) & (F.col("a.y") <= F.col("b.y") + F.col("b.h")) & (F.col("b.y") <= F.col("a.y") + F.col("a.h")))
    corner = lambda at, tile: F.floor(F.greatest(f"a.{at}", f"b.{at}") / (least * F.pow(F.lit(2.0), "level"))) == F.col(tile)
    return met.where(corner("x", "tile_x") & corner("y", "tile_y")).select(*by, "a", "b")


def _centre(box: str) -> tuple[Column, Column]:
    return F.col(f"{box}.x") + F.col(f"{box}.w") / 2, F.col(f"{box}.y") + F.col(f"{box}.h") / 2


def _distance(a: str, b: str) -> Column:
    (ax, ay), (bx, by) = _centre(a), _centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def nearest_centres(left: DataFrame, right: DataFrame, by: list[str], least: float = 1.0) -> DataFrame:
    """(by, a, b): for each box of left the one of right whose centre is nearest, the smaller id among equals; boxes whose group has
    none on the right have no row.

    Rings of tiles: on tiles of some size, every centre within that distance lies on the box's tile or one of the eight around it.
    Boxes that find none so near go on to tiles twice as large, until none is left, so the sizes of tiles decide how many others a box
    is compared with, not the number of all. The first tiles are an eighth as wide as centres would be apart if they were spread evenly.
    """
    shared_folder(left.sparkSession)  # each round is checkpointed
    named = lambda df, side: df.dropna(subset=["x", "y", "w", "h"]).select(*by, F.struct("id", "x", "y", "w", "h").alias(side))
    a, b = named(left, "a"), named(right, "b")
    groups = b.select(*by).distinct()
    left_over = (a.join(groups, by, "left_semi") if by else a if b.head(1) else a.limit(0)).checkpoint()
    wide, high, n, kinds = b.agg(F.max("b.x") - F.min("b.x"), F.max("b.y") - F.min("b.y"), F.count(F.lit(1)), F.countDistinct(*by) if by else F.lit(1)).first()
    size, found = max(least, math.sqrt((wide or 0) * (high or 0) * (kinds or 1) / max(n, 1)) / 8), None
    while left_over.head(1):
        tile = lambda at, size=size: F.floor(at / size).cast("long")
        around = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
        (ax, ay), (bx, by_) = _centre("a"), _centre("b")
        asks = left_over.select("*", F.explode(F.transform(around, lambda i: tile(ax) + i)).alias("tile_x")).select("*", F.explode(F.transform(around, lambda i: tile(ay) + i)).alias("tile_y"))
        near = asks.join(b.withColumn("tile_x", tile(bx)).withColumn("tile_y", tile(by_)), [*by, "tile_x", "tile_y"]).where(_distance("a", "b") <= size)
        best = near.groupBy(*by, "a").agg(F.min(F.struct(_distance("a", "b").alias("far"), "b.id", "b")).alias("best")).select(*by, "a", "best.b").checkpoint()
        found = best if found is None else found.unionByName(best)
        left_over = left_over.join(best.select(*by, F.col("a.id").alias("done")), [*(left_over[c].eqNullSafe(best[c]) for c in by), left_over["a.id"] == F.col("done")], "left_anti").checkpoint()
        size *= 2
    return found if found is not None else a.select(*by, "a", F.col("a").alias("b")).limit(0)


def cell_candidates(objects: DataFrame, cells: DataFrame, by: list[str], least: float = 1.0) -> DataFrame:
    """(by, object_id, cell_id, reason, overlap, distance, confidence, ambiguous): the cells that an object may belong to.

    CENTER_INSIDE_CELL: cells that hold its centre, edges included; if there are none, BBOX_OVERLAP: cells that share an area with
    it; else NEAREST_CELL: the one whose centre is nearest. overlap is the shared part of the object's area, which counts as 1 at
    least. Where the two best shares differ by less than AMBIGUOUS the object is ambiguous, and nothing is settled. An object without
    a place (nulls) is NO_GEOMETRY, one in a group without any placed cell NO_CELL_GEOMETRY; both have no cell and confidence 0.
    by must not be null. Ids are unique in a group. Other columns aren't read.
    """
    shared_folder(objects.sparkSession)  # what is found so far is checkpointed
    shape = ["id", "x", "y", "w", "h"]
    objects, cells = objects.select(*by, *shape), cells.select(*by, *shape)
    side = lambda at, size: F.greatest(F.lit(0.0), F.least(F.col(f"a.{at}") + F.col(f"a.{size}"), F.col(f"b.{at}") + F.col(f"b.{size}")) - F.greatest(f"a.{at}", f"b.{at}"))
    met = touching(objects, cells, by, least).withColumn("overlap", side("x", "w") * side("y", "h") / F.greatest(F.lit(1.0), F.col("a.w") * F.col("a.h")))
    cx, cy = _centre("a")
    inside = cx.between(F.col("b.x"), F.col("b.x") + F.col("b.w")) & cy.between(F.col("b.y"), F.col("b.y") + F.col("b.h"))
    met = met.withColumn("inside", inside).where("inside OR overlap > 0")
    one = Window.partitionBy(*by, "a.id")
    met = met.withColumn("any_inside", F.max("inside").over(one)).where("inside OR NOT any_inside").checkpoint()
    place = met.withColumn("n", F.count(F.lit(1)).over(one)).withColumn("place", F.row_number().over(one.orderBy(F.desc("overlap"), "b.id")))
    two = place.groupBy(*by, F.col("a.id").alias("object_id")).agg((F.max(F.when(F.col("place") == 1, F.col("overlap"))) - F.max(F.when(F.col("place") == 2, F.col("overlap"))) < AMBIGUOUS).alias("close"))
    share = F.least(F.lit(1.0), F.col("overlap"))
    confidence = F.when(F.col("inside"), F.least(F.lit(INSIDE_MOST), 0.5 + 0.3 * share)).otherwise(F.least(F.lit(OVERLAP_MOST), 0.3 + 0.5 * share))
    hit = met.select(*by, F.col("a.id").alias("object_id"), F.col("b.id").alias("cell_id"), F.when(F.col("inside"), "CENTER_INSIDE_CELL").otherwise("BBOX_OVERLAP").alias("reason"), F.round("overlap", 4).alias("overlap"), F.round(_distance("a", "b"), 2).alias("distance"), F.round(confidence, 3).alias("confidence"))
    hit = hit.join(two, [*by, "object_id"]).select("*", F.coalesce("close", F.lit(False)).alias("ambiguous")).drop("close")

    there = objects.dropna(subset=["x", "y", "w", "h"])
    apart = there.withColumnRenamed("id", "object_id").join(hit.select(*by, "object_id").distinct(), [*by, "object_id"], "left_anti").withColumnRenamed("object_id", "id")
    near = nearest_centres(apart, cells, by, least)
    diagonal = F.sqrt(F.col("a.w") * F.col("a.w") + F.col("a.h") * F.col("a.h"))
    closeness = F.greatest(F.lit(0.0), 1 - _distance("a", "b") / (F.when(diagonal > 0, diagonal).otherwise(1.0) * 4))
    near = near.select(*by, F.col("a.id").alias("object_id"), F.col("b.id").alias("cell_id"), F.lit("NEAREST_CELL").alias("reason"), F.lit(0.0).alias("overlap"), F.round(_distance("a", "b"), 2).alias("distance"), F.round(F.least(F.lit(NEAREST_MOST), 0.2 + 0.4 * closeness), 3).alias("confidence"), F.lit(False).alias("ambiguous"))

    placed = cells.dropna(subset=["x", "y", "w", "h"]).select(*by).distinct().withColumn("has_cells", F.lit(True))
    bare = F.col("x").isNull() | F.col("y").isNull() | F.col("w").isNull() | F.col("h").isNull()
    none = objects.join(placed, by, "left").withColumn("bare", bare).where("bare OR has_cells IS NULL") if by else objects.withColumn("bare", bare).where("bare")
    none = none.select(*by, F.col("id").alias("object_id"), F.lit(None).cast(cells.schema["id"].dataType).alias("cell_id"), F.when(F.col("bare"), "NO_GEOMETRY").otherwise("NO_CELL_GEOMETRY").alias("reason"), F.lit(None).cast("double").alias("overlap"), F.lit(None).cast("double").alias("distance"), F.lit(0.0).alias("confidence"), F.lit(False).alias("ambiguous"))
    return hit.unionByName(near).unionByName(none)
