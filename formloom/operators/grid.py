"""Operators on grids and ordered rows: offsets, row layout, nearest marks, sections, boxes of the plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.session import shared_folder


def at_offset(cells: DataFrame, by: list[str], position: str, offset: int, value: str, name: str) -> DataFrame:
    """cells with the value of each cell at position + offset of the same group; an equi-join on the computed key."""
    other = cells.select(*by, (F.col(position) - offset).alias(position), F.col(value).alias(name))
    return cells.join(other, [*by, position])


def in_rows(cells: DataFrame, index: Column, columns: int) -> DataFrame:
    """cells with grid_row and grid_column of a row-major layout."""
    return cells.withColumn("grid_row", F.floor(index / columns)).withColumn("grid_column", index % columns)


def nearest(rows: DataFrame, by: list[str], position: str, mark: Column, name: str) -> DataFrame:
    """rows with the distance to the nearest marked row of the group, null where it has none."""
    w = Window.partitionBy(*by).orderBy(position)
    marked = F.when(mark, F.col(position))
    before = F.last(marked, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The next mark is the last one in the opposite order, whose frame grows and isn't computed anew for each row.
    back = Window.partitionBy(*by).orderBy(F.col(position).desc())
    after = F.last(marked, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(name, F.least(F.col(position) - before, after - F.col(position)))


def sections(rows: DataFrame, by: list[str], order: list[Column], start: Column) -> DataFrame:
    """rows with the number of start marks up to each of them; 0 before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.sum(F.when(start, 1).otherwise(0)).over(w))


def _three_nearest(met: DataFrame, place: list[str]) -> DataFrame:
    """place with near: its three nearest cells as (d, cell, n), the smaller among equals, and the rows that n stands for of each."""
    each = met.groupBy(*place, "cell").agg(F.min("d").alias("d"), F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("d", "cell"))
    return each.withColumn("rank", rank).where("rank <= 3").groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("d", "cell", "n"))).alias("near"))


def best_box(points: DataFrame, centres: DataFrame, key: str, reach: int) -> DataFrame:
    """(key, cell, ambiguous): the nearest centre within reach of a point on both axes, the smaller key among equals, and whether
    there are more; never the point itself, nor others of its key. x and y are whole numbers.

    What stands at one place is one row with its three smallest keys, and each place asks once. It looks as far as 1, 4, 16 and so
    on up to reach, each time on the four tiles, twice as wide, that hold all that is so near. Three keys are enough: without the
    point's own there is a nearest one and another. Places that lack them go on, and as few such places fit on a tile where points
    are centres too, the places that are compared grow with their number and not with its square.
    """
    shared_folder(points.sparkSession)  # each round is checkpointed
    placed = lambda df, name: df.select(F.col(key).alias(name), "x", "y").dropna()
    asked = placed(points, "key")
    places = _three_nearest(placed(centres, "cell").select("*", F.lit(0).cast("long").alias("d"), F.lit(1).alias("n")), ["x", "y"]).checkpoint()
    rest, done = asked.select("x", "y").distinct().join(places, ["x", "y"], "left").checkpoint(), None
    few = F.coalesce(F.size("near"), F.lit(0)) < 3
    for far in [*(4**i for i in range(reach.bit_length()) if 4**i < reach), reach]:
        settled = rest.where(~few)
        done, rest = done.unionByName(settled) if done is not None else settled, rest.where(few).select("x", "y")
        tile = lambda at, far=far: F.floor(at / (2 * far))
        two = lambda at, far=far: F.explode(F.array(tile(F.col(at) - far), tile(F.col(at) - far) + 1))
        asks = rest.select("x", "y", two("x").alias("tile_x")).select("*", two("y").alias("tile_y"))
        there = places.select(F.col("x").alias("cx"), F.col("y").alias("cy"), "near", tile(F.col("x")).alias("tile_x"), tile(F.col("y")).alias("tile_y"))
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        so_near = dx * dx + dy * dy <= far * far if far < reach else (F.abs(dx) <= reach) & (F.abs(dy) <= reach)
        met = asks.join(there, ["tile_x", "tile_y"]).where(so_near).select("x", "y", (dx * dx + dy * dy).alias("d"), F.explode("near").alias("c")).select("x", "y", "d", "c.cell", "c.n")
        rest = rest.join(_three_nearest(met, ["x", "y"]), ["x", "y"], "left").checkpoint()
    others = F.filter("near", lambda c: c["cell"] != F.col("key"))
    found = asked.join(done.unionByName(rest), ["x", "y"]).select(F.col("key").alias(key), others.alias("others")).where(F.size("others") > 0)
    found = found.select(key, F.col("others")[0].alias("best"), F.aggregate("others", F.lit(0).cast("long"), lambda total, c: total + c["n"]).alias("n"))
    return found.groupBy(key).agg(F.min_by("best.cell", F.struct("best.d", "best.cell")).alias("cell"), (F.sum("n") > 1).alias("ambiguous"))
