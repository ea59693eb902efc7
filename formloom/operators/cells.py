"""Operators on tables of cells (table keys, row, col, text): features, layouts, header rows, roles, input slots, labels.

`by` names the columns that make one table; row and col count from 0. Each operator is one shuffle by table, or none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions.dates import axis_mark, axis_unit
from formloom.functions.values import best_of, is_blank, is_date, is_label, is_number
from formloom.operators.spans import LEGAL, PAGES, STAMPS

#: Confidence of a slot by how it was found; an earlier kind is kept where two find one cell.
SLOTS = {"label_right": 0.85, "label_below": 0.75, "known_header": 0.7, "status": 0.6, "append_row": 0.5}
#: What stamps, short page marks and legal texts say; a table with one of these takes no input.
UNSAFE = {"stamp": STAMPS, "page_mark": f"(?i)^(?=.{{0,10}}$).*(?:{PAGES})", "legal": LEGAL}
#: Headers of progress columns.
PROGRESS = r"^(?:진행률|진척률|공정률|완료율|%|progress)$"


def row_features(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, n, filled, labels, numbers, dates, axis): counts of a row's kinds of cells; axis counts marks of time."""
    text = F.col("text")
    n = lambda c: F.count(F.when(c, 1))
    return cells.groupBy(*by, "row").agg(F.count(F.lit(1)).alias("n"), n(~is_blank(text)).alias("filled"), n(is_label(text)).alias("labels"), n(is_number(text)).alias("numbers"), n(is_date(text)).alias("dates"), n(axis_mark(text).isNotNull()).alias("axis"))


def table_features(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_rows, n_cols, blank, label, number, date, axis, top_label, left_label): size and shares of a table."""
    text, top, left = F.col("text"), F.col("row") == 0, F.col("col") == 0
    share = lambda c, of=None: F.round(F.coalesce(F.avg(F.when(of, c.cast("double")) if of is not None else c.cast("double")), F.lit(0.0)), 6)
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), share(is_blank(text)).alias("blank"), share(F.coalesce(is_label(text), F.lit(False))).alias("label"),
        share(F.coalesce(is_number(text), F.lit(False))).alias("number"), share(F.coalesce(is_date(text), F.lit(False))).alias("date"), share(axis_mark(text).isNotNull()).alias("axis"),
        share(F.coalesce(is_label(text), F.lit(False)), top).alias("top_label"), share(F.coalesce(is_label(text), F.lit(False)), left).alias("left_label"),
    )


def layouts(features: DataFrame) -> DataFrame:
    """features with layout, its score and whether a second comes near: the largest of scores made of the features."""
    c = F.col
    scores = {
        "schedule": F.when(F.round(c("axis") * c("n")) >= 2, 1.2).otherwise(0.0) + c("left_label") * 0.2,
        "form": F.when(c("n_cols") <= 4, 0.2).otherwise(0.0) + c("blank") * 0.8 + c("left_label") * 0.4,
        "data": c("top_label") * 0.6 + c("number") * 0.6,
        "list": F.when(c("n_cols") == 1, 0.7).otherwise(0.0),
        "text": (1 - c("blank")) * 0.3 + F.when(c("n") == 1, 0.3).otherwise(0.0),
    }
    return features.withColumn("best", best_of(scores, 0.4, "unknown")).select(*features.columns, F.col("best.kind").alias("layout"), F.round("best.score", 6).alias("layout_score"), F.col("best.ambiguous").alias("layout_ambiguous"))


def header_rows(cells: DataFrame, by: list[str], among: int = 4) -> DataFrame:
    """(by, row, score): of a table's first rows the one that most looks like a header, the upper among equals."""
    scored = row_features(cells.where(F.col("row") < among), by).withColumn("score", F.round((F.col("labels") + 2 * F.col("axis") - F.col("numbers") * 0.5) / F.col("n"), 6))
    best = scored.groupBy(*by).agg(F.max(F.struct("score", (-F.col("row")).alias("row"))).alias("b"))
    return best.select(*by, (-F.col("b.row")).alias("row"), "b.score").where("score > 0")


def roles(features: DataFrame) -> DataFrame:
    """features with role: schedule, input, reference, decoration or body, by layout and shares."""
    c = F.col
    role = F.when(c("layout") == "schedule", "schedule").when((c("n") <= 2) & (c("blank") >= 0.5), "decoration").when(c("blank") >= 0.25, "input").when(c("layout") == "data", "reference").otherwise("body")
    return features.withColumn("role", role)


def unsafe_tables(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, reason): tables with a cell that says they take no input, the first reason in the order of UNSAFE."""
    hit = reduce(lambda tail, item: F.when(F.col("text").rlike(item[1][1]), item[0]).otherwise(tail), reversed([*enumerate(UNSAFE.items())]), F.lit(None).cast("int"))
    names = F.array(*(F.lit(k) for k in UNSAFE))
    return cells.select(*by, hit.alias("hit")).where("hit IS NOT NULL").groupBy(*by).agg(F.min("hit").alias("hit")).select(*by, F.get(names, F.col("hit")).alias("reason"))


def _beside(cells: DataFrame, by: list[str], across: str, along: str) -> DataFrame:
    """cells with the text before each of them along a line of the table."""
    return cells.withColumn("before", F.lag("text").over(Window.partitionBy(*by, across).orderBy(along)))


def slots_beside_labels(cells: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, row, col, label, kind): blank cells that follow a label in their row (label_right) or column (label_below)."""
    across, along = ("row", "col") if kind == "label_right" else ("col", "row")
    found = _beside(cells, by, across, along).where(is_blank(F.col("text")) & is_label(F.col("before")))
    return found.select(*by, "row", "col", F.col("before").alias("label"), F.lit(kind).alias("kind"))


def slots_under_headers(cells: DataFrame, by: list[str], known: list[str]) -> DataFrame:
    """(by, row, col, label, kind): blank cells under the nearest known header of their column, whatever stands between."""
    up = Window.partitionBy(*by, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    led = cells.withColumn("label", F.last(F.when(F.col("text").isin(known), F.col("text")), ignorenulls=True).over(up))
    return led.where(is_blank(F.col("text")) & F.col("label").isNotNull()).select(*by, "row", "col", "label", F.lit("known_header").alias("kind"))


def append_slots(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, col, label, kind): for each table that ends in a row without blanks, a slot below it in each column,
    labelled by the column's first cell."""
    whole = Window.partitionBy(*by)
    lasts = cells.withColumn("last_row", F.max("row").over(whole)).withColumn("top", F.first("text").over(Window.partitionBy(*by, "col").orderBy("row")))
    ends = lasts.where("row = last_row AND row > 0").withColumn("open", F.max(is_blank(F.col("text")).cast("int")).over(whole))
    return ends.where("open = 0").select(*by, (F.col("row") + 1).alias("row"), "col", F.col("top").alias("label"), F.lit("append_row").alias("kind"))


def status_slots(cells: DataFrame, by: list[str], words: list[str]) -> DataFrame:
    """(by, row, col, label, kind): cells that say one of the states of a matter, labelled by the cell before in the row."""
    found = _beside(cells, by, "row", "col").where(F.trim("text").isin(words))
    return found.select(*by, "row", "col", F.col("before").alias("label"), F.lit("status").alias("kind"))


def all_slots(cells: DataFrame, by: list[str], known: list[str], states: list[str]) -> DataFrame:
    """(by, row, col, label, kind, confidence, review): every way of finding slots put together; a cell counts once, as
    found by the first kind of SLOTS; slots of unsafe tables stay, marked for review with half the confidence."""
    ways = [slots_beside_labels(cells, by, "label_right"), slots_beside_labels(cells, by, "label_below"), slots_under_headers(cells, by, known), status_slots(cells, by, states), append_slots(cells, by)]
    found = reduce(DataFrame.unionByName, ways)
    place = reduce(lambda tail, item: F.when(F.col("kind") == item[1], item[0]).otherwise(tail), enumerate(SLOTS), F.lit(len(SLOTS)))
    once = found.groupBy(*by, "row", "col").agg(F.min_by(F.struct("label", "kind"), place).alias("s")).select(*by, "row", "col", "s.label", "s.kind")
    return scored_slots(once.join(unsafe_tables(cells, by), by, "left"))


def scored_slots(slots: DataFrame) -> DataFrame:
    """slots (kind, label, reason) with confidence and review: by kind, a little more for a short label, capped; half in
    an unsafe table. Below 0.7, and in unsafe tables, a person looks at them."""
    base = reduce(lambda tail, item: F.when(F.col("kind") == item[0], item[1]).otherwise(tail), SLOTS.items(), F.lit(0.4))
    raised = F.least(F.lit(0.95), base + F.when(F.length("label") <= 6, 0.05).otherwise(0.0))
    confidence = F.round(F.when(F.col("reason").isNotNull(), raised / 2).otherwise(raised), 4)
    return slots.withColumn("confidence", confidence).withColumn("review", (F.col("confidence") < 0.7) | F.col("reason").isNotNull())


def input_dictionary(slots: DataFrame, files: str) -> DataFrame:
    """(label, kind, cells, files, confidence): how often and in how many files slots of a label were found."""
    return slots.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct(files).alias("files"), F.round(F.avg("confidence"), 4).alias("confidence"))


def time_axes(cells: DataFrame, by: list[str], among: int = 4, least: int = 2) -> DataFrame:
    """(by, row, unit, first_col, last_col, marks): of the first rows the one with most marks of time, the upper among
    equals, if it has `least` of them."""
    marked = cells.where(F.col("row") < among).withColumn("mark", axis_mark(F.col("text"))).where("mark IS NOT NULL")
    rows = marked.groupBy(*by, "row").agg(F.count(F.lit(1)).alias("marks"), F.min("col").alias("first_col"), F.max("col").alias("last_col"), axis_unit(F.collect_list("mark")).alias("unit"))
    best = rows.groupBy(*by).agg(F.max(F.struct("marks", (-F.col("row")).alias("back"), "unit", "first_col", "last_col")).alias("b"))
    return best.select(*by, (-F.col("b.back")).alias("row"), "b.unit", "b.first_col", "b.last_col", "b.marks").where(F.col("marks") >= least)


def bars(cells: DataFrame, axes: DataFrame, by: list[str], filled: Column) -> DataFrame:
    """(by, row, start_col, end_col, n): runs of filled cells of a row within the columns of its table's axis, below it."""
    inside = cells.join(axes.select(*by, F.col("row").alias("axis_row"), "first_col", "last_col"), by).where(filled & (F.col("row") > F.col("axis_row")) & F.col("col").between(F.col("first_col"), F.col("last_col")))
    run = F.col("col") - F.row_number().over(Window.partitionBy(*by, "row").orderBy("col"))
    return inside.withColumn("run", run).groupBy(*by, "row", "run").agg(F.min("col").alias("start_col"), F.max("col").alias("end_col"), F.count(F.lit(1)).alias("n")).drop("run")


def task_rows(cells: DataFrame, axes: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, task): rows below the axis whose first cell is not blank."""
    first = cells.where((F.col("col") == 0) & ~is_blank(F.col("text")))
    return first.join(axes.select(*by, F.col("row").alias("axis_row")), by).where("row > axis_row").select(*by, "row", F.trim("text").alias("task"))


def progress_columns(cells: DataFrame, by: list[str], among: int = 4) -> DataFrame:
    """(by, row, col): the first cell of the first rows that is a header of progress."""
    found = cells.where((F.col("row") < among) & F.lower(F.trim("text")).rlike(PROGRESS))
    return found.groupBy(*by).agg(F.min(F.struct("row", "col")).alias("p")).select(*by, "p.row", "p.col")


def bar_kinds(cells: DataFrame, axes: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, kind): what marks the cells of a row on the axis: symbols, text, numbers, or nothing."""
    inside = cells.join(axes.select(*by, F.col("row").alias("axis_row"), "first_col", "last_col"), by).where((F.col("row") > F.col("axis_row")) & F.col("col").between(F.col("first_col"), F.col("last_col")))
    n = lambda c: F.count(F.when(c & ~is_blank(F.col("text")), 1))
    symbol, number = F.col("text").rlike(r"^[■□▬━─●○◆▶→\s]+$"), is_number(F.col("text"))
    by_row = inside.groupBy(*by, "row").agg(n(symbol).alias("symbols"), n(number).alias("numbers"), n(~symbol & ~number).alias("texts"))
    return by_row.select(*by, "row", F.when((F.col("symbols") > 0) & (F.col("symbols") >= F.greatest("numbers", "texts")), "symbol").when((F.col("numbers") > 0) & (F.col("numbers") >= F.col("texts")), "number").when(F.col("texts") > 0, "text").otherwise("empty").alias("kind"))


def columns_of_spans(axes_cells: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """(spans' columns, start_col, end_col): the columns whose day lies within a span of days; null where none does.

    axes_cells: (by, col, day), one row for each column of an axis; spans: (by, start, end)."""
    on = axes_cells.withColumnRenamed("col", "axis_col")
    met = spans.join(on, by, "left")
    hit = F.when(F.col("day").between(F.col("start"), F.col("end")), F.col("axis_col"))
    return met.groupBy(*spans.columns).agg(F.min(hit).alias("start_col"), F.max(hit).alias("end_col"))


def row_labels(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells with `label`: the nearest label to the left in the row, else the nearest one above in the column."""
    mark = F.when(is_label(F.col("text")), F.col("text"))
    before = lambda across, along: F.last(mark, ignorenulls=True).over(Window.partitionBy(*by, across).orderBy(along).rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("label", F.coalesce(before("row", "col"), before("col", "row")))


def values_of(cells: DataFrame, by: list[str], label: str, most: int = 3) -> DataFrame:
    """(by, row, col, value): for each cell that a label's pattern matches, the first cell within `most` columns to its right
    that is neither blank nor a label."""
    w = Window.partitionBy(*by, "row").orderBy("col")
    good = F.when(~is_blank(F.col("text")) & ~is_label(F.col("text")), F.col("text"))
    after = F.coalesce(*(F.lead(good, i).over(w) for i in range(1, most + 1)))
    return cells.withColumn("value", after).where(F.col("text").rlike(label)).select(*by, "row", "col", "value")


def structure_fingerprint(slots: DataFrame, by: list[str]) -> DataFrame:
    """(by, fingerprint): 32 digits of a hash of a table's slots, whatever order they came in."""
    part = F.concat_ws(":", "kind", "row", "col", F.coalesce("label", F.lit("")))
    return slots.groupBy(*by).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "|"), 256), 1, 32).alias("fingerprint"))
