"""Queries on tables of cells: features, layouts, slots, axes and bars, over order lines laid out in three columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.operators import cells as C
from formloom.plans.queries import query, t

#: The cells that the queries read: lines of an order, three in a row; what a cell says hangs on the line.
CELLS = """SELECT l_orderkey AS tbl, (n // 3)::INT AS row, (n % 3)::INT AS col, CASE WHEN n < 3 AND l_orderkey % 4 = 0 THEN (n + 1) || '월' WHEN l_returnflag = 'R' THEN '' WHEN l_returnflag = 'A' AND n % 3 = 1 THEN 'done' WHEN l_returnflag = 'A' THEN 'Label' || l_linestatus ELSE l_quantity::INT::VARCHAR END AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem)"""
#: In SQL: what is_blank(), is_label() and is_number() say of these texts.
KINDS = f"SELECT *, text = '' AS blank, text LIKE 'Label%' OR text = 'done' AS label, regexp_matches(text, '^[0-9]+$') AS number, text LIKE '%월' AS axis FROM ({CELLS})"
BY = ["tbl"]


def cells(spark: SparkSession, d: str) -> DataFrame:
    n, flag, key = F.col("n"), F.col("l_returnflag"), F.col("l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    text = F.when((n < 3) & (key % 4 == 0), F.concat((n + 1).cast("string"), F.lit("월"))).when(flag == "R", "").when((flag == "A") & (n % 3 == 1), "done").when(flag == "A", F.concat(F.lit("Label"), "l_linestatus")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    rows = t(spark, d, "lineitem").withColumn("n", F.row_number().over(order) - 1)
    return rows.select(key.alias("tbl"), F.floor(n / 3).cast("int").alias("row"), (n % 3).cast("int").alias("col"), text.alias("text"))


FEATURES = f"""SELECT tbl, count(*) AS n, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols, round(avg(blank::INT), 6) AS blank, round(avg(label::INT), 6) AS label, round(avg(number::INT), 6) AS number, round(avg(axis::INT), 6) AS date, round(avg(axis::INT), 6) AS axis,
  round(coalesce(avg(CASE WHEN row = 0 THEN label::INT END), 0), 6) AS top_label, round(coalesce(avg(CASE WHEN col = 0 THEN label::INT END), 0), 6) AS left_label FROM ({KINDS}) GROUP BY tbl"""


@query(f"SELECT tbl, n, n_rows, n_cols, blank, label, number, axis, top_label, left_label FROM ({FEATURES})")
def cell_features(spark, d):
    return C.table_features(cells(spark, d), BY).drop("date")


LAYOUTS = f"""SELECT *, CASE WHEN round(axis * n) >= 2 THEN 1.2 ELSE 0 END + left_label * 0.2 AS s1, CASE WHEN n_cols <= 4 THEN 0.2 ELSE 0.0 END + blank * 0.8 + left_label * 0.4 AS s2, top_label * 0.6 + number * 0.6 AS s3, CASE WHEN n_cols = 1 THEN 0.7 ELSE 0.0 END AS s4, (1 - blank) * 0.3 + CASE WHEN n = 1 THEN 0.3 ELSE 0.0 END AS s5 FROM ({FEATURES})"""


@query(f"""SELECT tbl, CASE WHEN m < 0.4 THEN 'unknown' WHEN s1 = m THEN 'schedule' WHEN s2 = m THEN 'form' WHEN s3 = m THEN 'data' WHEN s4 = m THEN 'list' ELSE 'text' END AS layout, round(m, 4) AS layout_score FROM (SELECT *, greatest(s1, s2, s3, s4, s5) AS m FROM ({LAYOUTS}))""")
def cell_layouts(spark, d):
    """The layout of each table by the largest of five scores."""
    return C.layouts(C.table_features(cells(spark, d), BY)).select("tbl", "layout", F.round("layout_score", 4).alias("layout_score"))


@query(f"""WITH l AS (SELECT *, CASE WHEN m < 0.4 THEN 'unknown' WHEN s1 = m THEN 'schedule' WHEN s2 = m THEN 'form' WHEN s3 = m THEN 'data' WHEN s4 = m THEN 'list' ELSE 'text' END AS layout FROM (SELECT *, greatest(s1, s2, s3, s4, s5) AS m FROM ({LAYOUTS})))
  SELECT role, count(*) AS tables FROM (SELECT CASE WHEN layout = 'schedule' THEN 'schedule' WHEN n <= 2 AND blank >= 0.5 THEN 'decoration' WHEN blank >= 0.25 THEN 'input' WHEN layout = 'data' THEN 'reference' ELSE 'body' END AS role FROM l) GROUP BY role""")
def table_roles(spark, d):
    return C.roles(C.layouts(C.table_features(cells(spark, d), BY))).groupBy("role").agg(F.count(F.lit(1)).alias("tables"))


@query(f"""WITH r AS (SELECT tbl, row, round((sum(label::INT) + 2 * sum(axis::INT) - sum(number::INT) * 0.5) / count(*), 6) AS score FROM ({KINDS}) WHERE row < 4 GROUP BY tbl, row)
  SELECT tbl, row, score FROM (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY score DESC, row) AS p FROM r) WHERE p = 1 AND score > 0""")
def header_rows(spark, d):
    return C.header_rows(cells(spark, d), BY)


SLOTS = f"""WITH k AS (SELECT *, lag(text) OVER (PARTITION BY tbl, row ORDER BY col) AS west, lag(label) OVER (PARTITION BY tbl, row ORDER BY col) AS west_label, lag(text) OVER (PARTITION BY tbl, col ORDER BY row) AS north, lag(label) OVER (PARTITION BY tbl, col ORDER BY row) AS north_label,
    last_value(CASE WHEN text = 'LabelO' THEN text END IGNORE NULLS) OVER (PARTITION BY tbl, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head, max(row) OVER (PARTITION BY tbl) AS last_row, first_value(text) OVER (PARTITION BY tbl, col ORDER BY row) AS top FROM ({KINDS})),
  e AS (SELECT *, max(blank::INT) OVER (PARTITION BY tbl) AS open FROM k WHERE row = last_row AND row > 0),
  f AS (SELECT tbl, row, col, west AS label, 'label_right' AS kind, 1 AS p FROM k WHERE blank AND west_label UNION ALL SELECT tbl, row, col, north, 'label_below', 2 FROM k WHERE blank AND north_label UNION ALL SELECT tbl, row, col, head, 'known_header', 3 FROM k WHERE blank AND head IS NOT NULL
    UNION ALL SELECT tbl, row, col, west, 'status', 4 FROM k WHERE text = 'done' UNION ALL SELECT tbl, row + 1, col, top, 'append_row', 5 FROM e WHERE open = 0),
  o AS (SELECT tbl, row, col, arg_min(label, p) AS label, arg_min(kind, p) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY tbl, row, col ORDER BY p) AS q FROM f) WHERE q = 1 GROUP BY ALL)
  SELECT tbl, row, col, label, kind, round(least(0.95::DOUBLE, CASE kind WHEN 'label_right' THEN 0.85 WHEN 'label_below' THEN 0.75 WHEN 'known_header' THEN 0.7 WHEN 'status' THEN 0.6 ELSE 0.5 END + CASE WHEN length(label) <= 6 THEN 0.05 ELSE 0 END), 4) AS confidence FROM o"""


def slots(spark: SparkSession, d: str) -> DataFrame:
    return C.all_slots(cells(spark, d), BY, ["LabelO"], ["done"])


@query(f"SELECT tbl, row, col, label, kind, confidence, confidence < 0.7 AS review FROM ({SLOTS})")
def input_slots(spark, d):
    """Five ways of finding cells that wait for a value, each cell once, scored and routed."""
    return slots(spark, d).select("tbl", "row", "col", "label", "kind", "confidence", "review")


@query(f"SELECT label, kind, count(*) AS cells, count(DISTINCT tbl) AS files, round(avg(confidence), 4) AS confidence FROM ({SLOTS}) GROUP BY ALL")
def input_cell_dictionary(spark, d):
    return C.input_dictionary(slots(spark, d), "tbl")


@query(f"SELECT tbl, substr(sha256(string_agg(kind || ':' || row || ':' || col || ':' || coalesce(label, ''), '|' ORDER BY kind || ':' || row || ':' || col || ':' || coalesce(label, ''))), 1, 32) AS fingerprint FROM ({SLOTS}) GROUP BY tbl")
def structure_fingerprints(spark, d):
    return C.structure_fingerprint(slots(spark, d), BY)


@query(f"""SELECT tbl, row, col, coalesce(last_value(CASE WHEN label THEN text END IGNORE NULLS) OVER (PARTITION BY tbl, row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), last_value(CASE WHEN label THEN text END IGNORE NULLS) OVER (PARTITION BY tbl, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS label FROM ({KINDS})""")
def cell_labels(spark, d):
    """The label of each cell: the nearest one on its left, else above it."""
    return C.row_labels(cells(spark, d), BY).select("tbl", "row", "col", "label")


@query(f"""SELECT tbl, row, col, value FROM (SELECT *, coalesce(lead(v, 1) OVER w, lead(v, 2) OVER w, lead(v, 3) OVER w) AS value FROM (SELECT *, CASE WHEN NOT blank AND NOT label THEN text END AS v FROM ({KINDS})) WINDOW w AS (PARTITION BY tbl, row ORDER BY col)) WHERE text = 'LabelF'""")
def labelled_values(spark, d):
    return C.values_of(cells(spark, d), BY, "^LabelF$")


AXES = f"SELECT tbl, row, min(col) AS first_col, max(col) AS last_col, count(*) AS marks FROM ({KINDS}) WHERE axis AND row < 4 GROUP BY tbl, row HAVING count(*) >= 2"


@query(f"SELECT tbl, row, 'month' AS unit, first_col, last_col, marks FROM ({AXES})")
def time_axes(spark, d):
    return C.time_axes(cells(spark, d), BY)


@query(f"""WITH i AS (SELECT k.tbl, k.row, k.col, k.col - row_number() OVER (PARTITION BY k.tbl, k.row ORDER BY k.col) AS run FROM ({KINDS}) k JOIN ({AXES}) a ON a.tbl = k.tbl AND k.row > a.row AND k.col BETWEEN first_col AND last_col WHERE number)
  SELECT tbl, row, min(col) AS start_col, max(col) AS end_col, count(*) AS n FROM i GROUP BY tbl, row, run""")
def schedule_bars(spark, d):
    """Runs of filled cells under an axis of time."""
    grid = cells(spark, d)
    return C.bars(grid, C.time_axes(grid, BY), BY, F.col("text").rlike("^[0-9]+$"))


@query(f"SELECT k.tbl, k.row, k.text AS task FROM ({KINDS}) k JOIN ({AXES}) a ON a.tbl = k.tbl AND k.row > a.row WHERE k.col = 0 AND NOT blank")
def schedule_tasks(spark, d):
    grid = cells(spark, d)
    return C.task_rows(grid, C.time_axes(grid, BY), BY)


@query(f"""WITH c AS (SELECT k.tbl, k.row, sum(number::INT) AS numbers, sum((NOT blank AND NOT number)::INT) AS texts FROM ({KINDS}) k JOIN ({AXES}) a ON a.tbl = k.tbl AND k.row > a.row AND k.col BETWEEN first_col AND last_col GROUP BY ALL)
  SELECT tbl, row, CASE WHEN numbers > 0 AND numbers >= texts THEN 'number' WHEN texts > 0 THEN 'text' ELSE 'empty' END AS kind FROM c""")
def schedule_bar_kinds(spark, d):
    grid = cells(spark, d)
    return C.bar_kinds(grid, C.time_axes(grid, BY), BY)


@query("""WITH a AS (SELECT l_orderkey AS tbl, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) - 1 AS col, l_shipdate::DATE AS day FROM lineitem), s AS (SELECT o_orderkey AS tbl, o_orderdate::DATE AS s, o_orderdate::DATE + 60 AS e FROM orders)
  SELECT s.tbl, s.s::VARCHAR AS from_day, s.e::VARCHAR AS to_day, min(CASE WHEN day BETWEEN s.s AND s.e THEN col END) AS start_col, max(CASE WHEN day BETWEEN s.s AND s.e THEN col END) AS end_col FROM s LEFT JOIN a ON a.tbl = s.tbl GROUP BY ALL""")
def spans_on_axis(spark, d):
    """The columns of a table's axis that a span of days takes."""
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey")
    axis = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("tbl"), (F.row_number().over(order) - 1).alias("col"), F.to_date("l_shipdate").alias("day"))
    spans = t(spark, d, "orders").select(F.col("o_orderkey").alias("tbl"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 60).alias("end"))
    return C.columns_of_spans(axis, spans, BY).select("tbl", F.col("start").cast("string").alias("from_day"), F.col("end").cast("string").alias("to_day"), "start_col", "end_col")
