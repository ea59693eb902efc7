"""Queries on the spans of price pages, over order lines printed on pages of eight orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.operators import price_pages as P
from formloom.plans.queries import query, t

ITEMS, UNITS = ["철근", "", "콘크리트", "외경 20", "(주석)", "레미콘", "3,000"], ["M/T", "〃", "개", "", "x"]
LINES = """SELECT *, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n, l_orderkey // 8 AS page FROM lineitem"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """A header of regions on each page, stages on every other, and on each line an item, a unit and a price. Lines that are equal in
    their keys, whose order the SQL leaves open, go by price, the larger first, so that every reading of the spans is the same."""
    rows = t(spark, d, "lineitem").withColumn("page", F.floor(F.col("l_orderkey") / 8))
    rows = rows.withColumn("y", 100 + 10 * F.row_number().over(Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.desc("l_extendedprice"))))
    pick = lambda texts, i: F.element_at(F.array(*map(F.lit, texts)), (i % len(texts) + 1).cast("int"))
    span = lambda x, text: F.struct(x.cast("double").alias("x"), text.alias("text"))
    price = span(200 + 100 * (F.col("l_linenumber") % 3) + F.col("l_partkey") % 81 - 40, F.format_number(F.floor("l_extendedprice"), 0))
    line = F.array(span(F.lit(90), pick(ITEMS, F.col("l_partkey"))), span(F.lit(110), F.when(F.col("l_suppkey") % 3 == 0, "가공품").otherwise("")), span(F.lit(150), pick(UNITS, F.col("l_suppkey"))), price)
    body = rows.select("page", F.col("y").cast("double").alias("y"), F.inline(line))
    head = F.array(*(F.struct(F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x"), F.lit(s).alias("text")) for y, x, s in [(50, 200, "서   울"), (50, 300, "부산"), (50, 400, "대구"), (51, 150, "단위")]))
    marks = F.array(*(F.struct(F.lit(70.0).alias("y"), F.lit(float(x)).alias("x"), F.lit(s).alias("text")) for x, s in [(190, "①"), (215, "②"), (300, "①"), (400, "①")]))
    pages = rows.select("page").distinct()
    heads = pages.select("page", F.inline(F.when(F.col("page") % 2 == 1, F.concat(head, marks)).otherwise(head)))
    return body.unionByName(heads)


def _list(texts):
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


@query(f"""WITH l AS (SELECT page, 100 + 10 * n AS row, {_list(ITEMS)}[l_partkey % {len(ITEMS)} + 1] AS item, CASE WHEN l_suppkey % 3 = 0 THEN '가공품' END AS more, {_list(UNITS)}[l_suppkey % {len(UNITS)} + 1] AS unit, 200 + 100 * (l_linenumber % 3) + l_partkey % 81 - 40 AS x, floor(l_extendedprice)::BIGINT AS price FROM ({LINES})),
  p AS (SELECT * FROM l WHERE page IN (SELECT page FROM l GROUP BY page HAVING count(*) FILTER (WHERE length(format('{{:,}}', price)) > 5) + count(*) FILTER (WHERE item = '3,000' AND length(item) > 5) >= 3) AND length(format('{{:,}}', price)) > 4 AND x >= 170),
  w AS (SELECT *, CASE WHEN item IN ('철근', '콘크리트', '레미콘') THEN item || coalesce(more, '') ELSE more END AS named, CASE WHEN unit IN ('M/T', '개') THEN unit END AS known FROM p),
  c AS (SELECT *, last_value(named IGNORE NULLS) OVER d AS carried, coalesce(last_value(known IGNORE NULLS) OVER d, '') AS of FROM w WINDOW d AS (PARTITION BY page ORDER BY row ROWS UNBOUNDED PRECEDING)),
  k(odd, spot, region) AS (VALUES (0, 200, '서울'), (0, 300, '부산'), (0, 400, '대구'), (1, 190, '서울①'), (1, 215, '서울②'), (1, 300, '부산'), (1, 400, '대구'))
  SELECT page, row::DOUBLE AS row, x::DOUBLE AS x, carried AS item, of AS unit, arg_min(region, (abs(spot - x), spot)) AS region, price FROM c JOIN k ON odd = page % 2 AND abs(spot - x) <= 30 WHERE carried IS NOT NULL AND price > 500 GROUP BY ALL""")
def price_facts(spark, d):
    """Prices of all pages by item, unit and region, with what a line leaves out taken from the lines before it."""
    return P.region_prices(spans(spark, d), ["page"])
