"""Queries on files as a whole: addresses, layouts, one file for each category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators import files as O
from formloom.plans.queries import query, t

LEVELS = ["DOCUMENT_NOT_FOUND", "TABLE_NOT_FOUND", "ROW_NOT_FOUND"]
ADDRESSES = """SELECT l_orderkey * 100 + l_linenumber AS id, CASE WHEN l_partkey % 11 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS a, CASE WHEN l_partkey % 7 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS b, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN l_linenumber + 10 ELSE l_linenumber END AS c
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def failures(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    path = lambda *parts: F.array(*(p.cast("long") for p in parts)).alias("path")
    part = F.col("l_partkey")
    wrong = path(F.when(part % 11 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")), F.when(part % 7 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")), F.when(part % 5 == 0, None).when(part % 3 == 0, F.col("l_linenumber") + 10).otherwise(F.col("l_linenumber")))
    return O.first_failures(rows.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), wrong), rows.select(path(F.col("o_custkey"), F.col("l_orderkey"), F.col("l_linenumber"))), LEVELS)


FAILURES = f"""WITH x AS ({ADDRESSES}), t AS (SELECT DISTINCT o_custkey AS a, l_orderkey AS b, l_linenumber AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey), d AS (SELECT DISTINCT a FROM t), e AS (SELECT DISTINCT a, b FROM t),
  f AS (SELECT x.id, min(CASE WHEN d.a IS NULL THEN 1 WHEN e.a IS NULL THEN 2 WHEN t.a IS NULL THEN 3 END) AS level FROM x LEFT JOIN d ON d.a = x.a LEFT JOIN e ON e.a = x.a AND e.b = x.b LEFT JOIN t ON t.a = x.a AND t.b = x.b AND t.c = x.c GROUP BY x.id),
  r AS (SELECT id, {[*LEVELS]}[level] AS failed FROM f)"""


@query(f"{FAILURES} SELECT id, failed FROM r")
def address_failures(spark, d):
    """The first level of each address that isn't there."""
    return failures(spark, d)


@query(f"""{FAILURES} SELECT (id // 10000)::BIGINT AS owner, count(*) AS total, count(*) FILTER (WHERE failed IS NULL) AS ok, count(failed) AS failed, {", ".join(f"count(*) FILTER (WHERE failed = '{x}') AS {x.lower()}" for x in LEVELS)}, CASE WHEN count(*) FILTER (WHERE failed IS NULL) / count(*) >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r GROUP BY owner""")
def address_verdicts(spark, d):
    found = O.address_verdicts(failures(spark, d), F.floor(F.col("id") / 10000), 0.5)
    return found.select("owner", "total", "ok", "failed", *(F.coalesce(F.try_element_at("reasons", F.lit(x)), F.lit(0)).cast("long").alias(x.lower()) for x in LEVELS), "verdict")


HEADERS = ["결재", "담당", "뒤쪽", "공종", "2 / 3 쪽", "비고", "과장"]


@query(f"""WITH f AS (SELECT l_orderkey AS file, list({HEADERS}[l_partkey % {len(HEADERS)} + 1]) AS headers, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 10) AS columns, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 10) AS adjacent, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 40) AS inline, l_orderkey % 4 AS tables FROM lineitem GROUP BY l_orderkey),
  g AS (SELECT *, len(list_filter(headers, lambda h: regexp_matches(h, '{O.BACK}'))) AS back, len(list_filter(headers, lambda h: h IN ({str(O.APPROVAL)[1:-1]}))) AS office, columns + adjacent + inline AS cells FROM f),
  h AS (SELECT *, CASE WHEN back >= tables * 0.5 AND back >= 1 THEN 1 WHEN office >= len(headers) * 0.4 AND office >= 3 THEN 2 WHEN cells > 0 AND columns >= 0.9::DOUBLE * cells THEN 3 WHEN cells > 0 AND adjacent >= 0.6::DOUBLE * cells THEN 4 WHEN cells = 0 AND tables >= 1 THEN 5 ELSE 6 END AS k FROM g)
  SELECT file, ['BACK_SIDE_FORM', 'PUBLIC_DOC_APPROVAL_FORM', 'HEADER_COLUMN_FORM', 'LABEL_ADJACENT_FORM', 'TABLE_LIST_ONLY', 'UNKNOWN'][k] AS layout, [0.85, 0.80, 0.88, 0.80, 0.65, 0.30][k]::DOUBLE AS confidence FROM h""")
def file_layouts(spark, d):
    """The layout of each file by what dominates it: headers of a back side or an office, cells under headers or beside labels."""
    n = lambda flag, above: F.count_if((F.col("l_returnflag") == flag) & (F.col("l_quantity") > above))
    header = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("l_partkey") % len(HEADERS) + 1).cast("int"))
    files = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.collect_list(header).alias("headers"), n("N", 10).alias("columns"), n("A", 10).alias("adjacent"), n("R", 40).alias("inline"))
    return files.select("file", O.file_layout(F.col("headers"), F.col("columns"), F.col("adjacent"), F.col("inline"), F.col("file") % 4).alias("l")).select("file", "l.layout", F.col("l.confidence").cast("double").alias("confidence"))


@query("""WITH a AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS k FROM orders WHERE o_orderkey NOT IN (SELECT k FROM a)),
  c AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT k FROM a UNION ALL SELECT k FROM b)) SELECT 'finished' AS category, k AS o_orderkey FROM a UNION ALL SELECT 'largest', k FROM b UNION ALL SELECT 'second', k FROM c""")
def one_file_for_each(spark, d):
    """A report: one order for each category, none for two."""
    done = F.col("o_orderstatus") == "F"
    return O.one_for_each(t(spark, d, "orders"), "o_orderkey", {"finished": (done, []), "largest": (F.lit(True), [F.desc("o_totalprice")]), "never": (F.lit(False), []), "second": (done, [])})
