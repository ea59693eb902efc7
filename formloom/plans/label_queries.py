"""Queries on the taxonomy of labels and on marks along a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions import taxonomy as X
from formloom.operators import lines as L
from formloom.plans.queries import query, t

RAW = ["검사 항목", "접수번호", "2차검사항목", " 점검  결과 ", "판정기준 (도면)", "QTY", "수량(개)", "신청서", "접수일자", "앞쪽", "(3쪽 중 제1쪽)", "1 / 2 쪽", "합 계", "총계", "12", "가", "(나)", "---", "Gantt Chart", "진행률", "공정 관리", "대표자명", "2024.01 월", "2024-3", "제조소[3]", "결재란", "비고", "완료율", "측정단위", "A", "b", "III", "", "성명:", "회사명", "보고서", "공 종", "자재현황표", "확인자(인)", "시험 방법"]
LABEL = "CASE p_partkey % 5 WHEN 3 THEN x || ' ' || p_size WHEN 4 THEN p_type || x ELSE x END"
RULES = ", ".join(f"({r.rank}, '{r.how}', '{r.term.replace(chr(39), chr(39) * 2)}', '{r.label_class}', '{r.field}', {round(r.confidence, 3)})" for r in X.standard_rules())
CLASSES = f"""r(rank, how, term, label_class, field, confidence) AS (VALUES {RULES}),
  o AS (SELECT p_partkey, p_brand, {LABEL} AS raw FROM (SELECT *, [{", ".join(f"'{x}'" for x in RAW)}][(p_partkey * 7 + p_size) % {len(RAW)} + 1] AS x FROM part)),
  c AS (SELECT raw, count(*) AS occurrences, count(DISTINCT p_brand) AS files FROM o GROUP BY raw),
  n AS (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '([가-힣]) ([가-힣])', '\\1\\2', 'g'), '([가-힣]) ([가-힣])', '\\1\\2', 'g') AS label FROM c),
  m AS (SELECT raw, min(rank) AS rank FROM n JOIN r ON label <> '' AND CASE how WHEN 'whole' THEN lower(label) = lower(term) WHEN 'exact' THEN label = term WHEN 'part' THEN contains(lower(label), lower(term)) ELSE regexp_matches(label, term, 'i') END GROUP BY raw),
  k AS (SELECT n.raw, label, coalesce(label_class, CASE WHEN label = '' THEN '{X.DECORATION}' ELSE '{X.UNKNOWN}' END) AS label_class, coalesce(field, '') AS field, coalesce(confidence, (label = '')::INT)::DOUBLE AS confidence, coalesce(how, CASE WHEN label = '' THEN 'empty' ELSE 'none' END) AS how, coalesce(term, '') AS term, occurrences, files FROM n LEFT JOIN m ON m.raw = n.raw LEFT JOIN r USING (rank))"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, RAW)), ((F.col("p_partkey") * 7 + F.col("p_size")) % len(RAW) + 1).cast("int"))
    rows = t(spark, d, "part").withColumn("x", raw).select("p_brand", F.expr(LABEL).alias("raw"))
    return X.classified_labels(rows, "raw", "p_brand")


@query(f"WITH {CLASSES} SELECT * FROM k")
def label_taxonomy(spark, d):
    """Each distinct label with its class, field and confidence, by the first of the taxonomy's rules that it meets."""
    return classified(spark, d)


@query(f"WITH {CLASSES} SELECT label_class, field, count(*) AS labels, sum(occurrences)::BIGINT AS occurrences FROM k GROUP BY ALL")
def label_taxonomy_totals(spark, d):
    return X.class_totals(classified(spark, d))


#: Spans of pages: an order's lines, twelve orders on a page; letters stand in the margin, prices right of it.
NAMES = """v AS (SELECT DISTINCT page, y FROM s WHERE x < 82 AND length(text) = 1),
  w AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y ROWS UNBOUNDED PRECEDING) - 1 AS cluster FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y) <= 20 THEN 0 ELSE 1 END AS new FROM v)),
  g AS (SELECT s.page, s.x, s.y, s.text, w.cluster FROM s JOIN w ON w.page = s.page AND w.y = s.y WHERE x < 82 AND length(text) = 1),
  n AS (SELECT page, cluster, min(y) - 5 AS start, max(y) + 75 AS end_, string_agg(text, '' ORDER BY y, x, text) AS name FROM g GROUP BY page, cluster HAVING count(*) >= 2)"""
S = "s AS (SELECT l_orderkey // 12 AS page, l_orderkey * 100 + l_linenumber AS id, l_linenumber, l_partkey, (l_suppkey * 31 % 160)::DOUBLE AS x, (l_partkey * 7 % 900)::DOUBLE AS y, CASE l_suppkey % 4 WHEN 0 THEN '철' WHEN 1 THEN '근' WHEN 2 THEN '콘' ELSE 'ab' END AS text FROM lineitem)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ["철", "근", "콘", "ab"])), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return t(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 12).alias("page"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") * 31 % 160).cast("double").alias("x"), (F.col("l_partkey") * 7 % 900).cast("double").alias("y"), text.alias("text"))


@query(f"WITH {S}, {NAMES} SELECT page, cluster, start, end_ AS \"end\", name FROM n")
def upright_names(spark, d):
    """Names written downwards in a page's margin, by gaps between their letters, with the reach of each."""
    return L.upright_names(spans(spark, d), ["page"])


@query(f"WITH {S}, {NAMES}, p AS (SELECT DISTINCT page, id, y FROM s WHERE x >= 82) SELECT p.page, p.id, p.y, arg_min(name, cluster) AS name FROM p JOIN n ON n.page = p.page AND y BETWEEN start AND end_ GROUP BY ALL")
def rows_with_names(spark, d):
    """Each price row with the upright name that reaches it, by a join of points and intervals."""
    pages = spans(spark, d)
    rows = pages.where(F.col("x") >= 82).select("page", "id", "y").distinct()
    return L.named_rows(rows.withColumn("id", F.struct("id", "y")), L.upright_names(pages, ["page"]), ["page"]).select("page", "id.id", "id.y", "name")


@query("""WITH e AS (SELECT vec_id AS id, label AS line, floor(embedding[1]::DOUBLE * 5000) AS x, floor(embedding[2]::DOUBLE * 5000) AS m FROM embeddings)
  SELECT a.line, a.id AS point, arg_min(b.id, (abs(a.x - b.m), b.id)) AS mark, min(abs(a.x - b.m)) AS distance FROM e a JOIN e b ON a.line = b.line AND abs(a.x - b.m) <= 30 GROUP BY ALL""")
def nearest_marks(spark, d):
    """The nearest mark of a line within thirty of each point."""
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 5000).cast("double").alias("x")
    rows = t(spark, d, "embeddings")
    return L.nearest_within(rows.select(F.col("label").alias("line"), F.col("vec_id").alias("id"), at(0)), rows.select(F.col("label").alias("line"), F.col("vec_id").alias("id"), at(1)), ["line"], 30.0)
