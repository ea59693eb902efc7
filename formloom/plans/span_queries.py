"""Queries on tables with merged cells, over order lines laid out in two to four columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.operators import spans as S
from formloom.plans.queries import query, t

TEXTS = ["공사명", "현장명", "수량", "검측상태", "비고", "12", "이 칸에는 스무 글자가 넘는 공사명 안내문을 적습니다", "품명", "성명 ", "진행률", "기타", "번호", "접수", "abc", "단위", "규격"]
RARE = ["결재", "3 쪽", "유의사항", "서명"]
LAYOUTS = ["form_table", "data_table", "horizontal_table", "text_table", "stamp_or_approval_table", "page_marker_table", "nested_container_table"]
BY = ["tbl"]


def cells(spark: SparkSession, d: str) -> DataFrame:
    """A table for each order: rows of two to four cells, the last of which may take two columns, every third row two rows high."""
    n, key, part = F.col("n"), F.col("l_orderkey"), F.col("l_partkey")
    rows = t(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1)
    wide = key % 3 + 2
    r, c = F.floor(n / wide).cast("int"), (n % wide).cast("int")
    pick = lambda texts, i: F.element_at(F.array(*map(F.lit, texts)), (i % len(texts) + 1).cast("int"))
    text = F.when(part % 41 == 0, pick(RARE, key)).when((part + n) % 3 == 0, F.lit("")).when(part % 17 == 0, F.lit(None)).otherwise(pick(TEXTS, part + F.col("l_suppkey")))
    return rows.select(key.alias("tbl"), (r + F.floor((r + 1) / 3)).cast("int").alias("row"), c.alias("col"), F.when(r % 3 == 1, 2).otherwise(1).alias("row_span"), F.when((c == wide - 1) & (part % 4 == 0), 2).otherwise(1).alias("col_span"), text.alias("text"), (part % 5 == 0).alias("likely"))


def tables(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, LAYOUTS)), (F.col("o_orderkey") % len(LAYOUTS) + 1).cast("int"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("tbl"), kind.alias("layout"), F.when(F.col("o_orderkey") % 11 == 0, "basic_info").alias("role")).distinct()


def _list(texts):
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


def _field(text, fields):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{words.replace(' ', '|')}') THEN '{name}'" for name, words in fields.items()) + " END"


CELLS = f"""SELECT l_orderkey AS tbl, (r + (r + 1) // 3)::INT AS row, c::INT AS col, CASE WHEN r % 3 = 1 THEN 2 ELSE 1 END AS row_span, CASE WHEN c = wide - 1 AND l_partkey % 4 = 0 THEN 2 ELSE 1 END AS col_span,
  CASE WHEN l_partkey % 41 = 0 THEN {_list(RARE)}[l_orderkey % {len(RARE)} + 1] WHEN (l_partkey + n) % 3 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN NULL ELSE {_list(TEXTS)}[(l_partkey + l_suppkey) % {len(TEXTS)} + 1] END AS text, l_partkey % 5 = 0 AS likely
  FROM (SELECT *, n // wide AS r, n % wide AS c FROM (SELECT *, l_orderkey % 3 + 2 AS wide, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem))"""
HITS = f"""c AS MATERIALIZED ({CELLS}), x AS (SELECT *, coalesce(trim(text), '') = '' AS blank, {_field("text", S.FIELDS)} AS field, {_field("text", S.STATES)} AS state,
    CASE WHEN regexp_matches(text, '{S.STAMPS}') THEN 'stamp_keyword' WHEN regexp_matches(lower(text), '{S.PAGES}') AND length(text) <= 10 THEN 'page_marker_keyword' WHEN regexp_matches(text, '{S.LEGAL}') THEN 'legal_notice_pattern' END AS says FROM c),
  l AS (SELECT DISTINCT o_orderkey AS tbl, {_list(LAYOUTS)}[o_orderkey % {len(LAYOUTS)} + 1] AS layout, CASE WHEN o_orderkey % 11 = 0 THEN 'basic_info' END AS own FROM orders),
  f AS (SELECT x.tbl, max(col + col_span) AS n_cols, count(field) AS known, bool_or(row = 0 AND regexp_matches(coalesce(text, ''), '{S.DATA_HEADERS.replace(" ", "|")}')) AS has_header, max(row) AS last_row, arg_min(says, (row, col)) FILTER (WHERE says IS NOT NULL) AS says,
    any_value(coalesce(layout, 'unknown')) AS layout, any_value(coalesce(own, layout, 'unknown')) AS role FROM x LEFT JOIN l ON l.tbl = x.tbl GROUP BY x.tbl),
  e AS (SELECT f.*, layout IN ({str(list(S.EXTENDED))[1:-1]}) OR role IN ('basic_info', 'data_table') AS extended, (SELECT bool_or(NOT blank) FROM x WHERE x.tbl = f.tbl AND x.row = f.last_row) AS last_filled, (SELECT min(col) FROM x WHERE x.tbl = f.tbl AND x.row = f.last_row) AS last_col FROM f WHERE layout NOT IN ({str(list(S.NO_SLOTS))[1:-1]})),
  b AS (SELECT e.*, x.row, x.col, x.row_span, x.col_span, w.text AS west, w.field AS west_field, w.state AS west_state, w.likely, w.col AS west_col, w.col_span AS west_span, n.text AS north, n.field AS north_field
    FROM x JOIN e ON x.tbl = e.tbl LEFT JOIN x w ON w.tbl = x.tbl AND NOT w.blank AND w.row = x.row AND w.col + w.col_span = x.col LEFT JOIN x n ON n.tbl = x.tbl AND NOT n.blank AND n.col = x.col AND n.row + n.row_span = x.row WHERE x.blank),
  h AS (SELECT tbl, layout, role, says, row, col, 1 AS p, 'label_right' AS source, west AS label, west_field AS field, CASE WHEN west_field IS NULL THEN 0.65 ELSE 0.88 END AS conf, NULL AS own_role FROM b WHERE west IS NOT NULL AND (likely OR length(west) <= 20)
    UNION ALL SELECT tbl, layout, role, says, row, col, 2, 'label_below', north, north_field, CASE WHEN north_field IS NULL THEN 0.55 ELSE 0.75 END, NULL FROM b WHERE north IS NOT NULL AND length(north) <= 20
    UNION ALL SELECT tbl, layout, role, says, row, col, 3, 'label_value_pair', west, west_field, 0.82, NULL FROM b WHERE west_field IS NOT NULL AND n_cols IN (2, 4) AND west_col % 2 = 0 AND west_span = 1
    UNION ALL SELECT tbl, layout, role, says, row, col, 4, 'merged_input_cell', west, west_field, 0.75, NULL FROM b WHERE west_field IS NOT NULL AND length(west) <= 20 AND row_span * col_span >= 2
    UNION ALL SELECT tbl, layout, role, says, row, col, 5, 'blank_after_known_header', CASE WHEN north_field IS NOT NULL THEN north ELSE west END, coalesce(north_field, west_field), CASE WHEN north_field IS NOT NULL THEN 0.78 ELSE 0.85 END, NULL FROM b WHERE extended AND coalesce(north_field, west_field) IS NOT NULL
    UNION ALL SELECT tbl, layout, role, says, row, col, 6, 'metadata_form_slot', west, west_field, CASE WHEN layout IN ({str(list(S.FORMS))[1:-1]}) THEN 0.90 ELSE 0.82 END, 'basic_info' FROM b WHERE extended AND west_field IS NOT NULL AND (layout IN ({str(list(S.FORMS))[1:-1]}) OR known >= 3)
    UNION ALL SELECT tbl, layout, role, says, CASE WHEN last_filled THEN last_row + 1 ELSE last_row END, CASE WHEN last_filled THEN 0 ELSE last_col END, 7, 'data_table_append_slot', '', 'appendRow', 0.72, 'data_table' FROM e WHERE extended AND has_header AND last_row >= 1
    UNION ALL SELECT tbl, layout, role, says, row, col, 8, 'status_cell', west, west_state, 0.78, NULL FROM b WHERE extended AND west_state IS NOT NULL),
  s AS (SELECT *, coalesce(own_role, role) AS slot_role, CASE WHEN conf < 0.7 THEN 'low_confidence' WHEN p = 4 THEN 'merged_cell_review' WHEN p = 7 THEN 'append_slot_requires_review' END AS reason, CASE WHEN layout IN ({str(list(S.UNSAFE))[1:-1]}) THEN layout ELSE says END AS unsafe FROM h),
  g AS (SELECT *, round(CASE WHEN layout IN ('nested_container_table', 'horizontal_table') THEN least(0.98, up + 0.05) ELSE up END, 2)::DOUBLE AS confidence FROM (SELECT *, CASE WHEN slot_role IN ('basic_info', 'data_table') THEN least(0.98, conf + 0.10) ELSE conf END AS up FROM s))"""
SHOWN = "tbl, row, col, source, label, coalesce(field, 'unknown') AS field, confidence, confidence >= 0.9 AND reason IS NULL AND unsafe IS NULL AS auto_edit, reason IS NOT NULL OR unsafe IS NOT NULL AS review, reason AS review_reason, unsafe AS unsafe_reason, slot_role AS role"


@query(f"WITH {HITS} SELECT {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY tbl, row, col ORDER BY p) AS place FROM g) WHERE place = 1")
def span_slots(spark, d):
    """Every cell that waits for a value, among merged cells, as found first, scored and routed."""
    return S.scored_hits(S.slot_hits(cells(spark, d), BY, tables(spark, d)), BY)


def _of(source):
    def found(spark, d):
        return S.scored_hits(S.slot_hits(cells(spark, d), BY, tables(spark, d)), BY, source)

    return found


for name, source in {"pair_slots": "label_value_pair", "merged_slots": "merged_input_cell", "known_header_slots": "blank_after_known_header", "metadata_slots": "metadata_form_slot", "append_slots": "data_table_append_slot", "state_slots": "status_cell"}.items():
    way = _of(source)
    way.__name__, way.__doc__ = name, f"The slots that are found as {source}, whatever else finds them."
    query(f"WITH {HITS} SELECT {SHOWN} FROM g WHERE source = '{source}'")(way)


@query(f"""SELECT tbl, (row + i)::INT AS at_row, (col + j)::INT AS at_col, row, col, i + j > 0 AS covered FROM ({CELLS}), unnest(range(2)) a(i), unnest(range(2)) b(j) WHERE i < row_span AND j < col_span""")
def occupied_slots(spark, d):
    """The slots that each cell takes."""
    return S.occupied(cells(spark, d), BY).select("tbl", "at_row", "at_col", "row", "col", "covered")
