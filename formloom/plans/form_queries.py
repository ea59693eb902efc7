"""Queries on forms as a whole, over order lines laid out as the tables of forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.functions import form_rules as R
from formloom.operators import forms as O
from formloom.plans.queries import query, t

TEXTS = ["접수번호", "성명", "주소", "처리절차", "수수료", "첨부서류", "주민등록번호", "금액", "1", "국세청장 귀하", "법정대리인 성명", "비고", "처리 기간", "시행일", "「도로법」 제2조 및 「하천법」 제3조의2 제1항", "1. 도면 2. 사진 3) 등본", "7일", "없음", "[별지 제3호서식]", "발급 직인", "담당공무원 확인사항", "발급일", "합계", "가", "전화  번호", "수수료 300원", "접 수 일", "서울시장", "12", "E-mail"]
NAMES = ["13638955_도로 연결 허가신청서.hwpx", "채혈 관리대장", "12_법인_설립허가증.HWP", "처분 통지서", "선임보고서_32", "농지 명세서", "과징금 별표", "삭제 2014 7 29", "무제", "계약 동의서 [2]", "c563771748119 023 별지 제4호서식 건축 변경신고서"]


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Four tables to a document, two to four cells to a row."""
    n, key, part = F.col("n"), F.col("l_orderkey"), F.col("l_partkey")
    rows = t(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1)
    wide = key % 3 + 2
    text = F.when((part + n) % 5 < 2, F.lit("")).when(part % 31 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, TEXTS)), ((part * 7 + F.col("l_suppkey")) % len(TEXTS) + 1).cast("int")))
    return rows.select(F.floor(key / 4).alias("doc"), (key % 4).cast("int").alias("tbl"), F.floor(n / wide).cast("int").alias("row"), (n % wide).cast("int").alias("col"), text.alias("text"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc") % len(NAMES) + 1).cast("int"))
    return t(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 4).alias("doc")).distinct().select("doc", name.alias("name"))


def _plain(pattern: str) -> str:
    """A pattern for an engine without looking ahead, over texts that what it looks for doesn't occur in."""
    return pattern.replace("(?!증)", "").replace(r"(?!\s*본인)", "").replace("'", "''")


def _says(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{_plain(pattern)}')"


def _first(text: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {_says(text, p)} THEN '{name}'" for name, p in rules) + " END"


def _list(texts):
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


def _clean(x: str) -> str:
    for pattern in (r"(?i)\.hwpx?$", r"(?i)\.repaired$", r"^\d+[_\s]*"):
        x = f"regexp_replace({x}, '{pattern}', '')"
    x = rf"trim(regexp_replace(regexp_replace({x}, '[_\[\]()<>{{}}]+', ' ', 'g'), '\s+', ' ', 'g'))"
    for pattern in (r"(?i)^[0-9a-f]{8,}\s*(?:\d{1,5}\s+)*", r"^별지\s*제\s*\d+호(?:의\s*\d+)?\s*서식\s*"):
        x = f"trim(regexp_replace({x}, '{pattern}', ''))"
    return x


PUNCTUATION = r"[\s_·ㆍ,.\-–—()（）\[\]<>]+"
CELLS = rf"""c AS MATERIALIZED (SELECT l_orderkey // 4 AS doc, (l_orderkey % 4)::INT AS tbl, (n // wide)::INT AS row, (n % wide)::INT AS col, trim(regexp_replace(coalesce(CASE WHEN (l_partkey + n) % 5 < 2 THEN '' WHEN l_partkey % 31 = 0 THEN NULL ELSE {_list(TEXTS)}[(l_partkey * 7 + l_suppkey) % {len(TEXTS)} + 1] END, ''), '\s+', ' ', 'g')) AS text
  FROM (SELECT *, l_orderkey % 3 + 2 AS wide, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem))"""
FIELDS = rf"""{CELLS}, h AS (SELECT *, {_says("replace(text, ' ', '')", R.BARE)} AS bare FROM c),
  u AS (SELECT *, CASE WHEN text <> '' THEN {{'label': text, 'head': last_value(CASE WHEN text <> '' AND NOT bare THEN text END IGNORE NULLS) OVER (PARTITION BY doc, tbl, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'bare': bare}} END AS own FROM h),
  v AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc, tbl, row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), last_value(own IGNORE NULLS) OVER (PARTITION BY doc, tbl, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS lab FROM u),
  w AS (SELECT doc, tbl, row, col, CASE WHEN lab.bare AND lab.head IS NOT NULL THEN lab.head || ' ' || lab.label ELSE lab.label END AS label FROM v WHERE text = '' AND lab IS NOT NULL),
  f AS (SELECT doc, label, min((tbl, row, col)) AS place FROM w WHERE length(label) < {O.LABEL} GROUP BY ALL)"""
KINDS = rf"""e AS (SELECT doc, bool_or({_says("text", R.MARKERS)}) AS marked, bool_or(contains(replace(text, ' ', ''), '{R.STRONG[0]}')) AND bool_or(contains(replace(text, ' ', ''), '{R.STRONG[1]}')) AS strong, bool_or({_says("text", R.SEAL)}) AS sealed, bool_or({_says("text", R.ADDRESSED)}) AS addressed FROM c GROUP BY doc),
  d AS (SELECT doc, {_list(NAMES)}[doc % {len(NAMES)} + 1] AS name FROM (SELECT DISTINCT o_orderkey // 4 AS doc FROM orders)), dn AS (SELECT *, {_clean("name")} AS clean_name FROM d),
  dt AS (SELECT dn.doc, name, clean_name, {_first("clean_name", R.NAME_ENDS)} AS known, {_first("clean_name", R.NAME_WORDS)} AS word, {_first("clean_name", R.NAME_LAST)} AS last, {_says("clean_name", R.DELETED)} AS deleted, {_says("clean_name", R.ANNEX)} AS annex, coalesce(n, 0) AS n FROM dn LEFT JOIN (SELECT doc, count(*) AS n FROM f GROUP BY doc) q ON q.doc = dn.doc),
  du AS (SELECT *, CASE WHEN deleted THEN '{R.OTHER}' WHEN annex THEN '{R.STANDARD}' ELSE coalesce(known, word, last, '{R.OTHER}') END AS doc_type, CASE WHEN deleted THEN 'DELETED_STUB' WHEN annex THEN 'ANNEX_TABLE' WHEN known IS NOT NULL THEN 'NAME_SUFFIX' WHEN word IS NOT NULL THEN 'NAME_KEYWORD' WHEN last IS NOT NULL THEN 'NAME_MORPHEME' ELSE 'UNMATCHED' END AS reason FROM dt),
  k AS (SELECT du.doc, name, clean_name, doc_type, reason, NOT deleted AND NOT annex AND n > 0 AND doc_type <> '{R.STANDARD}' AS fillable, CASE WHEN coalesce(strong, false) THEN '{R.APPLICATION}' WHEN coalesce(sealed AND NOT addressed, false) THEN '{R.CERTIFICATE}' WHEN doc_type = '{R.NOTICE}' AND contains(clean_name, '{R.REPORTED}') THEN '{R.APPLICATION}'
    ELSE coalesce({_first("doc_type", [(v, f"^{x}$") for x, v in R.KINDS.items()])}, CASE WHEN coalesce(marked, false) THEN '{R.APPLICATION}' ELSE '{R.INTERNAL}' END) END AS kind FROM du LEFT JOIN e ON e.doc = du.doc)"""
FLAT = "replace(label, ' ', '')"
ROLES = rf"""b AS (SELECT doc, tbl, min(row) AS band FROM c WHERE {_says("text", R.PROCEDURE)} GROUP BY ALL),
  x AS (SELECT f.doc, place[1] AS tbl, place[2] AS row, place[3] AS col, label, band, kind, regexp_replace(label, '{PUNCTUATION}', '', 'g') AS own, regexp_replace(regexp_replace(regexp_replace(name, '^\d+[_\s]*', ''), '(?i)\.hwpx?$', ''), '{PUNCTUATION}', '', 'g') AS title FROM f LEFT JOIN b ON b.doc = f.doc AND b.tbl = place[1] LEFT JOIN k ON k.doc = f.doc),
  y AS (SELECT *, CASE WHEN row >= band THEN 'PROCEDURE_BAND' WHEN {_says(FLAT, R.MARK)} OR {_says("label", R.NUMBERED)} OR {_says("label", R.END_MARK)} THEN 'LAYOUT_OR_FORMNO' WHEN {_says("label", R.STEP)} THEN 'FLOW_STEP' WHEN title <> '' AND own <> '' AND (own = title OR length(own) > 8 AND contains(title, own)) THEN 'FORM_TITLE'
    WHEN {_says("label", R.OFFICE)} THEN 'OFFICE_FIELD' WHEN {_says("label", R.SECTION)} THEN 'SECTION_HEADER' WHEN kind = '{R.APPLICATION}' AND {_says("label", R.ADDRESSEE)} THEN 'ADDRESSEE' WHEN kind <> '{R.APPLICATION}' THEN 'FORM_KIND' ELSE 'DEFAULT_APPLICANT' END AS reason FROM x),
  z AS (SELECT *, CASE WHEN reason IN ('OFFICE_FIELD', 'FORM_KIND') THEN 'office' WHEN reason = 'DEFAULT_APPLICANT' THEN 'applicant' ELSE 'noise' END AS role FROM y),
  r AS (SELECT doc, tbl, row, col, label, role, reason, CASE WHEN role = 'noise' THEN '' ELSE coalesce({_first("label", [(m[0], m[2]) for m in R.MEANINGS])}, '') END AS semantic, CASE WHEN role = 'noise' THEN '' ELSE coalesce({_first("label", [(m[1], m[2]) for m in R.MEANINGS])}, 'text') END AS input, CASE WHEN role = 'noise' THEN '' WHEN {_says("label", R.THIRD_PARTY)} THEN 'thirdParty' ELSE 'self' END AS subject FROM z)"""


@query(f"WITH {FIELDS}, {KINDS} SELECT * FROM k")
def form_kinds(spark, d):
    """What each form is, by all its cells first and by its name where they don't say."""
    return O.roles_of(cells(spark, d), documents(spark, d))[0]


@query(f"WITH {FIELDS}, {KINDS}, {ROLES} SELECT * FROM r")
def field_roles(spark, d):
    """Who fills in each field of each form, and what it means."""
    return O.roles_of(cells(spark, d), documents(spark, d))[1]


@query(f"WITH {FIELDS}, {KINDS}, {ROLES} SELECT k.doc, doc_type, kind, count(role) FILTER (WHERE role <> 'noise') AS inputs, count(role) FILTER (WHERE role = 'applicant') AS applicant, count(role) FILTER (WHERE role = 'office') AS office, count(role) FILTER (WHERE role = 'noise') AS noise, count(role) FILTER (WHERE role = 'applicant' AND input = 'secret') AS sensitive FROM k LEFT JOIN r ON r.doc = k.doc GROUP BY ALL")
def input_schemas(spark, d):
    return O.input_schemas(*O.roles_of(cells(spark, d), documents(spark, d)))


def _asked(name: str) -> str:
    label = O.ASKED[name]
    inline = rf"trim(regexp_replace(regexp_replace(text, '{label}', ''), '^[ :·|]+', ''))"
    return f"CASE WHEN {_says('text', label)} THEN coalesce(nullif({inline}, ''), east, south) END AS {name}"


ITEMS = rf"""list_filter(list_transform(string_split(regexp_replace(attachments, '({O.ITEM})', chr(1) || '\1', 'g'), chr(1)), lambda p: trim(regexp_replace(regexp_replace(p, '^[ .·,]+|[ .·,]+$', '', 'g'), '^(?:{O.ITEM})\s*', ''))), lambda p: length(p) >= 2)"""


@query(rf"""WITH {CELLS}, g AS (SELECT *, CASE WHEN text <> '' AND NOT {_says("text", O.LABELLED)} THEN text END AS value FROM c),
  a AS (SELECT *, first_value(value IGNORE NULLS) OVER (PARTITION BY doc, tbl, row ORDER BY col RANGE BETWEEN 1 FOLLOWING AND {O.RIGHT} FOLLOWING) AS east, first_value(value IGNORE NULLS) OVER (PARTITION BY doc, tbl, col ORDER BY row RANGE BETWEEN 1 FOLLOWING AND {O.BELOW} FOLLOWING) AS south FROM g),
  q AS (SELECT doc, (tbl, row, col) AS spot, text, {", ".join(_asked(n) for n in O.ASKED)}, nullif(trim(regexp_replace(regexp_extract(text, '{O.ADDRESSED_TO}', 1), '\s+', ' ', 'g')), '') AS submit_to FROM a),
  m AS (SELECT doc, {", ".join(f"arg_min({n}, spot) FILTER (WHERE {n} IS NOT NULL) AS {n}" for n in [*O.ASKED, "submit_to"])} FROM q GROUP BY doc),
  l AS (SELECT doc, spot, generate_subscripts(names, 1) AS nth, unnest(names) AS name, unnest(arts) AS art FROM (SELECT doc, spot, regexp_extract_all(text, '{O.LAW}', 1) AS names, regexp_extract_all(text, '{O.LAW}', 2) AS arts FROM q)),
  o AS (SELECT doc, trim(trim(name) || ' ' || trim(regexp_replace(art, '\s+', ' ', 'g'))) AS law, min((spot, nth)) AS first FROM l GROUP BY ALL),
  p AS (SELECT doc, string_agg(law, '|' ORDER BY first) AS laws FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY first) AS place FROM o) WHERE place <= {O.LAWS} GROUP BY doc)
  SELECT m.doc, coalesce(array_to_string(CASE WHEN len({ITEMS}) > 0 THEN {ITEMS} WHEN length(attachments) >= 2 THEN [attachments] ELSE [] END, '|'), '') AS attachments, coalesce(processing_time, '') AS processing_time, coalesce(fee, '') AS fee, coalesce(procedure, '') AS procedure, coalesce(laws, '') AS laws, coalesce(submit_to, '') AS submit_to FROM m LEFT JOIN p ON p.doc = m.doc""")
def form_requirements(spark, d):
    """What each form asks for besides its fields: attachments, period, fee, procedure, laws, and who gets it."""
    found = O.requirements(cells(spark, d))
    return found.withColumns({c: F.array_join(c, "|") for c in ("attachments", "laws")})
