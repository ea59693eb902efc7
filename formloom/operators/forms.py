"""Forms as a whole: the fields that a form asks for with their roles, its kind by all its cells, and what it requires.

Cells are (doc, tbl, row, col, text), documents (doc, name). Windows are within a table; what a document says as a whole is aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions import form_rules as R
from formloom.functions.form_rules import first_that, normal, says

DOC, TABLE = ["doc"], ["doc", "tbl"]
#: A label is this long at most; values stand this many columns to the right at most, or rows below; laws of a form that are named.
LABEL, RIGHT, BELOW, LAWS = 40, 6, 2, 5
#: Labels of what a form requires, labels that are no values, laws with their articles, and who gets the form.
ASKED = {"attachments": r"^(첨부|구비|제출)\s*서류", "processing_time": r"^처리\s*기간", "fee": "^수수료", "procedure": r"^처리\s*절차"}
LABELLED = r"^(첨부|구비|제출)\s*서류|^처리\s*기간|^수수료|^처리\s*절차|^접수\s*(번호|일)|^담당\s*(자|부서)|^신청인|^성명|^주소|^대표자|^명칭|^전화|^등록번호|^신청\s*내용"
LAW, ADDRESSED_TO = r"「([^」]{2,60})」\s*(제\s*\d+조(?:의\s*\d+)?(?:\s*제\s*\d+항)?)?", r"([가-힣\s]{2,30}?(?:장관|처장|청장|위원장|시장|군수|구청장|원장|사장|이사장))\s*(?:귀하|귀중)?\s*$"
ITEM = r"\d{1,2}\s*[.)]|[가-힣]\s*[.)]|[①-⑮]"


def field_cells(cells: DataFrame) -> DataFrame:
    """(doc, tbl, row, col, label): blank cells with their label, each label once a document, where it comes first.

    The label is the nearest text on the left, else the nearest above. One that says nothing by itself (a number, a syllable, a total) is
    led by the nearest text above it that does. Labels of LABEL letters and more are none.
    """
    text = normal(F.col("text"))
    rows = cells.select(*TABLE, "row", "col", text.alias("text")).repartition(*TABLE)  # serves the windows along rows and columns
    upward = Window.partitionBy(*TABLE, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    leftward = Window.partitionBy(*TABLE, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    bare = says(F.replace(F.col("text"), F.lit(" "), F.lit("")), R.BARE)
    head = F.last(F.when((F.col("text") != "") & ~bare, F.col("text")), ignorenulls=True)
    rows = rows.withColumn("head", head.over(upward)).withColumn("own", F.when(F.col("text") != "", F.struct(F.col("text").alias("label"), "head", bare.alias("bare"))))
    led = rows.withColumn("above", F.last("own", ignorenulls=True).over(upward)).withColumn("left", F.last("own", ignorenulls=True).over(leftward))
    found = led.where("text = ''").withColumn("by", F.coalesce("left", "above")).where("by IS NOT NULL")
    label = F.when(F.col("by.bare") & F.col("by.head").isNotNull(), F.concat_ws(" ", "by.head", "by.label")).otherwise(F.col("by.label"))
    found = found.select(*TABLE, "row", "col", label.alias("label")).where(F.length("label") < LABEL)
    return found.groupBy("doc", "label").agg(F.min(F.struct("tbl", "row", "col")).alias("at")).select("doc", "at.*", "label")


def document_evidence(cells: DataFrame) -> DataFrame:
    """(doc, marked, strong, sealed, addressed): what a document's cells say of its kind, taken together."""
    text = normal(F.col("text"))
    tight = F.replace(text, F.lit(" "), F.lit(""))
    strong = [F.max(F.contains(tight, F.lit(w))) for w in R.STRONG]
    return cells.groupBy(*DOC).agg(F.max(says(text, R.MARKERS)).alias("marked"), (strong[0] & strong[1]).alias("strong"), F.max(says(text, R.SEAL)).alias("sealed"), F.max(says(text, R.ADDRESSED)).alias("addressed"))


def form_kinds(documents: DataFrame, evidence: DataFrame, fields: DataFrame) -> DataFrame:
    """documents (doc, name) with clean_name, doc_type, reason, fillable and kind. What the cells say counts before the name: a receipt
    number with an official's confirmation is an application, a seal without an addressee a certificate; a report that is handed in is an
    application, and names that say nothing leave it to the marks that applications alone have."""
    counts = fields.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_fields"))
    rows = documents.select("doc", "name", R.form_name(F.col("name")).alias("clean_name")).join(counts, "doc", "left").join(evidence, "doc", "left")
    rows = rows.withColumn("t", R.document_type(F.col("clean_name"), F.col("n_fields")))
    no = lambda c: F.coalesce(c, F.lit(False))
    by_type = first_that(F.col("t.doc_type"), [(v, f"^{k}$") for k, v in R.KINDS.items()])
    kind = F.when(no(F.col("strong")), R.APPLICATION).when(no(F.col("sealed")) & ~no(F.col("addressed")), R.CERTIFICATE)
    kind = kind.when((F.col("t.doc_type") == R.NOTICE) & says(F.col("clean_name"), R.REPORTED), R.APPLICATION)
    kind = kind.otherwise(F.coalesce(by_type, F.when(no(F.col("marked")), R.APPLICATION).otherwise(R.INTERNAL)))
    return rows.select("doc", "name", "clean_name", "t.*", kind.alias("kind"))


def field_roles(fields: DataFrame, kinds: DataFrame, cells: DataFrame) -> DataFrame:
    """fields with role (applicant, office or noise), reason, semantic, input and subject (self or thirdParty; empty for noise).

    In order: what stands in or below the row of a procedure is noise, so are marks, form numbers, steps and the form's title; then
    fields of the office; then sections and, in applications, addressees; in other kinds everything else is the office's.
    """
    bands = cells.where(says(normal(F.col("text")), R.PROCEDURE)).groupBy(*TABLE).agg(F.min("row").alias("band"))
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s_·ㆍ,.\-–—()（）\[\]<>]+", "")
    title = plain(F.regexp_replace(F.regexp_replace("name", r"^\d+[_\s]*", ""), r"(?i)\.hwpx?$", ""))
    rows = fields.join(bands, TABLE, "left").join(kinds.select("doc", "kind", title.alias("title")), "doc", "left")
    label, flat = F.col("label"), F.replace(F.col("label"), F.lit(" "), F.lit(""))
    own = plain(label)
    titled = (F.col("title") != "") & (own != "") & ((own == F.col("title")) | ((F.length(own) > 8) & F.contains("title", own)))
    reason = (
        F.when(F.col("row") >= F.col("band"), "PROCEDURE_BAND").when(says(flat, R.MARK) | says(label, R.NUMBERED) | says(label, R.END_MARK), "LAYOUT_OR_FORMNO").when(says(label, R.STEP), "FLOW_STEP").when(titled, "FORM_TITLE")
        .when(says(label, R.OFFICE), "OFFICE_FIELD").when(says(label, R.SECTION), "SECTION_HEADER").when((F.col("kind") == R.APPLICATION) & says(label, R.ADDRESSEE), "ADDRESSEE")
        .when(F.col("kind") != R.APPLICATION, "FORM_KIND").otherwise("DEFAULT_APPLICANT")
    )
    rows = rows.withColumn("reason", reason).withColumn("role", F.when(F.col("reason").isin("OFFICE_FIELD", "FORM_KIND"), "office").when(F.col("reason") == "DEFAULT_APPLICANT", "applicant").otherwise("noise"))
    known = F.col("role") != "noise"
    rows = rows.withColumn("m", R.meaning(label))
    return rows.select(*TABLE, "row", "col", "label", "role", "reason", F.when(known, F.col("m.semantic")).otherwise("").alias("semantic"), F.when(known, F.col("m.input")).otherwise("").alias("input"), F.when(~known, "").when(says(label, R.THIRD_PARTY), "thirdParty").otherwise("self").alias("subject"))


def input_schemas(kinds: DataFrame, roles: DataFrame) -> DataFrame:
    """(doc, doc_type, kind, inputs, applicant, office, noise, sensitive): how many fields of each role a form has; documents without
    fields have zeros. sensitive counts secret fields of the applicant."""
    n = lambda c: F.count(F.when(c, 1))
    role = F.col("role")
    counts = roles.groupBy(*DOC).agg(n(role != "noise").alias("inputs"), n(role == "applicant").alias("applicant"), n(role == "office").alias("office"), n(role == "noise").alias("noise"), n((role == "applicant") & (F.col("input") == "secret")).alias("sensitive"))
    return kinds.select("doc", "doc_type", "kind").join(counts, "doc", "left").fillna(0, ["inputs", "applicant", "office", "noise", "sensitive"])


def roles_of(cells: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kinds, roles) of documents by their cells; see form_kinds() and field_roles()."""
    fields = field_cells(cells)
    kinds = form_kinds(documents, document_evidence(cells), fields)
    return kinds, field_roles(fields, kinds, cells)


def split_items(text: Column) -> Column:
    """The things that a text lists by numbers, syllables or circled numbers; one thing where it lists none; null and empty: none."""
    plain = normal(text)
    parts = F.split(F.regexp_replace(plain, f"({ITEM})", "\u0001$1"), "\u0001")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^[ .·,]+|[ .·,]+$", ""), rf"^(?:{ITEM})\s*", "")))
    items = F.filter(bare, lambda p: F.length(p) >= 2)
    return F.when(F.size(items) > 0, items).when(F.length(plain) >= 2, F.array(plain)).otherwise(F.array().cast("array<string>"))


def requirements(cells: DataFrame) -> DataFrame:
    """(doc, attachments, processing_time, fee, procedure, laws, submit_to): what a form asks for besides its fields.

    The value of a label stands behind it in its own cell, else up to RIGHT columns to the right, else up to BELOW rows below, other
    labels left out; of several cells with a label the first that has a value counts. laws: the first LAWS with their articles, each
    once, in order. Documents whose cells are all blank have a row without values.
    """
    rows = cells.select(*TABLE, "row", "col", normal(F.col("text")).alias("text")).repartition(*TABLE)
    value = F.when((F.col("text") != "") & ~says(F.col("text"), LABELLED), F.col("text"))
    right = F.first(value, ignorenulls=True).over(Window.partitionBy(*TABLE, "row").orderBy("col").rangeBetween(1, RIGHT))
    below = F.first(value, ignorenulls=True).over(Window.partitionBy(*TABLE, "col").orderBy("row").rangeBetween(1, BELOW))
    at = F.struct("tbl", "row", "col")
    rows = rows.withColumn("right", right).withColumn("below", below)
    law = F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit(LAW), F.lit(1)).alias("law"), F.regexp_extract_all("text", F.lit(LAW), F.lit(2)).alias("art")), lambda x: F.trim(F.concat_ws(" ", F.trim(x["law"]), normal(x["art"]))))
    taken = {}
    for name, label in ASKED.items():
        inline = F.trim(F.regexp_replace(F.regexp_replace("text", f"(?U){label}", ""), r"^[ :·|]+", ""))
        found = F.when(says(F.col("text"), label), F.coalesce(F.when(inline != "", inline), F.col("right"), F.col("below")))
        taken[name] = F.min_by(found, F.when(found.isNotNull(), at)).alias(name)
    to = normal(F.regexp_extract("text", ADDRESSED_TO, 1))
    whole = rows.groupBy(*DOC).agg(*taken.values(), F.min_by(F.when(to != "", to), F.when(to != "", at)).alias("submit_to"))
    named = rows.select("doc", at.alias("at"), F.posexplode(law).alias("nth", "law")).groupBy("doc", "law").agg(F.min(F.struct("at", "nth")).alias("first"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("first"))
    laws = named.withColumn("place", place).where(F.col("place") <= LAWS).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "law"))), lambda x: x["law"]).alias("laws"))
    empty = F.array().cast("array<string>")
    return whole.join(laws, "doc", "left").select("doc", split_items(F.col("attachments")).alias("attachments"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("processing_time", "fee", "procedure")), F.coalesce("laws", empty).alias("laws"), F.coalesce("submit_to", F.lit("")).alias("submit_to"))
