"""Tables with merged cells: the slots that each cell takes, its neighbours by slots, and the cells that wait for a value.

Cells have row, col (their upper left slot, from 0), row_span, col_span and text. One shuffle by slot brings each slot together with the
cell on it and the cells that end beside it and above it; one more by table gives what concerns the table as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.values import is_blank

#: What a label says of its field, the first that it contains counts.
FIELDS = {
    "projectName": "공사명 사업명 프로젝트명", "siteName": "현장명 현장 사업위치 사업장소재지", "contractorName": "시공사 도급사 수급인 업체명 회사명 상호", "reportDate": "작성일 보고일 제출일 신고일자",
    "receiptNumber": "접수번호 접수번 문서번호 접수", "startDate": "시작일 착수일 착공일", "endDate": "종료일 완료일 준공일", "completionDate": "준공일 완공일", "responsiblePerson": "담당자 책임자 성명",
    "inspector": "검사자 검토자 감리원", "remarks": "비고 참고 특이사항", "quantity": "수량", "amount": "금액 단가", "materialName": "품명 자재명 품목", "spec": "규격 사양", "unit": "단위",
    "status": "상태 진행상태 검측상태 자재상태 승인상태 완료여부", "progressRate": "진행률 공정률",
}
#: The same for fields of a state, headers of data tables, and what a table says that takes no input.
STATES = {"progressRate": "진행률 공정률", "inspectionStatus": "검측상태", "materialStatus": "자재상태", "approvalStatus": "승인상태", "completedFlag": "완료여부", "status": "상태 진행상태"}
DATA_HEADERS = "품명 자재명 수량 단위 규격 단가 금액 번호 비고 spec qty"
STAMPS, PAGES, LEGAL = "직인|결재|서명|인감", "쪽|페이지|page", r"처리절차|첨부서류|별지\s*제\d+호|쪽번호|210mm|297mm|작성요령|유의사항"
#: Layouts without slots, unsafe ones, those of forms, and those in which further ways of finding slots are used.
NO_SLOTS, UNSAFE = ("stamp_or_approval_table", "layout_noise"), ("stamp_or_approval_table", "page_marker_table", "layout_noise")
FORMS, EXTENDED = ("nested_container_table", "horizontal_table", "form_table"), ("nested_container_table", "horizontal_table", "form_table", "basic_info", "data_table")
ROLES = ("basic_info", "data_table")


def field_of(text: Column, fields: dict[str, str] = FIELDS) -> Column:
    """The first field one of whose words the text contains, or null."""
    return reduce(lambda tail, item: F.when(text.rlike(item[1].replace(" ", "|")), item[0]).otherwise(tail), reversed(fields.items()), F.lit(None).cast("string"))


def occupied(cells: DataFrame, by: list[str]) -> DataFrame:
    """A row for each slot that a cell takes: by, at_row, at_col, covered (not the cell's own corner), and the cell's columns."""
    slots = cells.select("*", F.explode(F.sequence(F.col("row"), F.col("row") + F.greatest("row_span", F.lit(1)) - 1)).alias("at_row"))
    slots = slots.select("*", F.explode(F.sequence(F.col("col"), F.col("col") + F.greatest("col_span", F.lit(1)) - 1)).alias("at_col"))
    return slots.withColumn("covered", (F.col("at_row") != F.col("row")) | (F.col("at_col") != F.col("col")))


def neighbours(cells: DataFrame, by: list[str], more: DataFrame | None = None) -> DataFrame:
    """(by, at_row, at_col, cell, covered, left, above): each slot with the cell on it (null outside the table's cells) and the cells
    that say something and end right before it in its row, or right above it in its column, by their corner's row and column.

    Where cells lie on each other, the one that begins last counts. cells: by, row, col, row_span, col_span, text and any columns that
    go along with a cell. more: further slots (by, at_row, at_col) that get a row, whether any cell meets them or not.
    """
    rest = [c for c in cells.columns if c not in (*by, "row", "col")]
    shape = F.struct("row", "col", *rest)
    none = F.lit(None).cast(cells.select(shape.alias("s")).schema["s"].dataType)
    on = occupied(cells, by).select(*by, "at_row", "at_col", shape.alias("cell"), none.alias("left"), none.alias("above"))
    asking = cells.where(~is_blank(F.col("text")))
    right = asking.select(*by, F.col("row").alias("at_row"), (F.col("col") + F.greatest("col_span", F.lit(1))).alias("at_col"), none.alias("cell"), shape.alias("left"), none.alias("above"))
    below = asking.select(*by, (F.col("row") + F.greatest("row_span", F.lit(1))).alias("at_row"), F.col("col").alias("at_col"), none.alias("cell"), none.alias("left"), shape.alias("above"))
    met = on.unionByName(right).unionByName(below)
    if more is not None:
        met = met.unionByName(more.select(*by, "at_row", "at_col", *(none.alias(c) for c in ("cell", "left", "above"))))
    met = met.groupBy(*by, "at_row", "at_col").agg(*(F.max(c).alias(c) for c in ("cell", "left", "above")))
    return met.withColumn("covered", F.col("cell").isNotNull() & ((F.col("cell.row") != F.col("at_row")) | (F.col("cell.col") != F.col("at_col"))))


def table_facts(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_cols, known, has_header, last_row, last_filled, last_col, says): what a table's cells say together. says: the first
    reason, by rows, that the table takes no input."""
    text, at = F.coalesce(F.col("text"), F.lit("")), F.struct("row", "col")
    reason = F.when(text.rlike(STAMPS), "stamp_keyword").when(F.lower(text).rlike(PAGES) & (F.length(text) <= 10), "page_marker_keyword").when(text.rlike(LEGAL), "legal_notice_pattern")
    return cells.groupBy(*by).agg(
        F.max(F.col("col") + F.greatest("col_span", F.lit(1))).alias("n_cols"), F.count("field").alias("known"),
        F.max((F.col("row") == 0) & text.rlike(DATA_HEADERS.replace(" ", "|"))).alias("has_header"), F.max("row").alias("last_row"),
        F.max(F.struct("row", (~is_blank(text)).alias("filled"))).alias("last"), F.max(F.struct("row", (-F.col("col")).alias("back"))).alias("first"), F.min_by(reason, F.when(reason.isNotNull(), at)).alias("says"),
    ).select(*by, "n_cols", "known", "has_header", "last_row", F.col("last.filled").alias("last_filled"), (-F.col("first.back")).alias("last_col"), "says")


def _hit(source: str, when: Column, label: Column, field: Column, confidence: Column, reason: str | None = None, role: str = "unknown") -> Column:
    why = F.when(confidence < 0.7, "low_confidence").otherwise(F.lit(reason).cast("string"))
    return F.when(when, F.struct(F.lit(source).alias("source"), label.alias("label"), F.coalesce(field, F.lit("unknown")).alias("field"), confidence.cast("double").alias("confidence"), why.alias("reason"), F.lit(role).alias("role")))


def slot_hits(cells: DataFrame, by: list[str], tables: DataFrame) -> DataFrame:
    """(by, row, col, hits, layout, table_role, says): each slot, or row to append, with all ways in which it was found to wait for a value,
    in their order: label_right, label_below, label_value_pair, merged_input_cell, blank_after_known_header, metadata_form_slot,
    data_table_append_slot, status_cell.

    tables: by, layout, role (null: as the layout). A slot is a blank cell's corner; slots that a merged cell covers are none. Tables
    that `tables` doesn't have are of layout unknown; those of a layout without slots give none. The last four are looked for in
    extended layouts and roles. Null texts are blank; tables without cells give nothing.
    """
    likely = F.col("likely") if "likely" in cells.columns else F.lit(False)
    cells = cells.select(*by, "row", "col", "row_span", "col_span", "text", likely.alias("likely"), field_of(F.col("text")).alias("field"), field_of(F.col("text"), STATES).alias("state"))
    facts = table_facts(cells, by).join(tables.select(*by, "layout", "role"), by, "left")
    facts = facts.withColumn("layout", F.coalesce("layout", F.lit("unknown"))).withColumn("role", F.coalesce("role", "layout")).where(~F.col("layout").isin(*NO_SLOTS))
    facts = facts.withColumn("extended", F.col("layout").isin(*EXTENDED) | F.col("role").isin(*ROLES)).withColumn("append_row", F.when(F.col("extended") & F.col("has_header") & (F.col("last_row") >= 1), F.col("last_row") + F.col("last_filled").cast("int")))
    facts = facts.withColumn("append_col", F.when(F.col("last_filled"), 0).otherwise(F.col("last_col")))
    appended = facts.where("append_row IS NOT NULL").select(*by, F.col("append_row").alias("at_row"), F.col("append_col").cast("int").alias("at_col"))
    at = neighbours(cells, by, appended).join(facts, by)
    open_ = F.col("cell").isNotNull() & ~F.col("covered") & is_blank(F.col("cell.text"))
    left, above = F.col("left.text"), F.col("above.text")
    of_left, of_above, state = F.col("left.field"), F.col("above.field"), F.col("left.state")
    form, extended = F.col("layout").isin(*FORMS), F.col("extended")
    by_known = lambda field, yes, no: F.when(field.isNotNull(), yes).otherwise(no)
    merged = F.greatest("cell.row_span", F.lit(1)) * F.greatest("cell.col_span", F.lit(1)) >= 2
    paired = F.col("n_cols").isin(2, 4) & (F.col("left.col") % 2 == 0) & (F.greatest("left.col_span", F.lit(1)) == 1)
    hits = [
        _hit("label_right", open_ & left.isNotNull() & (F.col("left.likely") | (F.length(left) <= 20)), left, of_left, by_known(of_left, 0.88, 0.65)),
        _hit("label_below", open_ & above.isNotNull() & (F.length(above) <= 20), above, of_above, by_known(of_above, 0.75, 0.55)),
        _hit("label_value_pair", open_ & paired & of_left.isNotNull(), left, of_left, F.lit(0.82)),
        _hit("merged_input_cell", open_ & merged & of_left.isNotNull() & (F.length(left) <= 20), left, of_left, F.lit(0.75), "merged_cell_review"),
        # Of a label above and one on the left, the one above comes first in the order of rows.
        _hit("blank_after_known_header", open_ & extended & (of_above.isNotNull() | of_left.isNotNull()), F.when(of_above.isNotNull(), above).otherwise(left), F.coalesce(of_above, of_left), by_known(of_above, 0.78, 0.85)),
        _hit("metadata_form_slot", open_ & extended & of_left.isNotNull() & (form | (F.col("known") >= 3)), left, of_left, F.when(form, 0.90).otherwise(0.82), role="basic_info"),
        _hit("data_table_append_slot", (F.col("append_row") == F.col("at_row")) & (F.col("append_col") == F.col("at_col")), F.lit(""), F.lit("appendRow"), F.lit(0.72), "append_slot_requires_review", "data_table"),
        _hit("status_cell", open_ & extended & state.isNotNull(), left, state, F.lit(0.78)),
    ]
    return at.select(*by, F.col("at_row").alias("row"), F.col("at_col").alias("col"), F.array_compact(F.array(*hits)).alias("hits"), "layout", F.col("role").alias("table_role"), "says")


def scored_hits(hits: DataFrame, by: list[str], source: str | None = None) -> DataFrame:
    """(by, row, col, source, label, field, confidence, auto_edit, review, review_reason, unsafe_reason, role): the first way in which each
    slot was found, or those of one source alone.

    Confidence rises by 0.10 in tables of basic data or data, by 0.05 in nested and horizontal ones, to 0.98 at most. From 0.90 on a slot
    may be filled without a person, unless something asks for one: low confidence, a merged cell, a row to append, an unsafe table.
    """
    chosen = F.filter("hits", lambda h: h["source"] == source) if source else F.slice("hits", 1, 1)
    rows = hits.select("*", F.explode(chosen).alias("hit"))
    role = F.when(F.col("hit.role") != "unknown", F.col("hit.role")).otherwise(F.col("table_role"))
    raised = F.when(role.isin(*ROLES), F.least(F.lit(0.98), F.col("hit.confidence") + 0.10)).otherwise(F.col("hit.confidence"))
    raised = F.round(F.when(F.col("layout").isin("nested_container_table", "horizontal_table"), F.least(F.lit(0.98), raised + 0.05)).otherwise(raised), 2)
    unsafe = F.when(F.col("layout").isin(*UNSAFE), F.col("layout")).otherwise(F.col("says"))
    review = F.col("hit.reason").isNotNull() | unsafe.isNotNull()
    return rows.select(*by, "row", "col", "hit.source", "hit.label", "hit.field", raised.alias("confidence"), ((raised >= 0.9) & ~review).alias("auto_edit"), review.alias("review"), F.col("hit.reason").alias("review_reason"), unsafe.alias("unsafe_reason"), role.alias("role"))
