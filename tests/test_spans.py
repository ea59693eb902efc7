"""Slots of tables with merged cells: golden cases of each way of finding them, occupancy, odd tables."""

import pytest

from formloom.operators import spans as S

CELL = "tbl string, row int, col int, row_span int, col_span int, text string"


@pytest.fixture(scope="module")
def found(spark):
    """name -> (all hits by source, first hits) of one table for each case."""
    cases = {
        "right": ("horizontal_table", [(0, 0, 1, 1, "공사명"), (0, 1, 1, 1, ""), (1, 0, 1, 1, "가나다"), (1, 1, 1, 1, None)]),
        "below": ("form_table", [(0, 0, 1, 1, "현장명"), (0, 1, 1, 1, "abc"), (1, 0, 1, 1, " "), (1, 1, 1, 1, "x")]),
        "pair4": ("text_table", [(0, 0, 1, 1, "접수번호"), (0, 1, 1, 1, ""), (0, 2, 1, 1, "공사명"), (0, 3, 1, 1, "")]),
        "pair3": ("text_table", [(0, 0, 1, 1, "접수번호"), (0, 1, 1, 1, ""), (0, 2, 1, 1, "공사명")]),
        "merged": ("text_table", [(0, 0, 1, 1, "비고"), (0, 1, 2, 2, ""), (1, 0, 1, 1, "수량"), (2, 0, 1, 3, "끝")]),
        "metadata": ("horizontal_table", [(r, c, 1, 1, ("공사명", "현장명", "시공사")[r] if c == 0 else "") for r in range(3) for c in range(2)]),
        "data": ("data_table", [(0, 0, 1, 1, "품명"), (0, 1, 1, 1, "수량"), (1, 0, 1, 1, "철근"), (1, 1, 1, 1, "3")]),
        "data_open": ("data_table", [(0, 0, 1, 1, "품명"), (0, 1, 1, 1, "수량"), (1, 0, 1, 1, ""), (1, 1, 1, 1, "")]),
        "status": ("data_table", [(0, 0, 1, 1, "검측상태"), (0, 1, 1, 1, ""), (1, 0, 1, 1, "a"), (1, 1, 1, 1, "b")]),
        "stamp": ("stamp_or_approval_table", [(0, 0, 1, 1, "공사명"), (0, 1, 1, 1, "")]),
        "unsafe": ("horizontal_table", [(0, 0, 1, 1, "공사명"), (0, 1, 1, 1, ""), (1, 0, 1, 1, "결재"), (1, 1, 1, 1, "3쪽")]),
        "wide_label": ("form_table", [(0, 0, 2, 2, "성명"), (0, 2, 1, 1, ""), (1, 2, 1, 1, "")]),
    }
    cells = spark.createDataFrame([(name, *c) for name, (_, rows) in cases.items() for c in rows], CELL)
    tables = spark.createDataFrame([(name, layout, None) for name, (layout, _) in cases.items()], "tbl string, layout string, role string")
    hits = S.slot_hits(cells, ["tbl"], tables)
    every, first = {}, {}
    for r in hits.collect():
        for h in r.hits:
            every.setdefault(r.tbl, {}).setdefault(h.source, {})[r.row, r.col] = (h.label, h.field, h.confidence)
    for r in S.scored_hits(hits, ["tbl"]).collect():
        first.setdefault(r.tbl, {})[r.row, r.col] = (r.source, r.confidence, r.auto_edit, r.review_reason, r.unsafe_reason, r.role)
    return every, first


def test_right_and_below(found):
    every, first = found
    assert every["right"]["label_right"] == {(0, 1): ("공사명", "projectName", 0.88), (1, 1): ("가나다", "unknown", 0.65)}
    assert first["right"][0, 1] == ("label_right", 0.93, True, None, None, "horizontal_table")
    assert first["right"][1, 1] == ("label_right", 0.70, False, "low_confidence", None, "horizontal_table")
    assert every["below"]["label_below"] == {(1, 0): ("현장명", "siteName", 0.75)}


def test_pairs_and_merged(found):
    every, first = found
    assert set(every["pair4"]["label_value_pair"]) == {(0, 1), (0, 3)} and "label_value_pair" not in every["pair3"]
    assert every["merged"]["merged_input_cell"] == {(0, 1): ("비고", "remarks", 0.75)}
    assert set(every["merged"]["label_right"]) == {(0, 1)}  # the merged cell's other slots are no corner
    assert every["wide_label"]["label_right"] == {(0, 2): ("성명", "responsiblePerson", 0.88)}


def test_forms_data_states(found):
    every, first = found
    assert {k: v[2] for k, v in every["metadata"]["metadata_form_slot"].items()} == {(r, 1): 0.9 for r in range(3)}
    assert first["data"][2, 0][0] == "data_table_append_slot" and first["data_open"][1, 0][0] == "label_below"
    assert set(every["data_open"]["data_table_append_slot"]) == {(1, 0)}
    assert every["status"]["status_cell"] == {(0, 1): ("검측상태", "inspectionStatus", 0.78)}
    assert "stamp" not in first and first["unsafe"][0, 1] == ("label_right", 0.93, False, None, "stamp_keyword", "horizontal_table")


def test_odd_tables(spark):
    empty = spark.createDataFrame([], CELL)
    tables = spark.createDataFrame([("a", None, None)], "tbl string, layout string, role string")
    assert S.slot_hits(empty, ["tbl"], tables).count() == 0
    one = spark.createDataFrame([("a", 0, 0, 0, 0, "공사명"), ("a", 0, 1, 3, 70, None), ("a", 0, 1, 1, 1, "위에"), ("b", 5, 5, 1, 1, "")], CELL)
    assert S.scored_hits(S.slot_hits(one, ["tbl"], tables), ["tbl"]).where("tbl = 'b'").count() == 0
    assert S.occupied(one, ["tbl"]).count() == 1 + 210 + 1 + 1
