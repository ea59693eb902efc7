"""Addresses, file layouts and one file for each category on small cases."""

from pyspark.sql import functions as F

from formloom.operators import files as O


def test_addresses(spark):
    there = spark.createDataFrame([(["d", "t0", "r0", "c0"],), (["d", "t0", "r1"],), (["e"],), (None,), ([],)], "path array<string>")
    asked = {1: ["d", "t0", "r0", "c0"], 2: ["x", "t0", "r0", "c0"], 3: ["d", "t1", "r0", "c0"], 4: ["d", "t0", "r1", "c0"], 5: ["e", "t0", "r0", "c0"], 6: ["d", "t0"], 7: None, 8: ["d", None, "r0", "c0"], 9: ["d", "t0", "r0", "c0", "more"]}
    got = O.first_failures(spark.createDataFrame([*asked.items()], "id int, path array<string>"), there, ["doc", "table", "row", "cell"])
    assert {r.id: r.failed for r in got.collect()} == {1: None, 2: "doc", 3: "table", 4: "cell", 5: "table", 6: "row", 7: "doc", 8: "table", 9: None}
    verdicts = {r.owner: (r.total, r.ok, r.failed, dict(r.reasons), r.verdict) for r in O.address_verdicts(got, F.col("id") % 2, 0.3).collect()}
    assert verdicts == {0: (4, 0, 4, {"doc": 1, "cell": 1, "row": 1, "table": 1}, "FAIL"), 1: (5, 2, 3, {"table": 2, "doc": 1}, "PASS")}
    assert O.first_failures(spark.createDataFrame([], "id int, path array<string>"), there, ["doc"]).count() == 0


def test_layouts(spark):
    cases = [(["뒤쪽", "x"], 5, 0, 0, 2, "BACK_SIDE_FORM"), (["결재", "담당", "과장", "x"], 5, 0, 0, 2, "PUBLIC_DOC_APPROVAL_FORM"), ([], 9, 1, 0, 1, "HEADER_COLUMN_FORM"), ([], 4, 6, 0, 1, "LABEL_ADJACENT_FORM"), (None, 0, 0, None, 1, "TABLE_LIST_ONLY"), (["결재", "담당"], 5, 2, 3, 1, "UNKNOWN"), (None, None, None, None, None, "UNKNOWN")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, h array<string>, c int, a int, f int, t int, expected string")
    rows = df.select("expected", O.file_layout(*(F.col(x) for x in "hcaft")).alias("l")).collect()
    assert [r.l.layout for r in rows] == [r.expected for r in rows]
    survey = spark.createDataFrame([(10, 0, 0, 2), (10, 0, 7, 2), (0, 0, 0, 1), (3, 3, 0, 1)], "n int, f int, v int, t int")
    assert [r.l.layout for r in survey.select(O.surveyed_layout(*(F.col(x) for x in "nfvt")).alias("l")).collect()] == ["HEADER_COLUMN_FORM", "LABEL_ADJACENT_FORM", "TABLE_LIST_ONLY", "UNKNOWN"]


def test_one_for_each(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 9), (None, 10)], "file string, n int")
    one = {"small": (F.col("n") < 5, []), "most": (F.lit(True), [F.desc("n")]), "next": (F.lit(True), [F.desc("n")]), "none": (F.lit(True), [])}
    assert [tuple(r) for r in O.one_for_each(df, "file", one).collect()] == [("small", "a"), ("most", "c"), ("next", "b")]
    assert O.one_for_each(df.limit(0), "file", one).count() == 0
