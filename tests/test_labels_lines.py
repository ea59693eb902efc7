"""The taxonomy's golden labels and rules, clusters on a line and points in intervals."""

import random

import pytest

from formloom.functions import taxonomy as X
from formloom.operators import lines as L

GOLDEN = {
    "taskName": "항목 내용 작업명 업무내용 점검항목 검사항목 평가항목 불량내용 조치사항 1차검사항목", "number": "번호 연번 일련번호", "receiptNumber": "접수번호",
    "inspectionStatus": "검사결과 점검결과 조치결과 검측결과 검사기준(시방서또는도면등) 판정기준", "remarks": "비고 참고 특기사항 특이사항", "responsiblePerson": "성명 성명: 담당자 책임자 작성자",
    "quantity": "수량 수_량 수량(개)", "contractorName": "시공사 도급사 수급인 업체명 상호 회사명 회사명:", "durationDays": "기간 공기 공사기간 계약기간", "testType": "종별 시험종별", "testItem": "시험종목", "testMethod": "시험방법",
}


@pytest.fixture(scope="module")
def classes(spark):
    def of(labels, rules=None):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
        return [r.c for r in df.select("i", X.classify(df.label, rules).alias("c")).orderBy("i").collect()]

    return of


def test_golden_fields(classes):
    cases = [(x.replace("_", " "), field) for field, words in GOLDEN.items() for x in words.split()]
    for (label, field), got in zip(cases, classes([x for x, _ in cases])):
        assert (got.field, got.label_class in (X.HIGH, X.MEDIUM)) == (field, True), label


def test_golden_classes(classes):
    cases = {x: X.META for x in "접수 직인 결재 담당 승인 통보 수신 발신 문서번호 시행".split()} | {x: X.BACK for x in "(뒤쪽) 뒤쪽 뒷면 (앞쪽) 앞쪽 (제2쪽) (8쪽중제3쪽) 3/5쪽".split()}
    cases |= {"": X.DECORATION, None: X.DECORATION, "  ": X.DECORATION, "---": X.DECORATION, "12": X.DECORATION, "가": X.DECORATION, "(나)": X.DECORATION, "합 계": X.DECORATION, ". . .": X.DECORATION, "A": X.DECORATION, "a": X.UNKNOWN}
    cases |= {"Gantt-Chart": X.SCHEDULE, "2024-03": X.SCHEDULE, "접수일자": X.META, "모르는칸": X.UNKNOWN, "완공보고서": X.MEDIUM, "ＱＴＹ": X.HIGH, "（뒤쪽）": X.BACK, "검사\n결과": X.HIGH, "①": X.DECORATION}
    for label, got in zip(cases, classes(list(cases))):
        assert got.label_class == cases[label], label
    assert classes(["ﾌｫｰﾑ  x"])[0].label == "フォーム x"


def test_first_rule_decides(classes):
    """Terms inside each other, whole and part, letter case: the rank alone decides, and other rules can be passed."""
    rules = [X.Rule(0, "whole", "Ab", "w", "", 1.0), X.Rule(1, "exact", "abc", "e", "", 0.9), X.Rule(2, "part", "BC", "p", "", 0.8), X.Rule(3, "pattern", "^x+$", "x", "", 0.7), X.Rule(4, "part", "a", "a", "", 0.6)]
    assert [g.label_class for g in classes(["ab", "AB", "abc", "ABC", "zbcz", "xx", "xxa", "q"], rules)] == ["w", "w", "e", "p", "p", "x", "a", X.UNKNOWN]
    assert classes(["xx", "ab"], rules[3:4])[1].label_class == X.UNKNOWN


def test_counts(spark):
    df = spark.createDataFrame([("비고", "a"), ("비고", "b"), ("수량", "a"), (None, "a"), (None, None)], "label string, file string")
    got = X.classified_labels(df, "label", "file")
    assert {(r.raw, r.field, r.occurrences, r.files) for r in got.collect()} == {("비고", "remarks", 2, 2), ("수량", "quantity", 1, 1), (None, "", 2, 1)}
    assert {(r.field, r.labels, r.occurrences) for r in X.class_totals(got).collect()} == {("remarks", 1, 2), ("quantity", 1, 1), ("", 1, 2)}
    assert X.classified_labels(df.limit(0), "label", "file").count() == 0


def test_clusters(spark):
    rows = [("p", 10.0, 40.0, "철"), ("p", 60.0, 55.0, "근"), ("p", 20.0, 55.0, "콘"), ("p", 10.0, 76.0, "혼"), ("p", 10.0, 300.0, "막"), ("p", 10.0, 320.0, "대"), ("p", 90.0, 60.0, "가"), ("p", 10.0, 58.0, "AB"), ("q", 1.0, 58.0, "나"), ("q", 1.0, None, "다")]
    names = L.upright_names(spark.createDataFrame(rows, "page string, x double, y double, text string"), ["page"])
    got = sorted((r.page, r.start, r.end, r.name) for r in names.collect())
    assert got == [("p", 35.0, 130.0, "철콘근"), ("p", 295.0, 395.0, "막대")]  # 76 lies 21 below 55
    prices = spark.createDataFrame([("p", 1, 35.0), ("p", 2, 130.0), ("p", 3, 131.0), ("p", 4, 395.0), ("q", 5, 58.0), ("p", 6, None)], "page string, id int, y double")
    assert {(r.id, r.name) for r in L.named_rows(prices, names, ["page"]).collect()} == {(1, "철콘근"), (2, "철콘근"), (4, "막대")}


def test_points_in_intervals(spark):
    r = random.Random(2)
    points = [(i % 2, i, float(r.randrange(-200, 200))) for i in range(80)] + [(0, 99, None)]
    intervals = [(i % 2, i, *(lambda s, n: (float(s), float(s + n)))(r.randrange(-200, 200), r.choice([0, 1, 5, 300, -3]))) for i in range(40)]
    expected = {(b, p, i) for b, p, x in points for c, i, s, e in intervals if b == c and x is not None and s <= x <= e}
    a, b = spark.createDataFrame(points, "line int, id int, x double"), spark.createDataFrame(intervals, "line int, id int, start double, end double")
    got = [(q.line, q.point, q.interval) for q in L.points_in(a, b, ["line"]).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    marks = [(i % 2, i, float(r.randrange(-200, 200))) for i in range(20)]
    near = {(b, p): min((abs(x - m), i) for c, i, m in marks if c == b) for b, p, x in points if x is not None}
    got = {(q.line, q.point): (q.distance, q.mark) for q in L.nearest_within(a, spark.createDataFrame(marks, "line int, id int, x double"), ["line"], 9.0).collect()}
    assert got == {k: v for k, v in near.items() if v[0] <= 9}
