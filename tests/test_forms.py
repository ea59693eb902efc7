"""Roles of fields, kinds of forms and requirements: golden cases, and labelled forms with a floor of accuracy."""


import pytest
from pyspark.sql import functions as F

from formloom.functions import form_rules as R
from formloom.operators import forms as O

CELL, NAME = "doc string, tbl int, row int, col int, text string", "doc string, name string"


@pytest.fixture(scope="module")
def forms(spark):
    pair = lambda doc, tbl, rows: [(doc, tbl, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]
    cells = pair("pension", 0, [("접수번호", ""), ("성명", ""), ("주민등록번호", " ")]) + pair("pension", 1, [("처리절차",), ("청구인", "")])
    cells += pair("ledger", 0, [("일련번호", ""), ("성명", None)]) + pair("notice", 0, [("성명", ""), ("사유", "")]) + pair("report", 0, [("사업장명", ""), ("공사기간", "")])
    cells += pair("sealed", 0, [("성명", ""), ("○○전파관리소장 [직인]", "x")]) + pair("strong", 0, [("접수 번호", ""), ("담당공무원 확인사항", "x"), ("법정대리인 성명", ""), ("국세청장 귀하", "")])
    cells += pair("months", 0, [("금액", "비고"), ("1", ""), ("2", "")]) + pair("title", 0, [("도로 연결 허가신청서", ""), ("주소", ""), ("수수료", ""), ("▶", "")])
    names = {"pension": "연금 청구서.hwpx", "ledger": "채혈금지대상자 관리대장.hwpx", "notice": "처분 통지서.hwpx", "report": "선임보고서_32.hwpx", "sealed": "무선국 신고증명서", "strong": "농지등의 명세서", "months": "사용량 신고서", "title": "13638955_도로 연결 허가신청서.hwpx", "none": None}
    kinds, roles = O.roles_of(spark.createDataFrame(cells, CELL), spark.createDataFrame([*names.items()], NAME))
    schemas = {r.doc: r for r in O.input_schemas(kinds, roles).collect()}
    return {(r.doc, r.label): r for r in roles.collect()}, schemas


def test_roles(forms):
    roles, schemas = forms
    of = lambda doc: {label: r.role for (d, label), r in roles.items() if d == doc}
    assert of("pension") == {"접수번호": "office", "성명": "applicant", "주민등록번호": "applicant", "청구인": "noise"}
    assert (schemas["pension"].inputs, schemas["pension"].applicant, schemas["pension"].office, schemas["pension"].sensitive) == (3, 2, 1, 1)
    assert (schemas["ledger"].doc_type, schemas["ledger"].inputs, schemas["ledger"].applicant) == (R.LEDGER, 2, 0)
    assert schemas["notice"].applicant == 0 and schemas["report"].applicant == 2
    assert (schemas["sealed"].kind, schemas["strong"].kind, schemas["none"].inputs) == (R.CERTIFICATE, R.APPLICATION, 0)
    assert of("strong") == {"접수 번호": "office", "법정대리인 성명": "applicant", "국세청장 귀하": "noise"}
    assert roles["strong", "법정대리인 성명"].subject == "thirdParty" and roles["pension", "성명"].subject == "self"
    assert set(of("months")) == {"금액 1", "금액 2"} and roles["months", "금액 1"].input == "number"
    assert of("title") == {"도로 연결 허가신청서": "noise", "주소": "applicant", "수수료": "noise", "▶": "noise"}


def test_types_of_names(spark):
    cases = {
        "13638955_도로 연결 허가신청서.hwpx": (R.APPLY, True), "18195161_소방공무원기장_수여대장.hwpx": (R.LEDGER, True), "12227797_법인_설립허가증.hwpx": (R.ISSUED, True), "삭제 2014 7 29.hwpx": (R.OTHER, False), "과징금 산정 별표": (R.STANDARD, False), "c563771748119 023 별지 제4호서식 건축관계자 변경신고서": (R.APPLY, True),
        "선임보고서": (R.NOTICE, True), "공사 계획서": (R.PLAN, True), "위임장": (R.AGREEMENT, True), "손익계산서": (R.PLAN, True), "추천서 송부": (R.NOTICE, True), "임명장": (R.ISSUED, True), "고발장": (R.APPLY, True), "아무 이름": (R.OTHER, True), "": (R.OTHER, True),
    }
    df = spark.createDataFrame([(n,) for n in cases], "name string")
    got = {r.name: (r.t.doc_type, r.t.fillable) for r in df.select("name", R.document_type(R.form_name(F.col("name")), F.lit(3)).alias("t")).collect()}
    assert got == cases


def test_meanings(spark):
    cases = {"주민등록번호": ("residentNo", "secret"), "사업장 소재지": ("address", "address"), "연락처": ("phone", "tel"), "이메일": ("email", "email"), "E-mail": ("email", "email"), "아파트명": ("buildingName", "text"), "발급일": ("date", "date"), "남/여": ("gender", "select"), "모름": ("", "text")}
    df = spark.createDataFrame([(n,) for n in cases], "label string")
    assert {r.label: tuple(r.m) for r in df.select("label", R.meaning(F.col("label")).alias("m")).collect()} == cases


#: Labels of forms with the roles that people gave them, where each label's own words and the form's name are all there is to go by.
LABELLED = """
국가부담비용_정산서 | 접수번호:office 주소:applicant 보상구분:applicant 지급금액(원):applicant 정산내용:applicant 년월일:applicant 국토교통부장관:noise 첨부서류:noise 처리절차:noise
도로와_다른_시설의_연결허가신청서 | 도로와다른시설의연결허가신청서:noise 접수번호:office 접수일:office 처리기간:office 성명:applicant 생년월일:applicant 주소:applicant 전화번호:applicant 연결목적:applicant 수수료:noise
소방공무원기장_수여대장 | 번호:office 성명:office 소속:office 계급:office 수여일:office 비고:office
법인_설립허가증 | 허가번호:office 법인명칭:office 소재지:office 대표자:office
"""


def test_accuracy_on_labelled_forms(spark):
    cells, names, truth = [], [], {}
    for doc, line in enumerate(LABELLED.strip().splitlines()):
        name, labels = (x.strip() for x in line.split("|"))
        names.append((str(doc), f"{name}.hwpx"))
        cells.append((str(doc), 9, 0, 0, "수수료" if "신청" in name or "정산" in name else "x"))
        for r, item in enumerate(labels.split()):
            label, role = item.rsplit(":", 1)
            cells += [(str(doc), r, 0, 0, label), (str(doc), r, 0, 1, "")]
            truth[str(doc), label] = role
    _, roles = O.roles_of(spark.createDataFrame(cells, CELL), spark.createDataFrame(names, NAME))
    got = {(r.doc, r.label): r.role for r in roles.collect()}
    right = sum(got.get(k) == v for k, v in truth.items())
    print(f"roles: {right} of {len(truth)}")
    assert right / len(truth) >= 0.95


def test_requirements(spark):
    rows = [(0, 0, "첨부서류"), (0, 1, "1. 지정서 2. 현황표"), (1, 0, "처리기간"), (1, 1, "7일"), (2, 0, "수수료"), (2, 1, ""), (2, 2, "성명"), (2, 3, "없음"), (3, 0, "「건설기술 진흥법」 제20조에 따라 「도로법」 및 「건설기술 진흥법」 제20조 신청합니다"), (4, 0, "국토교통부장관 귀하"), (5, 0, "처리 절차 : 접수 후 검토")]
    cells = [("a", 0, r, c, t) for r, c, t in rows] + [("b", 0, 0, 0, ""), ("c", 0, 0, 0, "수수료"), ("c", 0, 1, 0, "300원"), ("c", 1, 0, 0, "수수료 면제")]
    got = {r.doc: r for r in O.requirements(spark.createDataFrame(cells, CELL)).collect()}
    a = got["a"]
    assert (a.attachments, a.processing_time, a.fee, a.procedure) == (["지정서", "현황표"], "7일", "없음", "접수 후 검토")
    assert (a.laws, a.submit_to) == (["건설기술 진흥법 제20조", "도로법"], "국토교통부장관")
    assert tuple(got["b"])[1:] == ([], "", "", "", [], "") and got["c"].fee == "300원"


def test_items(spark):
    cases = {"1. 지정서 2. 시설현황 3. 고용증명": ["지정서", "시설현황", "고용증명"], "①신분증 ②등본": ["신분증", "등본"], "주민등록등본 1부": ["주민등록등본 1부"], "": [], "가. 도면 나. 12) 사진": ["도면", "사진"]}
    df = spark.createDataFrame([(n,) for n in cases], "t string")
    assert {r.t: r.i for r in df.select("t", O.split_items(F.col("t")).alias("i")).collect()} == cases
