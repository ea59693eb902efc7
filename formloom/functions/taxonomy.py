"""A taxonomy of labels: one ordered table of rules, matched by an automaton that is compiled once.

A rule's terms match whole labels or parts of them; the rule that comes first among all that match decides. Labels are folded by
Unicode's compatibility form before that, which Spark has no function for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, MEDIUM, LOW = "MAPPED_HIGH_CONFIDENCE", "MAPPED_MEDIUM_CONFIDENCE", "REVIEW_REQUIRED_LOW_CONFIDENCE"
META, DECORATION, BACK = "IGNORED_PUBLIC_DOC_META", "IGNORED_DECORATIVE_OR_STAMP", "BACK_SIDE_HINT"
SCHEDULE, UNKNOWN = "SCHEDULE_CANDIDATE", "UNKNOWN"

#: Words of an office's own part of a form, whole labels and parts of them; marks; totals; words of schedules.
META_WORDS = """접수 직인 결재 담당 검토 승인 통보 시행 문서번호 시행일자 수신 참조 발신 수신처 발신처 계장 과장 부장 팀장 국장 처장 차장
기안 전결 대결 전결기준 인 서명또는인 신청서 신고서 신고필증 처리절차 신청서작성 신고서작성 신고필증작성 신고필증교부"""
META_PARTS = "결재란 접수란 처리란 접수일 접수부서 신청서 신고서 처리기간 수신기관"
MARKS = "→ ‣ ■ ▶ ➡ ▲ ◆ ● ○ △ ※ ☆ ★ ◎ · ・ • … A B C Q I II III IV 1 2 3 4 5"
TOTALS = "총계 소계 합계 계 평균 누계 합 총합 소합 중간합계"
SCHEDULES = "공정표 예정공정 일정표 공정관리 공정계획 gantt schedule 진행률 진도율 공정명"
#: Page marks, labels of signs, digits or a single syllable alone, dates.
BACK_PATTERN = r"뒤쪽|뒷면|앞쪽|앞면|[(\[（]\s*제?\s*\d+\s*쪽\s*(?:중\s*제\s*\d+\s*쪽)?\s*[)\]）]|\(\d+쪽중제?\d+쪽\)|\d+\s*/\s*\d+\s*쪽"
MARK_PATTERN = r"^[\s\-_=*#@!?,.;:'\"`~^&%$|()\[\]{}]+$|^[0-9]+$|^[가-힣]$|^\([가-힣]\)$|^\([0-9]+쪽.*\)$"
DATE_PATTERN = r"^\d{4}[-./]\d{1,2}"
#: Fields, how sure a whole label is of each, whole labels and parts of labels ("_" stands for a blank).
FIELDS = """
taskName 0.95 | 항목 내용 작업명 업무내용 공사내용 | 검사항목 점검항목 평가항목 확인항목 조치사항 불량내용 요구사항분류 보안요구사항 구축기준 1차검사항목 2차검사항목 차검사항목 평가내용 시정내용 조치내용 점검내용
receiptNumber 0.95 | 접수번호 접수일련번호 | 접수번 문서접수
number 0.95 | 번호 연번 일련번호 순번 일련 | 고유번호 관리번호 점검번호 요구사항고유번호 발급번호 법인등록번호
inspectionStatus 0.95 | 검사결과 점검결과 검측결과 확인결과 적합 부적합 합격 불합격 | 검사기준 점검기준 검측기준 판정기준 조치결과 조치확인 시정여부 이행여부 검사항목 점검항목 검측항목 소방시설부분완공 소방시설공사완공 소방시설공사위반
remarks 0.95 | 비고 참고 특기사항 비고란 | 특이사항 검토의견 조치의견 부연설명
responsiblePerson 0.95 | 성명 성명: 성_명 담당자 책임자 서명 서명란 서명또는인 | 담당자명 확인자 지정자 작성자 관리자 감리원 검사원 점검자
quantity 0.95 | 수량 수_량 qty | 수량(개) 수량(식) 설치수량 검사수량
contractorName 0.95 | 시공사 도급사 수급인 업체명 시공업체 상호 회사명 회사명: 법인명 | 수급업체 하수급인 협력업체 전문업체
durationDays 0.95 | 기간 공기 공사기간 시공기간 작업기간 | 공사기간 계약기간 이행기간 수행기간
startDate 0.95 | 시작일 착수일 착공일 공사시작일 계약시작일 | 착공예정일 시작예정일 착수예정일
endDate 0.95 | 종료일 완료일 준공일 공사완료일 공사종료일 완공일 | 준공예정일 완료예정일 종료예정일
projectName 0.95 | 공사명 사업명 프로젝트명 공사_명 | 공사명칭 사업명칭
siteName 0.95 | 현장명 공사현장 | 현장_명 공사현장명
documentTitle 0.80 | | 신청서 신고서 확인서 보고서 계획서 점검표 평가서 검토서 결과보고서
location 0.90 | 위치 장소 구간 설치위치 점검위치 | 설치장소 공사위치 제조소 저장소 취급소 제조소[ 저장소[ 취급소[
testType 0.95 | 종별 시험종별 | 시험종류 검사종류
testItem 0.95 | 시험종목 시험항목 | 검사종목 시험목록
testMethod 0.95 | 시험방법 검사방법 | 시험_방법 검사_방법
testFrequency 0.95 | 시험빈도 검사빈도 점검빈도 | 시험_빈도
spec 0.95 | 규격 사양 사_양 재질 | 규_격 제품규격
unit 0.95 | 단위 단_위 | 측정단위
unitPrice 0.90 | 단가 단_가 | 단위가격
amount 0.90 | 금액 계약금액 | 총금액 합계금액
reportDate 0.90 | 작성일 보고일 제출일 신청일 | 보고일자 제출일자
approvalDate 0.90 | 승인일 결재일 허가일 | 승인일자
representativeName 0.80 | 대표자 대표이사 | 대표자명
inspectionFrequency 0.90 | 점검주기 검사주기 | 점검_주기
trade 0.95 | 공종 공정 | 공_종 세부공종
progressRate 0.95 | 진행률 진도율 달성률 완료율 | 진행_율 공정률
materialStatus 0.90 | 자재 자재명 재료명 자재명및규격 | 자재현황 자재상태
"""
#: What a part of a label is worth of a whole one.
PART = 0.85


class Rule(NamedTuple):
    rank: int  #: rules are tried in this order
    how: str  #: whole (in any case), exact (in this case), part (in any case) or pattern
    term: str
    label_class: str
    field: str
    confidence: float


def standard_rules() -> list[Rule]:
    """The taxonomy's rules in their order; a caller may pass another list instead."""
    rows: list[tuple] = [("pattern", BACK_PATTERN, BACK, "", 1.0)]
    rows += [("exact", x, DECORATION, "", 1.0) for x in [*MARKS.split(), ". . ."]] + [("pattern", MARK_PATTERN, DECORATION, "", 1.0)]
    rows += [("exact", x, META, "", 1.0) for x in META_WORDS.split()] + [("part", x, META, "", 0.90) for x in META_PARTS.split()]
    rows += [("exact", x, DECORATION, "aggregate", 0.95) for x in TOTALS.split()] + [("part", x, SCHEDULE, "schedule", 0.80) for x in SCHEDULES.split()]
    for line in FIELDS.strip().splitlines():
        name, whole, parts = line.split("|")
        field, sure = name.split()
        for how, words, worth in (("whole", whole, float(sure)), ("part", parts, float(sure) * PART)):
            rows += [(how, x.replace("_", " "), HIGH if worth >= 0.90 else MEDIUM, field, worth) for x in words.split()]
    rows.append(("pattern", DATE_PATTERN, SCHEDULE, "dateHeader", 0.75))
    return [Rule(i, *r) for i, r in enumerate(rows)]


def folded(text: str | None) -> str:
    """Compatibility form, white space as single blanks, none between Korean syllables."""
    plain = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "")).strip()
    return re.sub(r"(?<=[가-힣]) (?=[가-힣])", "", plain)


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]):
    """(automaton of all terms in lower case, patterns): a term leads to all rules that name it."""
    terms: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.how != "pattern":
            terms.setdefault(rule.term.lower(), []).append(rule)
    automaton = ahocorasick.Automaton()
    for term, named in terms.items():
        automaton.add_word(term, (len(term), named))
    if terms:
        automaton.make_automaton()
    return automaton if terms else None, [(rule, re.compile(rule.term, re.IGNORECASE)) for rule in rules if rule.how == "pattern"]


def first_rule(label: str, rules: tuple[Rule, ...]) -> Rule | None:
    """The first rule that a folded label meets: one pass over its letters finds all terms in it."""
    automaton, patterns = _compiled(rules)
    best = min((rule for rule, pattern in patterns if pattern.search(label)), default=None)
    low = label.lower()
    for end, (size, named) in automaton.iter(low) if automaton else ():
        whole = size == len(low) and end == size - 1
        for rule in named:
            if (best is None or rule.rank < best.rank) and (rule.how == "part" or whole and (rule.how == "whole" or rule.term == label)):
                best = rule
    return best


def classify(label: Column, rules: list[Rule] | None = None) -> Column:
    """A struct of label (folded), label_class, field, confidence, how and term: what a label is, by the first rule that it meets.

    Empty and null labels are DECORATION without a rule, labels that no rule meets UNKNOWN with confidence 0.
    """
    table = tuple(standard_rules() if rules is None else rules)

    @F.pandas_udf("label string, label_class string, field string, confidence double, how string, term string")
    def classes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for labels in batches:
            rows = []
            for text in labels:
                name = folded(text)
                rule = first_rule(name, table) if name else None
                if rule:
                    rows.append((name, rule.label_class, rule.field, round(rule.confidence, 3), rule.how, rule.term))
                else:
                    rows.append((name, UNKNOWN if name else DECORATION, "", 0.0 if name else 1.0, "none" if name else "empty", ""))
            yield pd.DataFrame(rows, columns=["label", "label_class", "field", "confidence", "how", "term"])

    return classes(label)


def classified_labels(occurrences: DataFrame, label: str, files: str, rules: list[Rule] | None = None) -> DataFrame:
    """(raw, label, label_class, field, confidence, how, term, occurrences, files): each distinct raw label classified once, with its
    occurrences and the distinct values of `files` that it occurs with. Null labels are one label."""
    counted = occurrences.groupBy(F.col(label).alias("raw")).agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct(files).alias("files"))
    return counted.withColumn("c", classify(F.col("raw"), rules)).select("raw", "c.*", "occurrences", "files")


def class_totals(classified: DataFrame) -> DataFrame:
    """(label_class, field, labels, occurrences): how many labels, and occurrences of them, each class and field has."""
    return classified.groupBy("label_class", "field").agg(F.count(F.lit(1)).alias("labels"), F.sum("occurrences").alias("occurrences"))
