"""What names of forms, labels and cells say: kinds of documents, roles and meanings of fields. Column functions throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

APPLICATION, CERTIFICATE, INTERNAL = "민원신청", "발급증서", "행정내부"
APPLY, ISSUED, NOTICE, LEDGER, AGREEMENT, PLAN, STANDARD, OTHER = "신청신고", "증명발급", "보고통지", "대장기록", "계약동의", "계획내역", "기준별표", "기타"
#: Patterns of names by which a document's type is known, tried in this order; then words inside a name; then what ends it.
NAME_ENDS = [
    (APPLY, r"(신청서|신고서|청구서|요청서|제안서|응모서|지원서|청원서|진정서|이의신청|심사청구|재심청구|접수증|응시원서|원서|청약서|요구서|신청|신고(?!증)|청구)\s*$"),
    (ISSUED, r"(증명서|확인서|허가증|등록증|자격증|수료증|면허증|인증서|지정서|인정서|합격증|증서|증표|확인원|증명원|필증|검사증|신고증|승인서|승인증|신분증|증명|허가서)\s*$"),
    (NOTICE, r"(보고서|통지서|통보서|결정서|의견서|회신|명세서|고지서|안내문|통지|통보|보고|처분서|명령서|촉구서|독촉장)\s*$"),
    (LEDGER, r"(대장|명부|일지|조서|기록부|접수부|관리부|출납부|원부|목록|카드|의결서|회의록|점검표|현황표|명단|등록부|일람표|대장부)\s*$"),
    (AGREEMENT, r"(계약서|동의서|위임장|서약서|각서|협약서|확약서|진술서|합의서|약정서|승낙서|답변서|의뢰서|협의서)\s*$"),
    (PLAN, r"(계획서|내역서|정산서|집계표|총계표|결산서|산출서|명세|현황|실적서|조사서|평가서|검사서|성적서|결과서|요약서|명세표|계획|실적|집계)\s*$"),
    (STANDARD, r"(별표|기준|요령|지침|표준)\s*$"),
]
NAME_WORDS = [(APPLY, "신청|신고|청구"), (LEDGER, "대장|명부|일지|조서|출납부|기록부|접수부|관리부|원부"), (ISSUED, "증명|허가|등록증|인증"), (NOTICE, "통지|통보|보고|결정")]
NAME_LAST = [
    (NOTICE, r"(송부|첨부|이첩)\s*$"), (ISSUED, r"증\s*$"), (LEDGER, r"[부록]\s*$"), (PLAN, r"표\s*$"), (APPLY, r"원\s*$"),
    (PLAN, r"(계산서|명세서|정산서|평정서|검토서|기록서|산출서|집계서|내역서|일람서)$"), (NOTICE, r"(회신서|통고서|반환서|이송서|송부서|고지서|경고서)$"), (APPLY, r"서$"),
    (ISSUED, r"(임명장|임용장|표창장|수료장|위촉장|상장|감사장)$"), (AGREEMENT, r"(위임장|각서장|보증장|서약장)$"), (APPLY, r"(고발장|진정장|청원장|탄원장|소장)$"), (NOTICE, r"(독촉장|최고장|경고장|통지장)$"),
]
DELETED, ANNEX = r"삭제\s*$|삭제\s*[.\-·]|삭제\s*\d|으로\s*이동", "별표"
#: The kind of form by its type; what only forms have that are handed in; evidence against a name.
KINDS = {APPLY: APPLICATION, AGREEMENT: APPLICATION, PLAN: APPLICATION, ISSUED: CERTIFICATE, LEDGER: INTERNAL, NOTICE: INTERNAL, STANDARD: INTERNAL}
MARKERS = r"접수\s*번호|처리\s*절차|처리\s*기간|담당\s*공무원\s*확인|귀하|귀중|신청합니다|신고합니다|청구합니다|제출합니다|(첨부|구비|제출)\s*서류|수수료"
STRONG, SEAL, ADDRESSED, REPORTED = ("접수번호", "담당공무원확인"), r"직\s*인|印", r"귀\s*하|귀\s*중", "보고"
#: Fields that an office fills in, and labels that are no fields.
OFFICE = r"^(접수\s*(번호|일자?|자)|처리\s*(일자?|기간|기관)|담당\s*공무원|담당공무원확인사항|결재|협조자|시행일|발급\s*(번호|일자?)|허가\s*번호|등록\s*번호\s*$|정리\s*번호|관리\s*번호|문서\s*번호|수신자?|처리\s*결과|검토자|확인자?)\s*$"
MARK = r"^(\(\s*(뒤|앞)\s*쪽\s*\)|\(\s*제?\s*\d+\s*쪽\s*\)|[▼▶◀▲△▽◁▷→←↓↑]+|[-–—ㆍ·]+|[（()）\[\]]+|계|합계|소계|총계|\d+|[（(]\s*[）)]|)$"
END_MARK, NUMBERED = r"끝\s*\.\s*발신명의|발신명의\s*직인|^붙임\b.*끝\s*\.", r"^\s*[\[(（]?\s*별지\s*제?\s*\d|^\s*[\[(（]\s*별지"
SECTION = r"^(첨부|구비|제출)\s*서류|^수수료|^처리\s*절차|^유의\s*사항|^작성\s*(방법|요령)|^준수\s*사항|^안내\s*사항|^기재\s*(방법|요령)|^행정정보\s*공동이용|^본인정보"
ADDRESSEE = r"(장관|처장|청장|위원장|위원회|시장|군수|구청장|원장|사장|이사장|서장|교육감|도지사|관리청|지청장|공단|공사|[)）]\s*장)\s*(귀하|귀중)?\s*$|(귀하|귀중)\s*$"
STEP = r"^(신청서\s*작성|신고서\s*작성|청구서\s*작성|서류\s*작성|신청서\s*제출|신고서\s*제출|업무\s*처리\s*절차|결과\s*통보|서류\s*검토)$"
PROCEDURE, BARE = r"^처리\s*절차", r"^(\d{1,3}|계|합계|소계|총계|[가-힣]|[A-Za-z])$"
THIRD_PARTY = r"법정\s*대리인|대리인|임대|임차|피신청|피청구|피고|상대방|거래처|수급인|도급인|발주자|양도인|양수인|배우자|보호자|채무자|채권자|공급자|수급자|상속인|피상속인|대상자|위임자|수임자|보증인|동거인|세대주(?!\s*본인)|가입자(?!\s*본인)"
#: What a field means, and the kind of input that it takes, tried in this order.
MEANINGS = [
    ("residentNo", "secret", r"주민\s*등록\s*번호|주민번호"), ("bizNo", "text", r"사업자\s*등록\s*번호|법인\s*등록\s*번호"), ("phone", "tel", "전화|연락처|휴대폰|팩스"), ("address", "address", r"주소|소재지|주소지|사업장\s*소재"),
    ("name", "text", r"^성명|성\s*명|이름|신청인|신고인|청구인|제출인|대표자|성명\s*\("), ("buildingName", "text", r"아파트\s*명|건물\s*명|공동주택\s*명|단지\s*명|시설\s*명|점포\s*명"), ("orgName", "text", "상호|법인명|기관명|업체명|^명칭|단체명"),
    ("email", "email", "(?i)이메일|전자우편|E-?mail"), ("birth", "date", "생년월일|생일"), ("date", "date", r"년\s*월\s*일|일자$|일시$|^기간|^.{0,6}일$"), ("amount", "number", r"금액|요금|비용|단가|원\)$|수량|사용량|면적"),
    ("account", "text", r"계좌|금융\s*기관|은행"), ("consent", "checkbox", "동의(하십니까|함|여부)|□"), ("gender", "select", r"^성\s*별|남\s*/?\s*여"), ("jobTitle", "text", r"직\s*(위|급|책)|계\s*급"), ("affiliation", "text", r"^소\s*속|부\s*서|근무\s*처|소속및직위"),
    ("occupation", "text", r"^직\s*업|^업\s*종|업\s*태|종\s*목"), ("agent", "text", r"대\s*리\s*인|담\s*당\s*자|대\s*표\s*자"), ("zipcode", "text", r"우편\s*번호"),
]


def says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?U){pattern}")


def first_that(text: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The name of the first rule (name, pattern) that the text meets."""
    return reduce(lambda tail, rule: F.when(says(text, rule[1]), rule[0]).otherwise(tail), reversed(rules), F.lit(None).cast("string") if default is None else default)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def form_name(name: Column) -> Column:
    """A file's name without its ending, numbers and hashes in front, brackets, and the number of its form; the name itself if
    nothing is left."""
    n = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.hwpx?$", ""), r"(?i)\.repaired$", "")
    n = normal(F.regexp_replace(F.regexp_replace(n, r"^\d+[_\s]*", ""), r"[_\[\]()<>{}]+", " "))
    n = F.trim(F.regexp_replace(n, r"(?i)^[0-9a-f]{8,}\s*(?:\d{1,5}\s+)*", ""))
    n = F.trim(F.regexp_replace(n, r"^별지\s*제\s*\d+호(?:의\s*\d+)?\s*서식\s*", ""))
    return F.when(n != "", n).otherwise(normal(name))


def document_type(name: Column, fields: Column) -> Column:
    """A struct of doc_type, reason and fillable by a form's clean name and its number of fields; an empty name is OTHER."""
    known, word, last = first_that(name, NAME_ENDS), first_that(name, NAME_WORDS), first_that(name, NAME_LAST)
    reason = F.when(says(name, DELETED), "DELETED_STUB").when(says(name, ANNEX), "ANNEX_TABLE").when(known.isNotNull(), "NAME_SUFFIX").when(word.isNotNull(), "NAME_KEYWORD").when(last.isNotNull(), "NAME_MORPHEME").otherwise("UNMATCHED")
    kind = F.when(says(name, DELETED), OTHER).when(says(name, ANNEX), STANDARD).otherwise(F.coalesce(known, word, last, F.lit(OTHER)))
    fillable = ~reason.isin("DELETED_STUB", "ANNEX_TABLE") & (F.coalesce(fields, F.lit(0)) > 0) & (kind != STANDARD)
    return F.struct(kind.alias("doc_type"), reason.alias("reason"), fillable.alias("fillable"))


def meaning(label: Column) -> Column:
    """A struct of semantic and input: what a label means, and the input that it takes; empty and text if nothing is known."""
    hit = reduce(lambda tail, i: F.when(says(label, MEANINGS[i][2]), i).otherwise(tail), range(len(MEANINGS) - 1, -1, -1), F.lit(len(MEANINGS)))
    of = lambda k, default: F.element_at(F.array(*(F.lit(m[k]) for m in MEANINGS), F.lit(default)), hit + 1)
    return F.struct(of(0, "").alias("semantic"), of(1, "text").alias("input"))
