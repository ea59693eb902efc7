"""Value, date, cell, record and fill operators on small golden cases, and on null, empty and clashing rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from formloom.functions import dates as D
from formloom.functions import values as V
from formloom.operators import cells as C
from formloom.operators import fill as L
from formloom.operators import records as R
from formloom.operators import relational
from formloom.sinks import tables as K
from formloom.sources import html, packages
from formloom.sources.cells import schedule_items, table_cells
from formloom.streaming import events as S


def said(spark, function, values):
    rows = spark.createDataFrame([*enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_value_forms(spark):
    assert said(spark, V.phone, ["01012345678", "02-123-4567", "+82 10 1234 5678", "031 123 4567", "12", None, ""]) == ["010-1234-5678", "02-123-4567", "010-1234-5678", "031-123-4567", None, None, None]
    assert said(spark, V.business_number, ["1234567890", "123-45-67890", "12345", None]) == ["123-45-67890", "123-45-67890", None, None]
    assert said(spark, V.yes_no, ["예", " YES ", "아니오", "없음", "?", None]) == ["Y", "Y", "N", "N", None, None]
    assert said(spark, V.amount, ["1억 2천만원", "1,234,567원", "3만5천", "1.5억", "300", "무료", "", None]) == [120_000_000, 1_234_567, 35_000, 150_000_000, 300, None, None, None]
    assert said(spark, V.day, ["2024-1-5", "2024.01.05", "2024년 1월 5일", "20240105", "2024/13/40", "24.1.5", None]) == ["2024-01-05"] * 4 + [None] * 3
    assert said(spark, V.price, ["1,200", "0", "x", None]) == [1200.0, None, None, None]
    assert [tuple(x) for x in said(spark, lambda c: V.normalised(F.lit("DATE"), c), ["2024.1.5", "later", " ", None])] == [("2024-01-05", "NORMALISED"), ("later", "UNPARSED"), ("", "EMPTY"), (None, "EMPTY")]


def test_labels(spark):
    assert said(spark, V.stem_label, [" 접수 번호 ", "불합격량 1/20", "20", "1234"]) == ["접수번호", "불합격량", "20", "1234"]
    assert said(spark, V.bare_label, ["1. 성명 (한글) :", "※ 주소:", "[구분] 이름"]) == ["성명", "주소", "이름"]
    assert said(spark, V.is_label, ["성명", "", "12", "2024-01-01", "이것은 긴 문장입니다.", "-"]) == [True, False, False, False, False, False]
    assert said(spark, V.is_blank, ["", None, "-", "____", "( )", "값"]) == [True, True, True, True, True, False]
    assert said(spark, V.items_of, ["1. 지정서 2. 현황표", "- 하나\n- 둘째", "plain text", None, ""]) == [["지정서", "현황표"], ["하나", "둘째"], ["plain text"], [], []]
    assert said(spark, lambda c: V.after_label(c, "처리기간"), ["처리기간: 7일", "처리기간 7일", "수수료 없음"]) == ["7일", "7일", None]
    assert [x and tuple(x) for x in said(spark, V.label_and_value, ["이름: 홍길동: 본인", "no colon", ": x"])] == [("이름", "홍길동: 본인"), None, None]
    assert said(spark, lambda c: V.keyword_lines(c, ["서류"], ["증"]), ["첨부서류 목록\n주민등록증\n기타 사항\n첨부서류 목록"]) == [["첨부서류 목록", "주민등록증"]]


def test_mojibake(spark):
    wrong = lambda x: x.encode().decode("latin-1")
    assert said(spark, V.repaired, [wrong("신청서"), wrong(wrong("신청서")), "신청서", "plain", "café", None]) == ["신청서", "신청서", "신청서", "plain", "café", None]


def test_axis(spark):
    assert said(spark, D.axis_mark, ["5월", "제2주", "3주차", "15일", "2024-05-01", "기간", "13월", None]) == ["month:5", "week:2", "week:3", "day:15", "date:2024-05-01", None, None, None]
    one = spark.createDataFrame([(["month:5", "month:6", "week:1"],), ([],)], "m array<string>")
    assert [r.u for r in one.select(D.axis_unit(F.col("m")).alias("u")).collect()] == ["month", None]
    assert said(spark, lambda c: D.on_axis(c, F.lit("month")), ["2024-05-07", "6월", "?"]) == ["month:5", "month:6", None]
    assert said(spark, D.month_of, ["2024-05-07", "12월", "x"]) == [5, 12, None] and said(spark, D.day_of, ["2024-05-07", "9일", "x"]) == [7, 9, None]


def grid(spark, rows):
    return spark.createDataFrame([("f", r, c, text) for r, line in enumerate(rows) for c, text in enumerate(line)], "tbl string, row int, col int, text string")


def test_schedule(spark):
    """A schedule of two tasks over three months, a progress column at its end."""
    cells = grid(spark, [["공종", "기간", "5월", "6월", "7월", "진척률"], ["토공", "2개월", "■■", "■", "", "50%"], ["골조", "1개월", "", "", "■", ""], ["", "", "", "", "", ""]])
    axes = C.time_axes(cells, ["tbl"])
    assert tuple(axes.first()) == ("f", 0, "month", 2, 4, 3)
    assert sorted(map(tuple, C.bars(cells, axes, ["tbl"], F.col("text").contains("■")).collect())) == [("f", 1, 2, 3, 2), ("f", 2, 4, 4, 1)]
    assert sorted(map(tuple, C.task_rows(cells, axes, ["tbl"]).collect())) == [("f", 1, "토공"), ("f", 2, "골조")]
    assert tuple(C.progress_columns(cells, ["tbl"]).first()) == ("f", 0, 5)
    assert {(r.row, r.kind) for r in C.bar_kinds(cells, axes, ["tbl"]).collect()} == {(1, "symbol"), (2, "symbol"), (3, "empty")}
    assert C.layouts(C.table_features(cells, ["tbl"])).first().layout == "schedule"
    assert C.header_rows(cells, ["tbl"]).first().row == 0


def test_slots(spark):
    """Blank cells beside and below labels, under known headers; a stamp makes a table unsafe; each cell counts once."""
    cells = grid(spark, [["성명", "", "주소", ""], ["품목", "수량", "비고", ""], ["", "", "", ""]])
    got = {(r.row, r.col): (r.label, r.kind, r.review) for r in C.all_slots(cells, ["tbl"], ["품목"], ["완료"]).collect()}
    assert got[0, 1] == ("성명", "label_right", False) and got[2, 0] == ("품목", "label_below", False) and got[1, 3] == ("비고", "label_right", False)
    stamped = cells.union(spark.createDataFrame([("f", 3, 0, "신청인 (서명)")], cells.schema))
    assert all(r.review and r.reason == "stamp" for r in C.all_slots(stamped, ["tbl"], [], []).collect())
    assert C.all_slots(cells.where("1 = 0"), ["tbl"], [], []).count() == 0
    assert C.values_of(grid(spark, [["처리기간", "", "7일"]]), ["tbl"], "처리기간").first().value == "7일"


def test_records(spark):
    row = spark.createDataFrame([('noise [{"key":"a","verdict":"ok"},{"key":"a","verdict":"no"},{"key":"b","verdict":"?"}] end',), ("none",), (None,)], "raw string")
    assert [r.v for r in row.select(R.verdicts(F.col("raw"), ["ok", "no"]).alias("v")).collect()] == [{"a": "ok"}, None, None]
    fields = spark.createDataFrame([([("접수번호", "office", False), ("성명", "applicant", False), ("주민등록번호", "applicant", True), ("청구인", "noise", False)],)], "f array<struct<label:string,role:string,sensitive:boolean>>")
    schema = fields.select(R.input_schema(F.col("f")).alias("s")).first().s
    assert (schema.inputs, schema.applicant, schema.office, schema.sensitive) == (3, 2, 1, 1)
    maps = spark.createDataFrame([({"b": "1", "a": "2", "at": "now"},)], "m map<string,string>")
    assert maps.select(R.stable(F.col("m"), ["at"]).alias("j")).first().j == '{"a":"2","b":"1"}'
    asked = spark.createDataFrame([(1, "7 일"), (2, "9일"), (3, ""), (4, "x")], "k int, value string")
    source = spark.createDataFrame([(1, "처리기간은 7일 이내"), (2, "없음"), (3, "y")], "k int, text string")
    assert {r.k: r.reason for r in R.sourced(asked, source, ["k"], "value", "text").collect()} == {1: "", 2: "not_in_source", 3: "empty", 4: "no_source"}
    sets = spark.createDataFrame([("g", "a", ["x", "y"]), ("g", "b", ["y", "z"]), ("h", "c", ["q"])], "g string, k string, t array<string>")
    assert {r.g: r.alike for r in R.most_alike(sets, ["g"], "k", "t").collect()} == {"g": 0.333333, "h": 0.0}


def test_fill(spark):
    plan = spark.createDataFrame([("name", "auto", "Kim"), ("phone", "question", None), ("seal", "skip", None), ("mail", "question", None)], "field string, action string, value string")
    answers = spark.createDataFrame([("phone", "010"), ("phone", " "), ("seal", "x")], "field string, answer string")
    assert {tuple(r) for r in L.fill_commands(plan, answers).collect()} == {("name", "Kim", "profile"), ("phone", "010", "answer")}
    decisions = spark.createDataFrame([("a", "APPROVED", "me"), ("b", "maybe", ""), ("c", "HELD", "me"), ("c", "HELD", "me")], "item string, decision string, decided_by string")
    batch = spark.createDataFrame([("a",), ("c",)], "item string")
    got = {r.item: r.errors for r in L.decision_errors(decisions, batch).collect()}
    assert got == {"a": [], "b": ["unknown_item", "unknown_decision", "nobody_named"], "c": ["decided_twice"]}
    approved = spark.createDataFrame([("공사명", "PROJECT_NAME", "APPROVED"), ("공사명", "COMPANY_NAME", "APPROVED"), ("주소", "ADDRESS", "APPROVED")], "label string, semantic string, decision string")
    assert [tuple(r) for r in L.semantic_conflicts(approved).collect()] == [("공사명", ["COMPANY_NAME", "PROJECT_NAME"])]


def test_clashing_names(spark):
    """Columns that are named as the operators' own come through as they were."""
    base = spark.createDataFrame([(1, 1, "a", "b", "c"), (2, 1, "a", "b", "c")], "k int, version int, is_new string, nth string, run string")
    got = relational.latest_wins(base, base.where("k = 1").withColumn("version", F.lit(2)), ["k"], "version").collect()
    assert {(r.k, r.version, r.is_new, r.nth) for r in got} == {(1, 2, "a", "b"), (2, 1, "a", "b")}
    many = spark.createDataFrame([(None if i % 3 == 0 else "g", i, "x") for i in range(50)], "g string, i int, bucket string")
    places = relational.numbered(many, ["g"], [F.col("i")], F.floor(F.col("i") / 7), "place").collect()
    for group in (None, "g"):
        assert [r.place for r in sorted((r for r in places if r.g == group), key=lambda r: r.i)] == [*range(1, sum(r.g == group for r in places) + 1)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, None)], "k int, version int, v string")
    path = str(tmp_path / "table")
    assert K.generations(spark, path) == []
    K.upsert_table(spark, path, rows, ["k"], "version")
    got = K.upsert_table(spark, path, rows.where("k = 2").withColumn("version", F.lit(2)).withColumn("more", F.lit("m")), ["k"], "version")
    assert {tuple(r) for r in got.collect()} == {(1, 1, "a", None), (2, 2, None, "m")} and K.generations(spark, path) == [1, 2]
    with pytest.raises(ValueError, match="masked"):
        K.append_events(spark.createDataFrame([("call 010-1234-5678",)], "note string"), str(tmp_path / "log"), "note")
    assert not (tmp_path / "log").exists()
    for bad in ("/data/keep/x", "/data/keep", "file:///data/./keep/y", "/data/../data/keep"):
        with pytest.raises(ValueError, match="protected"):
            K.guarded(bad, ("/data/keep",))
    assert K.guarded("/data/keeper", ("/data/keep",)) == "/data/keeper"
    with pytest.raises(ValueError, match="mode"):
        K.write_jsonl(rows, str(tmp_path / "x"), "merge")
    K.write_jsonl(rows, str(tmp_path / "x"), "dry_run")
    assert not (tmp_path / "x").exists()
    nested = spark.createDataFrame([("r", "d", [("l", "v", None, ["c1", "c2"]), ("m", "w", "APPROVED", [])])], "run string, document string, items array<struct<label:string,value:string,decision:string,conflicts:array<string>>>")
    assert {k: v.count() for k, v in K.log_tables(nested).items()} == {"runs": 1, "items": 2, "decisions": 1, "conflicts": 2}


def test_packages(spark, tmp_path):
    section = '<s xmlns:hp="u"><hp:p><hp:run><hp:t>A</hp:t><hp:tbl><hp:tr><hp:tc><hp:cellAddr rowAddr="0" colAddr="0"/><hp:cellSpan colSpan="2" rowSpan="1"/><hp:subList><hp:p><hp:t>성명</hp:t></hp:p></hp:subList></hp:tc><hp:tc><hp:subList><hp:p><hp:t>x</hp:t></hp:p><hp:p><hp:t>y</hp:t></hp:p></hp:subList></hp:tc></hp:tr></hp:tbl></hp:run></hp:p></s>'
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("Contents/section0.xml", section)
        z.writestr("Contents/section1.xml", "<broken")
        z.writestr("mimetype", "x")
    (tmp_path / "a.zip").write_bytes(body.getvalue())
    (tmp_path / "b.zip").write_bytes(body.getvalue())
    (tmp_path / "c.zip").write_bytes(b"no zip")
    (tmp_path / "d.zip").write_bytes(b"")
    got = {r.path[-5:]: (r.copies, r.first_copy) for r in packages.inventory(spark, str(tmp_path), "*.zip").collect()}
    assert got == {"a.zip": (2, True), "b.zip": (2, False), "c.zip": (1, True)}
    parts = packages.members(spark.read.format("binaryFile").load(str(tmp_path)))
    assert parts.where("NOT ok").count() == 1
    cells = {(r.path[-5:], r.ok, r.tbl, r.row, r.col, r.col_span, r.text) for r in table_cells(parts).collect()}
    assert cells == {(f"{n}.zip", *rest) for n in "ab" for rest in ((True, 0, 0, 0, 2, "성명"), (True, 0, 0, 1, 1, "x\ny"), (False, None, None, None, None, None))}


def test_html(spark):
    page = "<title>T &amp; U</title><!-- <p>no</p> --><script>'<p>no</p>'</script><ul><li>one<li>two <b>bold</b></li></ul><p>three<p>four &lt;5</p>"
    got = html.html_blocks(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r.tag, r.text) for r in sorted(got, key=lambda r: r.block)] == [("title", "T & U"), ("li", "one"), ("li", "two bold"), ("p", "three"), ("p", "four <5")]


def test_schedule_items(spark, tmp_path):
    (tmp_path / "s.csv").write_text("task,start,end\n dig ,2024-05-01,2024-05-09\nbuild,soon,\n")
    got = [(r.task, str(r.start), r.end and str(r.end)) for r in schedule_items(spark, str(tmp_path / "s.csv"), "csv").collect()]
    assert got == [("dig", "2024-05-01", "2024-05-09"), ("build", "None", None)]


def test_stream_of_several_files(spark, tmp_path):
    """A replay over many batches gives what one batch gives; a table kept by key holds each key once."""
    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:00", i % 4, "purchase" if i % 2 else "view") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    once = {tuple(r) for r in S.metered(df).collect()}
    assert {tuple(r) for r in S.replayed(spark, str(tmp_path / "in"), "*.parquet", S.metered).collect()} == once
    assert S.kept_by_key(spark, str(tmp_path / "in"), "*.parquet", ["user_id"], "event_id").count() == 4


def test_fixed_values(spark):
    """Words, marks and headers that count as yes and no, as blank, as progress, and as signs of a table without input."""
    assert said(spark, V.yes_no, ["V", "✓", "o", "X", "네", "유", "무", "동의"]) == ["Y", "Y", "Y", "N", None, None, None, None]
    blank = ["제 호", "년 월 일", "( 입력 필요 )", "000-00", "00", "[ㆍ]", "㎡", "...", "0", "호실", "□", "제1호"]
    assert said(spark, V.is_blank, blank) == [True] * 8 + [False] * 4
    cells = grid(spark, [["공종", "완료율", "진도"]])
    assert C.progress_columns(cells, ["tbl"]).first().col == 1
    reasons = {"결재란": "stamp", "1 페이지": "page_mark", "3쪽": "page_mark", "쪽이 길어서 표시가 아닌 글": None, "작성요령": "legal", "별지 제3호": "legal", "시행규칙": None}
    rows = spark.createDataFrame([(text, 0, 0, text) for text in reasons], cells.schema)
    assert {r.tbl: r.reason for r in C.unsafe_tables(rows, ["tbl"]).collect()} == {k: v for k, v in reasons.items() if v}
