"""The kept index against a direct search, and boxes against all pairs and the golden cases."""

import random
import re
from collections import Counter

import pytest

from formloom.operators import boxes as B
from formloom.operators import search_index as X

KEYS = ["name", "domain", "kind", "number"]
FORMS = [("소방시설 완공검사 신청서", "소방시설", "신청서", "1"), ("소방시설 착공 신고서", "소방시설", "신고서", "2"), ("고압가스 제조 신고서", "가스·위험물", "신고서", "3"), ("기계설비 사용전 검사 확인증", "기계설비", "확인증", "4"), ("도로 연결 허가신청서", "도로", "신청서", None)]


def direct(records, text, most=10):
    parts = lambda x: [p for p in re.split(r"[\s_\-·/]+", x.strip()) if len(p) >= 2]
    count = Counter(tuple(v or "" for v in r) for r in records)
    tokens, out = parts(text), []
    for key, files in count.items():
        own, score, matched = set(parts(" ".join(key[:3]))), 0.0, []
        for tok in tokens:
            inside = [x for x in own if tok in x and x != tok]
            score += (tok in own) + 0.4 * len(inside)
            matched += [tok] if tok in own else [f"~{tok}"] * len(inside)
        if score:
            out.append((round(score / len(tokens), 3), key, files, matched))
    return sorted(out, key=lambda x: -x[0])[:most]


def test_kept_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SEGMENT", 2)
    path = str(tmp_path / "index")
    batches = [FORMS[:3] + FORMS[:1], FORMS[2:] + FORMS[:1], FORMS[:0]]
    files = {}
    for n, batch in enumerate(batches, 1):
        assert X.extend_index(spark, path, spark.createDataFrame(batch, ", ".join(f"{k} string" for k in KEYS)), KEYS, KEYS[:3]) == n
        now = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
        assert files.items() <= now.items()  # nothing that stands there is written again
        files = now
    records = [r for b in batches for r in b]
    totals = X.index_totals(spark, path).first()
    assert (totals.entries, totals.records) == (5, len(records))
    asked = ["소방 완공검사 신청서", "가스 신고서", "기계설비 검사 확인증", "신청서", "", "x", None, "신청서 신청서 없음", "도로/허가"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = {}
    for r in X.search_index(spark, path, queries, KEYS).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, (r.name, r.domain, r.kind, r.number), r.files, list(r.matched)))
    for i, text in enumerate(asked):
        assert sorted(got.get(i, [])) == sorted(direct(records, text or "")), text
    assert [got[i][0][1][1] for i in range(3)] == ["소방시설", "가스·위험물", "기계설비"]
    assert all(len(v) == 1 for v in [X.search_index(spark, path, queries.where("query_id = 3"), KEYS, 1).collect()])
    X.compact_index(spark, path, str(tmp_path / "compact"), KEYS)
    again = X.search_index(spark, str(tmp_path / "compact"), queries, KEYS)
    assert sorted(map(str, again.collect())) == sorted(map(str, X.search_index(spark, path, queries, KEYS).collect()))


BOX = "doc int, id int, x double, y double, w double, h double"


@pytest.mark.parametrize("least", [1.0, 0.25, 40.0])
def test_touching(spark, least):
    """All pairs once, points and boxes of very different sizes among them, negative places too."""
    r = random.Random(4)
    shape = lambda i: (i % 2, i, r.randrange(-60, 60), r.randrange(-60, 60), r.choice([0, 1, 3, 10, 500]), r.choice([0, 2, 7, 90]))
    a, b = [[(d, i, *map(float, rest)) for d, i, *rest in (shape(i) for i in range(60))] for _ in range(2)]
    a.append((0, 99, None, 1.0, 1.0, 1.0))
    expected = {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] is not None and x[2] <= y[2] + y[4] and y[2] <= x[2] + x[4] and x[3] <= y[3] + y[5] and y[3] <= x[3] + x[5]}
    got = [(r.doc, r.a.id, r.b.id) for r in B.touching(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ["doc"], least).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_nearest(spark):
    r = random.Random(7)
    a, b = [[(i % 3, i, float(r.randrange(0, 2000)), float(r.randrange(0, 50)), float(i % 5), 2.0) for i in range(40)] for _ in range(2)]
    b = [x for x in b if x[0] < 2]
    far = lambda x, y: ((x[2] + x[4] / 2 - y[2] - y[4] / 2) ** 2 + (x[3] + x[5] / 2 - y[3] - y[5] / 2) ** 2) ** 0.5
    expected = {(x[0], x[1]): min((far(x, y), y[1]) for y in b if y[0] == x[0])[1] for x in a if x[0] < 2}
    got = B.nearest_centres(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ["doc"]).collect()
    assert {(r.doc, r.a.id): r.b.id for r in got} == expected and len(got) == len(expected)


def test_golden_cases(spark):
    """Centre inside a cell, overlap of two, the nearest, a centre on the edge of two, a cell over several, and no places."""
    cells = [(1, 0, 0, 0, 200, 100), (2, 0, 0, 0, 100, 50), (2, 1, 200, 0, 100, 50), (3, 0, 0, 0, 50, 50), (4, 0, 0, 0, 100, 50), (4, 1, 100, 0, 100, 50), (5, 0, None, None, None, None)]
    objects = [(1, 600, 110, 60, 20, 20), (2, 700, 80, 0, 140, 50), (3, 800, 200, 200, 20, 20), (4, 900, 50, 0, 100, 50), (5, 901, 1, 1, 1, 1), (6, 902, 1, 1, 1, 1), (1, 903, None, 1, 1, 1)]
    frame = lambda rows: spark.createDataFrame([(d, i, *(None if v is None else float(v) for v in rest)) for d, i, *rest in rows], BOX)
    got = {}
    for r in B.cell_candidates(frame(objects), frame(cells), ["doc"]).collect():
        got.setdefault(r.object_id, []).append((r.reason, r.cell_id, r.overlap, r.confidence, r.ambiguous))
    assert got[600] == [("CENTER_INSIDE_CELL", 0, 1.0, 0.8, False)]
    assert sorted(got[700]) == [("BBOX_OVERLAP", 0, 0.1429, 0.371, True), ("BBOX_OVERLAP", 1, 0.1429, 0.371, True)]
    assert [x[:3] for x in got[800]] == [("NEAREST_CELL", 0, 0.0)] and got[800][0][3] <= 0.6
    assert [x[0] for x in got[900]] == ["CENTER_INSIDE_CELL"] * 2 and all(x[4] for x in got[900])
    assert [got[i][0][0] for i in (901, 902, 903)] == ["NO_CELL_GEOMETRY", "NO_CELL_GEOMETRY", "NO_GEOMETRY"]
    assert B.cell_candidates(frame(objects[:0]), frame(cells), ["doc"]).count() == 0
