"""Prices of pages against a fold over each page's rows in plain Python, and golden pages."""

import random
import re
from collections import defaultdict

from formloom.operators import price_pages as P
from formloom.plans import price_queries as Q

SPAN = "page int, y double, x double, text string"


def golden():
    """One page with stages, a ditto mark, a size, a name written downwards, and prices beside any column."""
    head = [(50, 200, "서 울"), (50, 300, "부산"), (50, 400, "대구"), (50, 150, "단위"), (70, 190, "①"), (70, 215, "②"), (70, 300, "①")]
    rows = [(100, 90, "고장력"), (100, 120, "철근"), (100, 150, "M/T"), (100, 190, "710,000"), (100, 216, "720,000"), (100, 301, "730,000"), (100, 360, "999,999"), (110, 90, "외경 20"), (110, 150, "〃"), (110, 190, "1,500"), (110, 300, "400")]
    rows += [(300, 60, "콘"), (310, 60, "크"), (320, 60, "리"), (330, 60, "트"), (335, 90, "레미콘 25"), (335, 150, "㎥"), (335, 301, "85,000"), (500, 90, "(주석) 모래"), (500, 190, "12,000")]
    return [(y, x, t) for y, x, t in head + rows]


def folded(spans):
    """The same by one pass down the rows of a page."""
    rows = defaultdict(list)
    for y, x, t in spans:
        rows[round(round(y) / 5) * 5].append((x, t))
    rows = {k: sorted(v) for k, v in rows.items()}
    if sum(bool(re.match(P.PRICE, t)) and len(t) > 5 for v in rows.values() for _, t in v) < 3:
        return []
    tight = lambda t: re.sub(r"\s+", "", t)
    header = next((y for y in sorted(rows) if len({x for x, t in rows[y] if tight(t) in P.REGIONS}) >= 3), None)
    if header is None:
        return []
    regions = sorted({(x, tight(t)) for x, t in rows[header] if tight(t) in P.REGIONS})
    stages = sorted({x for y in rows for x, t in rows[y] if 0 < y - header <= 40 and t in P.STAGES})
    columns = {x: r for x, r in regions}
    if stages:
        columns, seen = {}, defaultdict(list)
        for s in stages:
            if near := [(abs(x - s), x, r) for x, r in regions if abs(x - s) < 60]:
                seen[min(near)[2]].append(s)
        for r, xs in seen.items():
            columns |= {x: r if len(xs) == 1 else r + ("②" if i else "①") for i, x in enumerate(xs)}
    if not columns:
        return []
    units = [x for y in sorted(rows) if -30 <= y - header <= 70 for x, t in rows[y] if tight(t) == "단위"]
    first = min(columns)
    bound = first - 40 if not units or not (units[0] < first and units[0] + 20 > first - 40) else units[0] + 20
    letters = [(y, x, t) for y in sorted(rows) for x, t in rows[y] if x < 82 and re.fullmatch("[가-힣]", t)]
    names = []
    for y, _, t in letters:
        if names and y - names[-1][1] <= 20:
            names[-1] = (names[-1][0], y, names[-1][2] + t)
        else:
            names.append((y, y, t))
    out, item, unit = [], None, ""
    for y in sorted(rows):
        prices = [(x, t) for x, t in rows[y] if x >= bound and re.match(P.PRICE, t) and len(t) > 4 and not (x < 160 and len(t.replace(",", "")) <= 5)]
        if y <= header + 15 or not prices:
            continue
        left = [t for x, t in rows[y] if x < bound]
        words = [t for t in left if t not in P.DITTO and not ("," in t and re.search(r"\d", t)) and not re.match(P.NUMBER, t) and re.match("[가-힣]", t) and re.search("[가-힣]{2,}", t) and not t.startswith(tuple(P.SIZES))]
        own = None
        if words:
            own = words[0]
            for t in words[1:]:
                if len(t) > 6:
                    break
                own += t
        upright = next((n for a, b, n in names if len(n) >= 2 and a - 5 <= y <= b + 75), None)
        item = upright or (own and own[:60]) or item
        for t in reversed([tight(t) for t in left]):
            if t in P.DITTO:
                break
            if t in P.UNITS:
                unit = t
                break
        for x, t in prices:
            near = sorted((abs(c - x), c) for c in columns if abs(c - x) <= 30)
            if item and near and 500 < int(t.replace(",", "")) < 5e9:
                out.append((float(y), float(x), item, unit, columns[near[0][1]], int(t.replace(",", ""))))
    return sorted(out)


def found(spark, pages):
    rows = [(p, float(y), float(x), t) for p, spans in pages.items() for y, x, t in spans]
    got = defaultdict(list)
    for r in P.region_prices(spark.createDataFrame(rows, SPAN), ["page"]).collect():
        got[r.page].append((r.row, r.x, r["item"], r.unit, r.region, r.price))
    return {p: sorted(v) for p, v in got.items()}


def test_golden_page(spark):
    got = found(spark, {1: golden()})[1]
    assert got == [
        (100.0, 190.0, "고장력철근", "M/T", "서울①", 710000), (100.0, 216.0, "고장력철근", "M/T", "서울②", 720000), (100.0, 301.0, "고장력철근", "M/T", "부산", 730000),
        (110.0, 190.0, "고장력철근", "M/T", "서울①", 1500), (335.0, 301.0, "콘크리트", "㎥", "부산", 85000), (500.0, 190.0, "콘크리트", "㎥", "서울①", 12000),
    ]
    assert got == folded(golden())


def test_random_pages(spark):
    r = random.Random(11)
    pages = {}
    for p in range(40):
        names = r.sample(P.REGIONS, r.choice([2, 3, 4]))
        spans = [(40 + r.randrange(3), 200 + 100 * i, " ".join(n)) for i, n in enumerate(names)]
        if p % 2:
            spans += [(60, 200 + 100 * i + d, "①②"[k]) for i in range(len(names)) for k, d in enumerate(r.choice([[-15], [-15, 15]]))]
        if p % 3:
            spans.append((r.choice([41, 60, 200]), r.choice([120, 150, 190]), "단 위"))
        for n in range(25):
            y = 90 + 11 * n
            spans += [(y + r.randrange(2), x, r.choice(t)) for x, t in ((50, ["철", "근", "강", "A", "12"]), (90, ["철근", "콘크리트", "외경", "(주)", "〃", "SD400", "시멘트 벽돌"]), (110, ["가공", "이형철근가공", "3,000"]), (150, ["m", "〃", "톤", "100", "M/T"])) if r.random() < 0.6]
            spans += [(y, 200 + 100 * i + r.randrange(-35, 36), f"{r.randrange(300, 2_000_000):,}") for i in range(len(names)) if r.random() < 0.6]
        pages[p] = spans
    pages[90] = pages[1][:4]
    got = found(spark, pages)
    expected = {p: v for p, spans in pages.items() if (v := folded(spans))}
    assert len(expected) > 15 and got == expected


def test_nothing(spark):
    empty = spark.createDataFrame([], SPAN)
    assert P.region_prices(empty, ["page"]).count() == 0
    assert P.region_prices(spark.createDataFrame([(1, None, 1.0, "서울"), (1, 1.0, None, "부산"), (1, 1.0, 1.0, None)], SPAN), ["page"]).count() == 0


def test_equal_keys(spark, tmp_path):
    lines = [(8, 4, 3, 0, 21215.9), (8, 4, 3, 0, 85323.69), (8, 1, 2, 1, 900.0)]
    for name, rows in (("a", lines), ("b", lines[::-1])):
        frame = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double")
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    a, b = (sorted(map(tuple, Q.spans(spark, f"{tmp_path}/{name}").collect())) for name in "ab")
    assert a == b and [r[3] for r in a if r[3] in ("85,323", "21,215")] == ["85,323", "21,215"]
