"""Queries give the same rows as their SQL on small odd tables."""

import random

import duckdb
import pytest

from formloom.operators import grid as G
from formloom.plans.registry import ORACLES, QUERIES


def same(spark, folder, name, table, rows, schema):
    """The rows of the query, which are those of its SQL on the same table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).collect())
    assert got == sorted(con.execute(ORACLES[name]).fetchall())
    return got


@pytest.mark.parametrize(
    "en, fr, expected",
    [
        (["", "ab", None, ""], ["", "b", None], (2, 4, 0.5)),  # empty texts count, nulls don't
        (["ab\U0001f600\r\n\x00e\u0301"], ["", "\U0001f600\u0301\x00"], (3, 8, 0.375)),
        (["a" * 41 + "b" * 599], ["a" * 50], (41, 640, 0.064062)),  # 0.0640625: round() makes 0.064063 of it
        (["a"], [], (0, 1, 0.0)),
        ([None], ["a"], (None, None, None)),
    ],
)
def test_char_coverage(spark, tmp_path, en, fr, expected):
    rows = [("en", x) for x in en] + [("fr", x) for x in fr] + [("de", "b"), (None, "a")]
    assert same(spark, tmp_path, "char_coverage", "documents", rows, "lang string, text string") == [expected]


def vectors(seed, n, ids, side):
    """n points on a square around 0, each on a whole number of thousandths."""
    r = random.Random(seed)
    at = lambda: (r.randrange(-side, side) + 0.5) / 1000
    return [(r.randrange(ids), [at(), at(), 1.0]) for _ in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        vectors(1, 400, 10**6, 30),  # close together, many of them at one place
        vectors(2, 400, 10**6, 400),  # some alone, some with one neighbour
        vectors(3, 300, 40, 150),  # ids that repeat, at one place and at several
        vectors(4, 60, 2, 60) + [(7, [0.0005, 0.0005, 1.0])] * 3 + [(8, [0.0005, 0.0505, 1.0])] * 2,
        [(i, [0.0105, 0.0105]) for i in range(50)] + [(90, [0.0605, 0.0605]), (91, [0.0615, 0.0105]), (92, [0.2605, 0.0]), (92, [0.3005, 0.0])],
        [(1, [0.0005, 0.0005]), (None, [0.0005, 0.0005]), (2, None), (3, [None, 0.0]), (4, [0.0505, -0.0495]), (5, [0.1005, 0.0005])],
        [(1, [0.0, 0.0])],
    ],
)
def test_spatial_best_match(spark, tmp_path, rows):
    same(spark, tmp_path, "spatial_best_match", "embeddings", rows, "vec_id long, embedding array<float>")


def test_best_box_rows(spark):
    """No step makes many rows for a point, however many others its box holds: before, 2000 met 2000 others each."""
    rows = [(i, *(round(1000 * c - 0.5) for c in v[:2])) for i, (_, v) in enumerate(vectors(5, 2000, 1, 20) + vectors(6, 200, 1, 2000))]
    points = spark.createDataFrame(rows, "id long, x long, y long")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    first = store.executionsCount()
    found = {r.id: (r.cell, r.ambiguous) for r in G.best_box(points, points, "id", 50).collect()}
    bus.waitUntilEmpty()
    made, seen = 0, store.executionsList()
    for k in range(first, store.executionsCount()):
        run = seen.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for metric in (m for i in range(nodes.size()) for m in map(nodes.apply(i).metrics().apply, range(nodes.apply(i).metrics().size()))):
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                made = max(made, int(values.apply(metric.accumulatorId()).replace(",", "")))
    assert len(rows) <= made <= 20 * len(rows)
    for i, x, y in rows[::7]:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in rows if j != i and abs(x - a) <= 50 and abs(y - b) <= 50)
        assert found.get(i) == ((near[0][1], len(near) > 1) if near else None)
