"""Components over long chains, and chat layouts beside foreign columns."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from formloom.llm import chat, near


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_chain(spark, shuffled):
    """A chain of 1,000 links and a star of 300 are classes of their own, in less than a minute."""
    ids = list(range(1001))
    if shuffled:
        random.Random(5).shuffle(ids)
    rows = [(a, b) for a, b in zip(ids, ids[1:])] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7)]
    began = time.time()
    got = {r.id: r.class_id for r in near.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert time.time() - began < 60
    assert got == {**dict.fromkeys(range(1001), 0), **dict.fromkeys(range(5000, 5300), 5000)}


def test_no_links(spark):
    assert near.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


SAY = [("user", "ask"), ("assistant", "answer")]
TABLES = {
    "messages": {"messages": [{"role": r, "content": t} for r, t in SAY]}, "share": {"conversations": [{"from": r, "value": t} for r, t in SAY]},
    "instruction": {"instruction": "ask", "input": "", "output": "answer"}, "short_instruction": {"instruction": "ask", "output": "answer"}, "prompt": {"prompt": "ask", "completion": "answer"},
    "system_prompt": {"system": "", "prompt": "ask", "completion": "answer"}, "question": {"question": "ask", "answer": "answer"}, "prompt_response": {"prompt": "ask", "response": "answer"},
}
FOREIGN = sorted({p for p in chat.KNOWN_PATHS if "[]" not in p} | {"parsed", "layout", "schema_hash", "_id", "other"})


def larger(name: str, field: str) -> bool:
    """Whether a layout with the field fits then too, and has as many paths or more."""
    paths = {*chat.LAYOUTS[name][0], field}
    return any(n != name and field in p and paths.issuperset(p) and len(p) >= len(chat.LAYOUTS[name][0]) for n, (p, _) in chat.LAYOUTS.items())


def test_foreign_columns(spark):
    """No foreign name hides a layout; a larger layout that the name completes is taken, one as large is refused."""
    for name, record in TABLES.items():
        df = spark.read.json(spark.createDataFrame([(json.dumps({"conv_id": 1, **record}),)], "value string").rdd.map(lambda r: r.value))
        for field in FOREIGN:
            wide = df if field in df.columns else df.withColumn(field, F.lit("foreign"))
            if not larger(name, field) or field in df.columns:
                assert chat.layout_of(wide) == name
        wide = df.withColumns({f: F.lit("foreign") for f in FOREIGN if f not in df.columns})
        assert [(r.role, r.text) for r in chat.canonical_turns(wide, layout=name).orderBy("turn").collect()] == SAY, name


def test_foreign_columns_of_rows(spark):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(SAY)], "conv_id long, turn long, role string, text string")
    for field in FOREIGN:
        wide = rows if field in rows.columns else rows.withColumn(field, F.lit("foreign"))
        assert chat.layout_of(wide) == "rows"
    assert [(r.role, r.text) for r in chat.canonical_turns(rows.withColumn("prompt", F.lit("foreign"))).orderBy("turn").collect()] == SAY
    two = rows.withColumn("prompt", F.lit("a")).withColumn("completion", F.lit("b")).withColumn("system", F.lit("c"))
    with pytest.raises(ValueError, match="more than one"):
        chat.layout_of(two)
    assert chat.canonical_turns(two, layout="rows").count() == 2


def test_foreign_fields_of_json(spark):
    """Records choose by containment row by row; columns beside the record don't count."""
    lines, expected = [], {}
    for name, record in TABLES.items():
        for field in [f for f in FOREIGN if f not in record]:
            expected[len(lines)] = not larger(name, field)
            lines.append((len(lines), json.dumps({**record, field: "foreign"}), "x", "y", 1))
    df = spark.createDataFrame(lines, "conv_id long, record string, parsed string, layout string, _id int")
    got = {}
    for r in chat.json_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(got[i] == [("user" if r == "human" else r, t) for r, t in SAY] for i, plain in expected.items() if plain)
    assert chat.json_turns(df.limit(0)).count() == 0
