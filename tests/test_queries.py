"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from formloom.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    plain = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in plain.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_html_blocks(spark):
    from formloom.sources.html import html_blocks

    pages = spark.createDataFrame([(1, "<p>a <b>b</b></p><LI>c</LI>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in html_blocks(pages).orderBy("block").collect()] == [(1, 0, "p", "a b"), (1, 1, "li", "c")]


def test_zip_members(spark, tmp_path):
    import zipfile

    from formloom.sources.packages import inventory, members, paragraphs

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Contents/section0.xml", "<p><run><t>one</t><t> two</t></run></p>")
    (tmp_path / "b.zip").write_bytes(b"broken")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = members(files)
    assert {(r.path.rsplit("/", 1)[1], r.ok) for r in got.collect()} == {("a.zip", True), ("b.zip", False)}
    assert [r.text for r in paragraphs(got).collect()] == ["one two"]
    assert inventory(spark, str(tmp_path)).count() == 2
