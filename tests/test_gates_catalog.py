"""Gates on good, broken and hostile packages, and tables of the catalog."""

import io
import struct
import zipfile

import pytest

from formloom.sinks import catalog as C
from formloom.sources import gates as G

ORDER = ["extension", "magic", "size", "zip_integrity", "entry_count", "path_traversal", "zip_bomb_ratio", "entry_size", "mimetype_first", "xml_entities"]


def package(members, kind=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", kind) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


GOOD = [("mimetype", "application/hwp+zip"), ("Contents/section0.xml", "<p/>")]


@pytest.fixture(scope="module")
def files():
    flipped = bytearray(package([("mimetype", "application/hwp+zip"), ("a.txt", "some bytes here")]))
    flipped[flipped.index(b"some bytes")] ^= 1
    huge = bytearray(package([("mimetype", "application/hwp+zip"), ("big.bin", "x")]))
    at = huge.rindex(b"PK\x01\x02")
    struct.pack_into("<I", huge, at + 24, 600 << 20)  # the directory says 600 MB
    return {
        "good.hwpx": (package(GOOD), []), "name.zip": (package(GOOD), ["extension"]), "text.hwpx": (b"not a zip at all", ["magic", "zip_integrity"]), "empty.hwp": (b"", ["magic", "size", "zip_integrity"]),
        "cut.hwpx": (package(GOOD)[:-30], ["zip_integrity"]), "flipped.hwpx": (bytes(flipped), ["zip_integrity"]), "out.hwpx": (package([*GOOD, ("../../etc/x", "y"), ("/abs", "z")]), ["path_traversal"]),
        "bomb.hwpx": (package([*GOOD, ("zeros", b"\0" * (3 << 20))], zipfile.ZIP_DEFLATED), ["zip_bomb_ratio"]), "huge.hwpx": (bytes(huge), ["zip_bomb_ratio", "entry_size"]),
        "order.hwpx": (package(GOOD[::-1]), ["mimetype_first"]), "kind.hwpx": (package([("mimetype", "text/plain")]), ["mimetype_first"]), "none.hwpx": (package([]), ["mimetype_first"]),
        "dtd.hwpx": (package([*GOOD, ("a.xml", '<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><x>&e;</x>')]), ["xml_entities"]), "later.hwpx": (package([*GOOD, ("a.xml", "<x>" + " " * 3000 + "<!ENTITY")]), []),
        "many.hwpx": (package([*GOOD, *((f"f{i}", "") for i in range(10_001))]), ["entry_count"]),
    }


def test_gates(spark, tmp_path, files):
    (tmp_path / "sub").mkdir()
    for i, (name, (body, _)) in enumerate(files.items()):
        (tmp_path / ("sub" if i % 2 else "") / name).write_bytes(body)
    spark.dataSource.register(G.PackageGates)
    read = spark.read.format("package_gates").option("partition_bytes", 2000).load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 3
    rows = read.collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], {})[r.gate] = r.ok
    for name, (_, failed) in files.items():
        assert [g for g, ok in by[name].items() if not ok] == failed, name
        assert list(by[name]) == (ORDER[:4] if "zip_integrity" in failed else ORDER), name
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    held = {(r.path.split(":")[-1].removeprefix("//"), r.gate, r.ok, r.value) for r in G.gates_of(content).collect()}
    assert held == {tuple(r) for r in rows if not r.path.endswith("empty.hwp")}  # Spark's reader leaves out files of no bytes
    small = spark.read.format("package_gates").option("file_bytes", 10).load(str(tmp_path / "good.hwpx")[: -len("/good.hwpx")])
    assert not any(r.ok for r in small.where("gate = 'size'").collect())


def test_gates_on_an_empty_folder(spark, tmp_path):
    spark.dataSource.register(G.PackageGates)
    assert spark.read.format("package_gates").load(str(tmp_path)).count() == 0


@pytest.fixture
def db(spark, tmp_path):
    name = f"catalog_{tmp_path.name}".replace("-", "_")
    yield name, str(tmp_path / "db")
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_migrations(spark, db, monkeypatch):
    name, where = db
    assert C.migrate(spark, name, where, 4) == [1, 2, 3] and C.missing(spark, name) == []
    C.put(spark, name, "fields", spark.createDataFrame([(1, "공사명")], "form_id long, label string"))
    assert C.migrate(spark, name, where, 4) == [] and spark.table(f"{name}.fields").count() == 1  # twice changes nothing
    spark.sql(f"DROP VIEW {name}.labels_by_frequency")
    spark.sql(f"DROP TABLE {name}.forms")
    assert C.missing(spark, name) == ["forms", "labels_by_frequency"]
    monkeypatch.setitem(C.MIGRATIONS, 4, ({"extra": ("a INT", "a")}, {}))
    assert C.migrate(spark, name, where, 4) == [4] and spark.catalog.tableExists(f"{name}.extra")
    monkeypatch.setitem(C.MIGRATIONS, 1, ({}, {}))
    with pytest.raises(ValueError, match="migration 1"):
        C.migrate(spark, name, where)


def test_rules_and_views(spark, db):
    name, where = db
    C.migrate(spark, name, where, 4)
    decide = lambda rows: spark.createDataFrame(rows, "normalized_label string, semantic_type string, decision_status string")
    C.put(spark, name, "human_label_decisions", decide([("공사명", "PROJECT_NAME", "APPROVED"), ("공사명", "COMPANY_NAME", None)]))
    for bad in (("a", "NO_SUCH", "HELD"), ("a", "UNKNOWN", "MAYBE"), (None, "UNKNOWN", "HELD")):
        with pytest.raises(ValueError, match="nothing was written"):
            C.put(spark, name, "human_label_decisions", decide([("b", "UNKNOWN", "HELD"), bad]))
    with pytest.raises(ValueError, match="has no other"):
        C.put(spark, name, "fields", spark.createDataFrame([(1, 2)], "form_id long, other int"))
    assert spark.table(f"{name}.human_label_decisions").count() == 2
    classes = spark.createDataFrame([("d1", "v1", "unknown", 0.5), ("d1", "v2", "broken", 1.0), ("d2", "v1", "unknown", None)], "document_id string, classifier_version string, document_type string, confidence double")
    C.put(spark, name, "document_classifications", classes)
    with pytest.raises(ValueError, match="outside 0 to 1"):
        C.put(spark, name, "document_classifications", classes.selectExpr("document_id", "classifier_version", "document_type", "1.5D AS confidence"))
    assert [tuple(r) for r in spark.table(f"{name}.classification_disagreements").collect()] == [("d1", "v1", "v2", "unknown", "broken")]


def test_bucketed_join_needs_no_exchange(spark, db):
    name, where = db
    C.migrate(spark, name, where, 4)
    C.put(spark, name, "label_occurrences", spark.createDataFrame([(f"d{i % 9}", f"l{i % 20}") for i in range(100)], "document_id string, normalized_label string"))
    C.put(spark, name, "human_label_decisions", spark.createDataFrame([(f"l{i}", "UNKNOWN", "HELD") for i in range(20)], "normalized_label string, semantic_type string, decision_status string"))
    joined = spark.table(f"{name}.label_occurrences").join(spark.table(f"{name}.human_label_decisions").hint("merge"), "normalized_label").groupBy("normalized_label").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 20
