"""One pass, several outputs: what was observed is what stands in the files."""

import pytest
from pyspark.sql import functions as F

from formloom.sinks import survey as V

@pytest.fixture
def outputs(spark):
    return {
        "big": V.Output(F.col("v") > 2, {"k": F.col("k"), "twice": F.col("v") * 2}),
        "named": V.Output(F.col("name") != "", {"k": F.col("k"), "name": F.upper("name")}),
        "never": V.Output(F.lit(False), {"k": F.col("k")}),
    }


def test_survey(spark, tmp_path, outputs):
    df = spark.createDataFrame([(1, 1, "a"), (2, 3, ""), (3, 9, "c"), (4, None, None)], "k int, v int, name string").repartition(3)
    path = str(tmp_path / "out")
    found = V.survey(df, outputs, path, {"most": F.max("v"), "names": F.count("name")})
    assert found == {"rows": 4, "most": 9, "names": 3, "big": 2, "named": 2, "never": 0}
    got = {n: sorted(map(tuple, V.output_of(spark, path, df, n, o).collect())) for n, o in outputs.items()}
    assert got == {"big": [(2, 6), (3, 18)], "named": [(1, "A"), (3, "C")], "never": []}
    assert V.output_of(spark, path, df, "big", outputs["big"]).columns == ["k", "twice"]


def test_clashing_types_and_empty_input(spark, tmp_path, outputs):
    df = spark.createDataFrame([(1, 1, "a")], "k int, v int, name string")
    with pytest.raises(ValueError, match="k is int"):
        V.survey(df, {**outputs, "other": V.Output(F.lit(True), {"k": F.col("name")})}, str(tmp_path / "a"))
    found = V.survey(df.limit(0), outputs, str(tmp_path / "b"))
    assert found == {"rows": 0, "big": 0, "named": 0, "never": 0}
