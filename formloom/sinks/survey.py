"""A survey in one pass: several outputs and their measures from one reading of the input.

Each row of the input gives rows to any of the outputs; all go into one long table, written in one job, partitioned by output. Measures are
observed in the same job, so they are those of the rows that were written.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Output(NamedTuple):
    """What a row gives: when it gives a row at all, and that row's columns by name."""

    when: Column
    columns: dict[str, Column]


def _typed(df: DataFrame, output: Output) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.select(*(c.alias(n) for n, c in output.columns.items())).schema}


def survey(df: DataFrame, outputs: dict[str, Output], path: str, measures: dict[str, Column] | None = None) -> dict[str, int | float | str | None]:
    """Writes all outputs under path by one job over df and returns what was observed: rows of the input (`rows`), rows of each output
    (by its name), and measures (aggregates over the input, by name).

    Columns of one name have one type in all outputs; a column that an output lacks is null in the long table, and not there when the
    output is read. A null condition gives no row. An empty input gives outputs without rows. Nothing is read twice.
    """
    kinds: dict[str, str] = {}
    for name, output in outputs.items():
        for column, kind in _typed(df, output).items():
            if kinds.setdefault(column, kind) != kind:
                raise ValueError(f"{column} is {kinds[column]} elsewhere and {kind} in {name}")
    seen, given = Observation(), Observation()
    whole = lambda name, output: F.when(output.when, F.struct(F.lit(name).alias("output_"), *((output.columns[c] if c in output.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items())))
    read = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(n) for n, m in (measures or {}).items()))
    rows = read.select(F.inline(F.array_compact(F.array(*(whole(n, o) for n, o in outputs.items())))))
    counted = rows.observe(given, *(F.count_if(F.col("output_") == n).alias(n) for n in outputs))
    counted.write.partitionBy("output_").parquet(path)
    return seen.get | given.get


def output_of(spark: SparkSession, path: str, df: DataFrame, name: str, output: Output) -> DataFrame:
    """One output of a survey of df, with its own columns; only its own files are read."""
    kinds = _typed(df, output)
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "output_ string"])
    return spark.read.schema(schema).parquet(path).where(F.col("output_") == name).select(*kinds)
