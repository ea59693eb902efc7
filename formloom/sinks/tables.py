"""Sinks: JSON lines, CSV, append-only logs, tables kept by key, versioned dictionaries, guarded and resumable writes.

Everything is written by Spark's own writers and committers to a path that Spark can reach; nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions.values import leaks
from formloom.operators.relational import latest_wins

MODES = {"dry_run": None, "skip_existing": "ignore", "force": "overwrite", "new": "errorifexists", "append": "append"}


def write_jsonl(df: DataFrame, path: str, mode: str = "new") -> None:
    """One JSON object a line; nulls are left out."""
    _write(df.write, mode, "json", path)


def write_csv(df: DataFrame, path: str, mode: str = "new") -> None:
    """With a header; arrays, maps and structs as JSON, so that a cell stays one value."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema]
    _write(df.select(*flat).write.option("header", True).option("escape", '"'), mode, "csv", path)


def write_table(df: DataFrame, path: str, mode: str = "new", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> None:
    """Parquet; rows are sorted within a task's file by sort_by, so that readers can skip row groups. Tasks take ranges of
    (partition_by, sort_by), so a large partition is many tasks and files."""
    if sort_by:
        df = df.repartitionByRange(*partition_by, *sort_by).sortWithinPartitions(*partition_by, *sort_by) if partition_by else df.sortWithinPartitions(*sort_by)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    _write(writer, mode, "parquet", path)


def _write(writer, mode: str, kind: str, path: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if MODES[mode]:
        writer.format(kind).mode(MODES[mode]).save(path)


def guarded(path: str, protected: tuple[str, ...]) -> str:
    """The path, unless it lies at or below a protected one."""
    clean = "/" + "/".join(x for x in path.split("://")[-1].split("/") if x not in ("", "."))
    if ".." in clean.split("/") or any(clean == p.rstrip("/") or clean.startswith(p.rstrip("/") + "/") for p in protected):
        raise ValueError(f"{path} is protected")
    return path


def append_events(df: DataFrame, path: str, *checked: str) -> None:
    """Appends to a log of JSON lines; fails, writing nothing, if a checked column holds what should have been masked."""
    if checked and df.where(leaks(*checked)).limit(1).count():
        raise ValueError("values that should have been masked: nothing was written")
    write_jsonl(df, path, "append")


def upsert_table(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """A new generation of a table kept by key under path: of rows with one key the largest version stays.

    Generations stand in folders of their own; readers take the newest whole one, so a failed write changes nothing and a
    reader that began keeps its files. Columns that only one side has are null on the other.
    """
    last = generations(spark, path)
    rows = changes
    if last:
        old = spark.read.parquet(f"{path}/generation={last[-1]}")
        rows = latest_wins(widened(old, changes), widened(changes, old), keys, version)
    else:
        rows = latest_wins(changes.limit(0), changes, keys, version)
    rows.write.parquet(f"{path}/generation={(last[-1] if last else 0) + 1}")
    return read_table(spark, path)


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole generations of a table, ascending."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("generation=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def finish_generation(spark: SparkSession, folder: str) -> None:
    """Marks a generation of several tables as whole; readers that list generations see it from then on."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/generation={generations(spark, path)[-1]}")


def widened(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with the columns that only other has, null."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name.lower() not in have))


def dictionary_version(entries: DataFrame, version: str, approved_by: str, corpus: str) -> DataFrame:
    """The rows of one dictionary version: allowed entries (label, semantic, gate) whose semantic is known, under one header."""
    good = entries.where((F.col("gate") == "ALLOWED") & F.col("semantic").isNotNull() & (F.col("semantic") != "UNKNOWN"))
    return good.select(F.lit(version).alias("version"), F.lit(approved_by).alias("approved_by"), F.lit(corpus).alias("corpus"), "label", "semantic")


def dictionary_snapshot(dictionary: DataFrame, version: str, digits: int = 2) -> DataFrame:
    """JSON documents of one dictionary version, by the first hexadecimal digits of a label's hash: (shard, entries, body). A document holds
    one label in 16 ** digits, about; a large dictionary takes more digits, so that its documents stay small."""
    rows = dictionary.where(F.col("version") == version).select("label", "semantic", F.substring(F.sha2("label", 256), 1, digits).alias("shard"))
    listed = F.array_sort(F.collect_list(F.struct("label", "semantic")))
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("entries"), F.to_json(F.struct(F.lit(version).alias("version"), listed.alias("entries"))).alias("body"))


def resumed(items: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """The items that a log of what was written doesn't have yet."""
    return items.join(written.select(key).distinct(), key, "left_anti")


def copy_in_manifest(found: DataFrame, held: DataFrame, name: Column) -> DataFrame:
    """found with `action`: copy a file whose cleaned name is not held yet, the first path of each; skip the others."""
    keyed = found.withColumn("clean", name)
    first = keyed.groupBy("clean").agg(F.min("path").alias("first_path"))
    have = held.select(name.alias("clean")).distinct().withColumn("is_held", F.lit(True))
    action = F.when(F.col("is_held"), "held").when(F.col("path") == F.col("first_path"), "copy").otherwise("duplicate")
    return keyed.join(first, "clean").join(have, "clean", "left").select(*found.columns, "clean", action.alias("action"))


def manifest_applied(base: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """base with the paths and states of a manifest where it has the key."""
    side = manifest.select(key, F.col("path").alias("new_path"), F.col("action").alias("new_action"))
    joined = base.join(side, key, "left")
    return joined.select(*(F.coalesce("new_path", c).alias(c) if c == "path" else F.col(c) for c in base.columns), F.coalesce("new_action", F.lit("kept")).alias("action"))


def log_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Nested pipeline results (run, document, items: array<struct<label, value, decision, conflicts: array<string>>>) as the
    flat tables of a review log, with keys by which they join."""
    item = results.select("run", "document", F.posexplode("items").alias("n", "item")).withColumn("item_id", F.sha2(F.concat_ws("|", "run", "document", F.col("n").cast("string")), 256))
    return {
        "runs": results.select("run", "document", F.size("items").alias("items")),
        "items": item.select("item_id", "run", "document", "n", "item.label", F.sha2("item.value", 256).alias("value_sha256")),
        "decisions": item.where("item.decision IS NOT NULL").select("item_id", "item.decision"),
        "conflicts": item.select("item_id", F.explode("item.conflicts").alias("conflict")),
    }
