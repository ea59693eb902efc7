"""Tables kept by key in buckets: a merge reads and writes the buckets that its changes touch, and nothing else.

Under a table's path, data/ holds a folder for each merge, with one for each bucket that it wrote; versions/ holds, for each version,
the folder of every bucket. A version is there once its file is, so a merge that fails changes nothing, and readers of an earlier
version keep its files until they are cleaned.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators.relational import latest_wins
from formloom.sinks.tables import widened


class WriterConflict(RuntimeError):
    """Another writer made the same version first; nothing of this merge is visible, and it can be tried again."""


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a table's versions, ascending."""
    folder, fs = _files(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version consists of: buckets, keys, schema, and the folder of each bucket that has rows; {} for a new table."""
    made = versions(spark, path)
    if not made:
        return {}
    rows = spark.read.option("wholetext", True).text(f"{path}/versions/{version or made[-1]}.json").collect()  # one row
    return json.loads(rows[0].value)


def _commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Makes a version's file unless there is a claim on its number. A claim is made by the creation of a file that must not be
    there yet; the version's file gets its name when it is whole."""
    claim, fs = _files(spark, f"{path}/versions/{version}.claim")
    try:
        fs.create(claim, False).close()
    except Exception as error:
        if fs.exists(claim):
            raise WriterConflict(f"version {version} of {path} is another writer's") from error
        raise
    part, _ = _files(spark, f"{path}/versions/.{version}.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()
    if not fs.rename(part, _files(spark, f"{path}/versions/{version}.json")[0]):
        raise WriterConflict(f"version {version} of {path} can't be named")


def merge_touched(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], version: str, buckets: int = 64) -> dict:
    """Puts changes into the table at path by key: of rows with one key the largest version stays, the change among equals.

    Returns the new version's manifest, with `touched`, the buckets that were written. Only these are read and written, so the work
    follows the changes (down to one bucket); a merge without changes makes no version. buckets counts for a new table alone. Columns
    that only one side has are null on the other; buckets that aren't touched get them when they are read. Null keys are keys like any
    other. If another writer makes the version first, WriterConflict is raised and nothing changes.
    """
    held = manifest(spark, path)
    made = versions(spark, path)
    number, count = (made[-1] if made else 0) + 1, held.get("buckets", buckets)
    if held and held["keys"] != keys:
        raise ValueError(f"the table is kept by {', '.join(held['keys'])}")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")
    placed = changes.withColumn("bucket_", bucket)
    touched = sorted(r[0] for r in placed.select("bucket_").distinct().collect())  # as many rows as there are buckets, at most
    if not touched:
        return held | {"touched": []}
    old = [held["folders"][str(b)] for b in touched if str(b) in held.get("folders", {})]
    schema = changes.limit(0)
    if old:
        before = spark.read.schema(_schema(spark, held)).parquet(*(f"{path}/data/{x}" for x in old)).withColumn("bucket_", bucket)
        rows = latest_wins(widened(before, placed), widened(placed, before), keys, version)
    else:
        rows = latest_wins(placed.limit(0), placed, keys, version)
    if held:
        schema = widened(spark.createDataFrame([], _schema(spark, held)), changes.limit(0))
    name = uuid.uuid4().hex
    rows.hint("rebalance", "bucket_").write.partitionBy("bucket_").parquet(f"{path}/data/{name}")
    folders = held.get("folders", {}) | {str(b): f"{name}/bucket_={b}" for b in touched}
    content = {"buckets": count, "keys": keys, "schema": schema.schema.jsonValue(), "folders": folders}
    _commit(spark, path, number, content)
    return content | {"touched": touched}


def _schema(spark: SparkSession, held: dict):
    from pyspark.sql.types import StructType

    return StructType.fromJson(held["schema"])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, the newest unless given."""
    held = manifest(spark, path, version)
    return spark.read.schema(_schema(spark, held)).parquet(*(f"{path}/data/{x}" for x in held["folders"].values()))


def clean_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes versions but the newest `keep`, and the folders that these don't need; returns how many folders went.

    Folders that no version names are those of merges that failed or still run: they go only if they are older than the oldest
    version that stays."""
    made = versions(spark, path)
    stay = made[-keep:]
    if not stay:
        return 0
    needed = {x for v in stay for x in manifest(spark, path, v)["folders"].values()}
    mark, fs = _files(spark, f"{path}/versions/{stay[0]}.json")
    since = fs.getFileStatus(mark).getModificationTime()
    gone = 0
    for merge in fs.listStatus(_files(spark, f"{path}/data")[0]):
        if merge.getModificationTime() > since:
            continue
        name = merge.getPath().getName()
        parts = [s.getPath() for s in fs.listStatus(merge.getPath()) if s.isDirectory()]
        left = [p for p in parts if f"{name}/{p.getName()}" in needed]
        for p in [p for p in parts if p not in left]:
            fs.delete(p, True)
            gone += 1
        if not left:
            fs.delete(merge.getPath(), True)
    for v in made[:-keep]:
        for end in ("json", "claim"):
            fs.delete(_files(spark, f"{path}/versions/{v}.{end}")[0], False)
    return gone
