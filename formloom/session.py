"""Session factory for local runs and tests; on a cluster the caller brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "formloom", **conf: str) -> SparkSession:
    """A local session with UTC time, adaptive execution and few shuffle partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("FORMLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application, as files added to its context."""
    context = spark.sparkContext
    if getattr(context, "_formloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="formloom-")
    archive = Path(folder) / "formloom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._formloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the session's checkpoints use too; local sessions without one get a temporary
    one, other masters are refused."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="formloom-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return f"{shared}/{uuid.uuid4().hex}"
