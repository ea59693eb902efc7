"""The corpus pipeline: quality, exact and near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from formloom.llm.bpe import stage_byte_bpe
from formloom.llm.common import ensure_checkpoint_dir, table
from formloom.llm.exact import stage_exact_dedup
from formloom.llm.mixing import stage_mixing
from formloom.llm.near import stage_near_dedup
from formloom.llm.quality import stage_quality

STAGES = [
    ("quality", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("byte_bpe", stage_byte_bpe),
]
#: Neither the language model nor the signatures can be written in SQL; tests/llm/test_pipeline.py holds the exact and near
#: stages against brute force, tests/llm/test_operators.py the probabilities against their definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is kept in the shared checkpoint folder.

    An empty table goes through all stages; other columns of documents go along to the last one, which returns ids, counts
    and digests alone. When a stage has been written, what its predecessor wrote is removed.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}-{name}")
            docs = spark.read.parquet(f"{folder}/{n}-{name}")
            if n:
                _remove(spark, f"{folder}/{n - 1}-{STAGES[n - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
