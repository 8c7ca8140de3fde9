"""What a session needs before this library's queries run."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Frames that are written side by side: each one's plan takes memory of the driver while it is made and run.
SIDE_BY_SIDE = 3


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library when only the driver's ``sys.path`` holds it (``--py-files`` does so on a cluster)."""
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, ROOT]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a local session takes a temporary folder; elsewhere it must be set, as executors share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``shared_folder`` and read again: computed once, with no lineage or plan behind it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_together(**tables: DataFrame) -> dict[str, DataFrame]:
    """``stored`` for several frames that don't read one another, up to SIDE_BY_SIDE at once: none waits for the last tasks of another, nor for its plan."""
    for df in tables.values():
        shared_folder(df.sparkSession)
    with ThreadPoolExecutor(min(len(tables), SIDE_BY_SIDE)) as pool:
        return dict(zip(tables, pool.map(lambda name: stored(tables[name], name), tables), strict=True))
