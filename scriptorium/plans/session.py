"""Session helpers: settings for large inputs, and this package on the executors."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def build_session(app: str = "scriptorium", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC times and Kryo-free defaults; `conf` adds or overrides settings."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k: str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


#: Rows that go to a Python worker at once: texts can be long, and a worker holds a batch as Arrow, as strings and as results.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, unless their path already leads to it; keep batches for them small, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False) or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="spark-")
    sc.addPyFile(shutil.make_archive(f"{folder}/scriptorium", "zip", ROOT, "scriptorium"))
    sc._scriptorium_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names (in one of our own only in a local session where it is unset); what stands there goes when the application ends."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = sc._scriptorium_tables = getattr(sc, "_scriptorium_tables", None) or tempfile.mkdtemp(prefix="spark-")
    path = f"{folder}/table-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)  # with the application, not before: results read it late
    return path


def shared_table(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
