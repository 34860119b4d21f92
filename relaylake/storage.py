"""Folders and tables that outlive a task: intermediate Parquet and streaming checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can read.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a
    single-machine session gets a temporary folder; a cluster session is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="relaylake-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def fresh_path(spark: SparkSession, prefix: str) -> str:
    return f"{shared_dir(spark)}/{prefix}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; this cuts the lineage."""
    path = fresh_path(df.sparkSession, "t")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
