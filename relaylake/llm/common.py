"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage like a checkpoint, but the files are columnar and
    compressed, and survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path is not None:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any case."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def replace_columns(df: DataFrame, **columns) -> DataFrame:
    """Add columns; an input column whose name clashes (in any case) gives way."""
    gone = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone], *[v.alias(k) for k, v in columns.items()])


def text_batches(spark: SparkSession, rows: int = 2048, size: int = 8 << 20) -> None:
    """Keep Arrow batches of whole texts small: at most ``rows`` rows and about ``size`` bytes.

    Plans run after the operator has returned, so the two settings stay in the session;
    smaller ones that are set already are kept. One row is never cut.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(name)
        if not have.lstrip("-").isdigit() or not 0 < int(have) <= most:
            spark.conf.set(name, str(most))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One Arrow string array with 64-bit offsets and no nulls (a null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column
