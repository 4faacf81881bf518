"""Where intermediate tables go: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .local_files import local_files


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder, else a new temporary one (local mode, as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def prepare(spark: SparkSession, size: int = 4 << 20) -> None:
    """Session settings that all operators rely on.

    Arrow batches hold some MB at most (Spark's own bound is far higher), so that texts of any length leave room in an executor.
    Folders named by file: are written without a checksum file and without the `chmod` process that Hadoop, where its
    native library is missing, starts for each new folder and file (see local_files). Other file systems are not concerned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("fs.file.impl", local_files(spark))
    spark.conf.set("fs.file.impl.disable.cache", "true")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/sieveline/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written once as Parquet and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "__dict__", {}).get("stored_at"):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
