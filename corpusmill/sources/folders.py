"""Folders that the driver and all executors share, and tables cut to them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpusmill-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder as Parquet, and where; the caller deletes it after its last read.

    Columns are read as they are asked for, and rows cost a fraction of what
    they cost in a checkpoint, which stores them as Java objects.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; Spark deletes it once nothing refers to it, if so configured.

    A checkpoint keeps the size that was estimated for its plan, a product over
    the joins in it. Where rounds build on each other that number squares each
    time, until it alone fills the driver; so the written rows are taken over
    without it.
    """
    spark = df.sparkSession
    shared_root(spark)
    kept = df.checkpoint(eager=True)
    rows = kept._jdf.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
