"""Cuts of lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a local session's own where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs, for operators whose last job follows a cut."""
    spark._jvm.System.gc()


def stored(frame: DataFrame, compression: str = "snappy") -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read from there.

    Spark removes the shuffle files of a finished job when the driver collects its plan as garbage. They
    are not needed behind a cut, so the driver is asked to, and a chain of cuts holds the disk of one job.
    Right behind a job, Spark may still hold its plan, so the driver is asked before the next one again.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    release(spark)
    frame.write.parquet(path, compression=compression)
    release(spark)
    return spark.read.schema(frame.schema).parquet(path)
