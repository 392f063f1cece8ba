"""Results of a step, written once for the steps that read them."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def run_folder(spark: SparkSession) -> str:
    """The folder of this session's steps inside the one that driver and executors share.

    That is ``spark.checkpoint.dir``.  Only a local session without one, as in tests, gets
    a temporary folder; on a cluster executors couldn't see it, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-loomplan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomplan-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the run's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the run's folder and read it back.

    Several later steps then read a file instead of planning and running all that
    stands above it, also after an executor is lost.  ``drop_run`` removes the files.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_run(spark: SparkSession) -> None:
    """Delete all that this session's steps have written; DataFrames built on it can't be read any more."""
    folder = run_folder(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder if urlparse(folder).scheme else f"file://{folder}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
