"""Tables written once to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where it is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # executors of a local cluster have folders of their own
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="orbitlake-runs-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(remove, spark, named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver ends."""
    path = f"{shared_dir(spark)}/orbitlake-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: what is built on it neither computes it twice nor loses it with an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
