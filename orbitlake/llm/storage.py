"""Shared-folder storage: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session with a local master gets a temporary folder
    (tests); on a cluster that is an error, as executors would write to their
    own disks.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="orbitlake-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(remove, spark, named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit; the folder is then the cluster's to clear
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


#: Paths written inside each open ``scratch``, the innermost last.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those stored with ``keep``: these live as long as the scratch around it, if any."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/orbitlake/{name}-{uuid.uuid4().hex}"
    scopes = _open[:-1] if keep else _open
    if scopes:
        scopes[-1].append(path)
    else:
        atexit.register(remove, spark, path)
    return path


def stored(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lost executor costs no recomputation past it."""
    path = new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def replayable(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` whose tasks give the same rows in the same order when run again: itself if it scans files without a shuffle, else stored."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = "FileScan" in plan or "Scan parquet" in plan
    return df if scans and "Exchange" not in plan and "Scan ExistingRDD" not in plan else stored(df, name)
