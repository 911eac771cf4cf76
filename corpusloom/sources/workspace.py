"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on a local master that names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-corpusloom-"))
    return sc.getCheckpointDir().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def version(spark: SparkSession, path: str) -> str:
    """A digest of a file's or folder's listing (paths, sizes, times): it changes when the data are written again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    it = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    rows = []
    while it.hasNext():
        f = it.next()
        rows.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(rows)).encode()).hexdigest()


def once(df: DataFrame) -> DataFrame:
    """df worked out once, its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
