"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of every word count here: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"


#: Rows that an Arrow batch takes between the JVM and Python at most: texts and sets are some kilobytes a row, and a
#: batch of Spark's default of 10,000 would stand several times in memory, on both sides.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def lean(run):
    """A function for mapInArrow that gives Arrow's freed memory back when a task is through: Python workers live on."""

    def wrapped(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(source)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = sc.getCheckpointDir()
    if own is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        own = sc.getCheckpointDir()
    return own.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def let_go(spark: SparkSession) -> None:
    """Collect garbage on the driver: Spark's cleaner drops broadcasts and shuffle files of steps that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables written in the shared folder for one operator's run, each dropped after its last reader."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        let_go(spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read again."""
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(t)][0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        let_go(self.spark)


def placed(scratch: Scratch, df: DataFrame, order: list[Column], groups: tuple[str, ...] = ()) -> DataFrame:
    """df plus place long (from 0, of a row among its group's rows in this order) and total long (rows of the group).

    order starts with the groups, which hold no nulls. Rows are dealt by ranges of the whole order, so that a group may
    spread over many tasks, sorted there and written once; what tells ranges apart is one row a group and task.
    """
    rows = scratch.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_task", F.shiftright("_at", 33))
    sizes = rows.groupBy(*groups, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_task"))
    sizes = sizes.select(*groups, "_task", (upto - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(*groups)).alias("total"))
    sizes = sizes if groups else F.broadcast(sizes)  # without groups one row a task
    return rows.join(sizes, [*groups, "_task"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def checkpointed(df: DataFrame) -> DataFrame:
    """DataFrame.checkpoint() with the folder made sure of; for small id tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all of df's columns."""
    pad, known = "_", {c.lower() for c in df.columns}
    while any(f"{pad}{n}".lower() in known for n in names):
        pad += "_"
    return [f"{pad}{n}" for n in names]


def let(value: Column, body) -> Column:
    """body(value), with value worked out once per row even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """array<string> of maximal runs of non-space characters; null text gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bounded_partitions(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """Groups needed so that each holds about rows_each rows; the row count comes from a count() job."""
    return max(least, -(-df.count() // rows_each))
