"""Whole exports: numbered Markdown files of notes, and JSON backups of all tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.workspace import once

#: Rows that one task numbers, about.
BUCKET_ROWS = 1_000_000


def numbered(df: DataFrame, at: str, key: str = "id", rows_each: int = BUCKET_ROWS) -> DataFrame:
    """df and nth (long, from 1) by falling numeric `at`, ties by key, nulls last; no task holds all rows.

    Only (key, at) is sorted: dealt by ranges of both, so that a value of `at` with any share of the rows spreads over
    tasks, numbered inside a task, kept, and moved on by the sizes of the tasks before, one row a task. The numbers are
    joined by key, which must be unique.
    """
    order = [F.desc_nulls_last(at), F.asc(key)]
    tasks = max(1, -(-df.count() // rows_each))
    sorted_ = once(df.select(key, at).repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(key, F.monotonically_increasing_id().alias("_m")))
    task = F.shiftright("_m", 33)
    sizes = sorted_.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over one row a task
    numbers = sorted_.withColumn("_task", task).join(F.broadcast(sizes.select("_task", ahead.alias("_ahead"))), "_task")
    nth = F.col("_ahead") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    return df.join(numbers.select(key, nth.alias("nth")), key)


def file_name(nth: Column, title: Column) -> Column:
    """Number of at least three digits and the title without characters that file systems refuse, at most 60 long."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.nullif(title, F.lit("")), F.lit("无标题")), r'[\\/:*?"<>|\r\n]+', " "))
    return F.format_string("%03d-%s.md", nth, F.substring(F.regexp_replace(plain, r"\s+", " "), 1, 60))


def markdown_files(df: DataFrame, tags: DataFrame, types: tuple[str, ...] = ("note", "article", "webclip"), at: str = "created_minute") -> DataFrame:
    """nth, name, type, body: a Markdown file of every living document of the types, newest first.

    Body: title, a line of tags in order of name, the source, the text. tags: id, tag; repeated ones count once.
    """
    own = df.where(~F.coalesce("deleted", F.lit(False)) & F.col("type").isin(*types))
    listed = tags.join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("_tags"))
    rows = numbered(own, at).join(listed, "id", "left")
    source = F.col("source_url") if "source_url" in df.columns else F.lit("")
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c, F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), line("标签：", F.col("_tags")), line("来源：", source), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    return rows.select("nth", file_name(F.col("nth"), F.col("title")).alias("name"), "type", body.alias("body"))


def backup_lines(df: DataFrame) -> DataFrame:
    """line: one JSON object a row, null fields written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def write_backup(tables: dict[str, DataFrame], out: str) -> None:
    """Each table as JSON lines in a folder of its name, and meta: table, schema and version."""
    first = next(iter(tables.values()))
    for name, df in tables.items():
        backup_lines(df).write.text(f"{out}/{name}")
    meta = [(name, df.schema.json(), 1) for name, df in tables.items()]
    first.sparkSession.createDataFrame(meta, "table string, schema string, version int").coalesce(1).write.json(f"{out}/meta")


def read_backup(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of a backup with their schemas, by name."""
    meta = spark.read.schema("table string, schema string, version int").json(f"{out}/meta").collect()  # one row a table
    return {r["table"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).json(f"{out}/{r['table']}") for r in meta}
