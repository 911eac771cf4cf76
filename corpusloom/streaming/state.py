"""Stateful operators as Structured Streaming queries, and their batch forms over a finished log.

The windows over events (tumbling, session) are extensions of this package; the rest follows the stateful rules of a
document service: limits of calls, arrival without repeats, minutes of sessions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import limited_stream, locked_out_stream, thinned_stream  # noqa: F401


def decided(df: DataFrame, keys: list[str], at: str, most: int, span: int) -> DataFrame:
    """keys, at, allowed: rows in order of time by key, each allowed while fewer than `most` allowed ones lie within
    `span` microseconds before it. Rows are streamed; what is held of a key is its last `most` allowed times."""
    rows = df.select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).where("_t IS NOT NULL")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _ok boolean"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, deque()
        for b in source:
            own, ok = zip(*(c.to_pylist() for c in b.columns[:-1]), strict=True), []
            for key, t in zip(own, b.columns[-1].to_pylist(), strict=True):
                if key != now:
                    now, kept = key, deque()
                while kept and t - kept[0] > span:
                    kept.popleft()
                ok.append(len(kept) < most)
                if ok[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=[*b.schema.names, "_ok"])

    out = rows.repartition(*keys).sortWithinPartitions(*keys, "_t").mapInArrow(run, schema)
    return out.select(*keys, F.timestamp_micros("_t").alias(at), F.col("_ok").alias("allowed"))


def locked_out(df: DataFrame, key: str, at: str, ok: str, most: int = 20, seconds: int = 300) -> DataFrame:
    """key, at, locked: whether a try comes while `most` failures lie within `seconds` before it.

    A success clears them, and neither it nor a failure counts while the key is locked. Rows are streamed by key and
    time (failures before successes at one time); what is held of a key is its last failures.
    """
    rows = df.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.coalesce(F.col(ok), F.lit(False)).alias("_s")).where("_t IS NOT NULL")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", locked boolean"
    span = seconds * 1_000_000

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, failed = None, deque()
        for b in source:
            out = []
            for k, t, good in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != now:
                    now, failed = k, deque()
                while failed and t - failed[0] > span:
                    failed.popleft()
                out.append(len(failed) >= most)
                if not out[-1]:
                    failed.clear() if good else failed.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, "locked"])

    out = rows.repartition(key).sortWithinPartitions(key, "_t", "_s").mapInArrow(run, schema)
    return out.select(key, F.timestamp_micros("_t").alias(at), "locked")


def limited(df: DataFrame, keys: list[str], at: str, most: int, seconds: int) -> DataFrame:
    """keys, at, allowed: a call is allowed while fewer than `most` allowed ones lie within `seconds`; refused calls
    don't count (batch form)."""
    return decided(df, keys, at, most, seconds * 1_000_000)


def arrivals(stream: DataFrame, digest: str, at: str, within: str = "1 day") -> DataFrame:
    """Rows whose digest did not arrive before within the watermark; works on batches and streams."""
    if stream.isStreaming:
        return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([digest])
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(digest).orderBy(at, *sorted(c for c in stream.columns if c not in (digest, at))))
    return stream.withColumn("_n", nth).where("_n = 1").drop("_n")


def sessions(df: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n: sessions by inactivity; on a stream with a watermark for late rows."""
    rows = df.withWatermark(at, late) if df.isStreaming else df
    found = rows.groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(df: DataFrame, at: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, n by windows of fixed width; on a stream with a watermark."""
    rows = df.withWatermark(at, late) if df.isStreaming else df
    return rows.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
