"""Stateful rules by key as streams whose state ends: limits of calls, lockouts, thinning.

One processor serves all rules: a rule says, for the times kept of a key and the next row, what the verdict is, what is
kept, and until when that matters. Rows of a key in one micro-batch are taken in order of time (only times and flags are
held, 16 bytes a row). A timer in event time clears a key's state once the watermark has passed the rule's end, so that
keys which fall silent leave nothing behind. Rows later than the watermark are dropped by the stream, as always.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: kept times, time, flag -> verdict, kept times, last time at which what is kept counts.
Rule = Callable[[list[int], int, bool], tuple[bool, list[int], int]]


def at_most(most: int, seconds: int) -> Rule:
    """A call is allowed while fewer than `most` allowed ones lie within `seconds` before it."""
    span = seconds * 1_000_000

    def rule(kept: list[int], t: int, flag: bool) -> tuple[bool, list[int], int]:
        kept = [x for x in kept if t - x <= span]
        ok = len(kept) < most
        kept = [*kept, t] if ok else kept
        return ok, kept, kept[-1] + span if kept else t

    return rule


def lockout(most: int = 20, seconds: int = 300) -> Rule:
    """Locked while `most` failures lie within `seconds`; a success (flag) clears them; nothing counts while locked."""
    span = seconds * 1_000_000

    def rule(kept: list[int], t: int, flag: bool) -> tuple[bool, list[int], int]:
        kept = [x for x in kept if t - x <= span]
        locked = len(kept) >= most
        if not locked:
            kept = [] if flag else [*kept, t]
        return locked, kept, kept[-1] + span if kept else t

    return rule


def spaced(seconds: int) -> Rule:
    """A row is kept if it comes `seconds` or more after the last kept one."""
    span = seconds * 1_000_000

    def rule(kept: list[int], t: int, flag: bool) -> tuple[bool, list[int], int]:
        ok = not kept or t - kept[-1] >= span
        kept = [t] if ok else kept
        return ok, kept, kept[-1] + span

    return rule


class Remembering(StatefulProcessor):
    """Keeps a rule's times by key and forgets a key when its timer runs out."""

    def __init__(self, rule: Rule, names: list[str], verdict: str):
        self.rule, self.names, self.verdict = rule, names, verdict

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "kept array<bigint>, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["t_micros"].to_numpy(np.int64), f["t_flag"].to_numpy(bool)) for f in rows]
        t, flag = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((flag, t))
        kept, until = (list(self.times.get()[0]), self.times.get()[1]) if self.times.exists() else ([], 0)
        out = []
        for x, f in zip(t[by].tolist(), flag[by].tolist(), strict=True):
            ok, kept, until = self.rule(kept, x, f)
            out.append(ok)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if kept:
            self.times.update((kept, until))
            self.handle.registerTimer(-(-until // 1000) + 1)
        elif self.times.exists():
            self.times.clear()
        frame = {n: [k] * len(out) for n, k in zip(self.names, key, strict=True)}
        yield pd.DataFrame(frame | {"t_micros": t[by], self.verdict: out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def decided_stream(stream: DataFrame, keys: list[str], at: str, rule: Rule, verdict: str, flag: str | None = None, late: str = "10 minutes") -> DataFrame:
    """keys, at, verdict boolean of a stream's rows under a rule; `late` is how far rows may come out of order.

    Null times are dropped; columns of the names t_at, t_micros and t_flag are not to be keys (names in processors must not
    start with an underscore). The state is kept by the RocksDB provider, which the session is set to.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(stream.dtypes)
    own = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    rows = stream.select(*keys, F.col(at).cast("timestamp").alias("t_at"), own.alias("t_flag")).where("t_at IS NOT NULL").withWatermark("t_at", late)
    rows = rows.withColumn("t_micros", F.unix_micros("t_at"))
    schema = ", ".join(f"`{k}` {kind[k]}" for k in keys) + f", t_micros bigint, `{verdict}` boolean"
    out = rows.groupBy(*keys).transformWithStateInPandas(Remembering(rule, keys, verdict), schema, "append", "EventTime")
    return out.select(*keys, F.timestamp_micros("t_micros").alias(at), verdict)


def limited_stream(stream: DataFrame, key: str, at: str, most: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, at, allowed as a stream, see at_most."""
    return decided_stream(stream, [key], at, at_most(most, seconds), "allowed", late=late)


def locked_out_stream(stream: DataFrame, key: str, at: str, ok: str, most: int = 20, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """key, at, locked as a stream, see lockout."""
    return decided_stream(stream, [key], at, lockout(most, seconds), "locked", ok, late)


def thinned_stream(stream: DataFrame, key: str, at: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, at of the rows that are kept, see spaced."""
    return decided_stream(stream, [key], at, spaced(seconds), "kept", late=late).where("kept").select(key, at)
