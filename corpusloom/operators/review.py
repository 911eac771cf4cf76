"""Spaced repetition, due lists, reading activity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed values of the schedule: ease bounds, ease changes by rating 1 to 4, first intervals, minutes of a repeat.
EASE_MIN, EASE_MAX, AGAIN_MINUTES = 1.3, 2.8, 10
EASE_CHANGE = {1: -0.2, 2: -0.15, 3: 0.0, 4: 0.15}


#: Days an interval can have at most: dates end in the year 9999, and no due date lies beyond.
MOST_DAYS = 2_900_000


def start_state() -> Column:
    return F.struct(F.lit(0).alias("interval"), F.lit(2.5).cast("double").alias("ease"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"))


def step(state: Column, rating: Column) -> Column:
    """The next (interval days, ease, reps, lapses) after a rating: 1 again, 2 hard, 3 good, 4 easy. Days are cut, not rounded."""
    change = F.when(rating == 1, EASE_CHANGE[1]).when(rating == 2, EASE_CHANGE[2]).when(rating == 4, EASE_CHANGE[4]).otherwise(EASE_CHANGE[3])
    ease = F.least(F.lit(EASE_MAX), F.greatest(F.lit(EASE_MIN), state["ease"] + change))
    days = lambda x: F.least(F.lit(MOST_DAYS), F.greatest(F.lit(1).cast("long"), F.floor(x)))
    i = state["interval"]
    good = F.when(state["reps"] == 0, 1).when(state["reps"] == 1, 3).otherwise(days(i * state["ease"]))
    easy = F.when(state["reps"] == 0, 4).otherwise(days(i * state["ease"] * 1.3))
    interval = F.when(rating == 1, 0).when(rating == 2, days(i * 1.2)).when(rating == 3, good).otherwise(easy)
    reps = F.when(rating == 1, 0).otherwise(state["reps"] + 1)
    lapses = state["lapses"] + F.when(rating == 1, 1).otherwise(0)
    return F.struct(interval.cast("int").alias("interval"), ease.alias("ease"), reps.cast("int").alias("reps"), lapses.cast("int").alias("lapses"))


def due_after(interval: Column, rated_at: Column) -> Column:
    """When a card is due again: AGAIN_MINUTES after a rating that left no interval, else so many days after it."""
    minutes = F.when(interval == 0, F.lit(AGAIN_MINUTES)).otherwise(interval.cast("long") * 1440)
    return F.timestamp_micros(F.unix_micros(rated_at.cast("timestamp")) + minutes * 60_000_000)


def rate(cards: DataFrame, ratings: DataFrame, key: str, at: str) -> DataFrame:
    """key, interval, ease, reps, lapses, due_at: the cards (same columns) after one rating each (key, rating, at)."""
    state = F.struct("interval", "ease", "reps", "lapses")
    out = cards.join(ratings, key).select(key, at, step(state, F.col("rating")).alias("s"))
    return out.select(key, "s.*", due_after(F.col("s.interval"), F.col(at)).alias("due_at"))


def snooze(due_at: Column, now: Column, days: int) -> Column:
    """A card put off by 1, 3 or 7 days from now."""
    if days not in (1, 3, 7):
        raise ValueError("1, 3 or 7 days")
    return F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + days * 86_400_000_000)


def fold_ratings(df: DataFrame, key: str, order: list[str], rating: str) -> DataFrame:
    """key, interval, ease, reps, lapses after all ratings of a key, oldest first.

    Rows are streamed in order, and one state is held at a time: no key's history is ever an array.
    """
    rows = df.select(key, *order, F.col(rating).cast("int").alias("_r")).repartition(key).sortWithinPartitions(key, *order).select(key, "_r")
    of = df.schema[key].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(k, s) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], kind), *(pa.array([x], t) for x, t in zip(s, (pa.int32(), pa.float64(), pa.int32(), pa.int32())))], names=[key, "interval", "ease", "reps", "lapses"])

        now, state, kind = None, None, None
        for b in source:
            kind = b.column(0).type
            for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or k != now:
                    if state is not None:
                        yield row(now, state)
                    now, state = k, (0, 2.5, 0, 0)
                state = rated(*state, r)
        if state is not None:
            yield row(now, state)

    return rows.mapInArrow(run, f"`{key}` {of}, interval int, ease double, reps int, lapses int")


def rated(days: int, ease: float, reps: int, lapses: int, rating: int) -> tuple[int, float, int, int]:
    """step() for one row of a streamed history."""
    if rating == 1:
        days, reps, lapses = 0, 0, lapses + 1
    else:
        if rating == 3 and reps < 2:
            days = 1 if reps == 0 else 3
        elif rating == 4 and reps == 0:
            days = 4
        else:
            grown = days * 1.2 if rating == 2 else days * ease if rating == 3 else days * ease * 1.3
            days = min(MOST_DAYS, max(1, int(grown)))
        reps += 1
    return days, min(EASE_MAX, max(EASE_MIN, ease + EASE_CHANGE[rating])), reps, lapses


#: Words after minutes and days.
MINUTES, DAYS = " 分钟", " 天"


def interval_words(minutes: Column) -> Column:
    """Whole minutes below a day, else whole days, both half to even and 1 at least."""
    n = F.bround(minutes.cast("double"), 0).cast("long")
    days = F.bround(n / 1440, 0).cast("long")
    return F.when(n < 1440, F.concat(F.greatest(n, F.lit(1)), F.lit(MINUTES))).otherwise(F.concat(F.greatest(days, F.lit(1)), F.lit(DAYS)))


def preview(state: Column, again: int = AGAIN_MINUTES) -> Column:
    """struct<again, hard, good, easy>: how long each rating would send a card away, in words."""
    days = lambda r: step(state, F.lit(r))["interval"]
    later = lambda r: interval_words(F.when(days(r) == 0, F.lit(again)).otherwise(days(r).cast("long") * 1440))
    return F.struct(*[later(r).alias(n) for r, n in enumerate(("again", "hard", "good", "easy"), 1)])


def last_active_days(df: DataFrame, most: int = 7) -> DataFrame:
    """The newest `most` days with minutes (day, minutes), newest first."""
    return df.where("minutes > 0").orderBy(F.desc("day")).limit(most)


def minutes_by_day(df: DataFrame, start: str, end: str) -> DataFrame:
    """day, minutes: sessions count on the day they start, negative ones as 0; rounded half-even to one place."""
    spent = F.greatest(F.lit(0.0), (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 60e6)
    return df.groupBy(F.to_date(start).alias("day")).agg(F.bround(F.sum(spent), 1).alias("minutes"))


def dense_days(df: DataFrame, day: str, value: str, first: Column, last: Column) -> DataFrame:
    """One row a day from first to last, 0 where df has none."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias(day))
    return days.join(df.select(day, value), day, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def due(df: DataFrame, now: Column, new_most: int, old_most: int) -> DataFrame:
    """tier, rows: new cards (interval 0) by creation, then the others by due time, each with a limit of its own."""
    ready = df.where((F.col("status") == "active") & (F.col("due_at") <= now))
    new = ready.where("interval_days = 0").orderBy("created_at", "id").limit(new_most).withColumn("tier", F.lit(0))
    old = ready.where("interval_days > 0").orderBy("due_at", "id").limit(old_most).withColumn("tier", F.lit(1))
    return new.unionByName(old)


def local_day_counts(df: DataFrame, ts: str, offset_minutes: int) -> DataFrame:
    return df.groupBy(T.day_at(F.col(ts), offset_minutes).alias("day")).agg(F.count("*").alias("n"))
