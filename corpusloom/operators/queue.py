"""Reading queue and review cards: who gets in, in which order, and what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PRIORITY, NOTE_LENGTH, STAGGER_DAYS = 1000, 500, 14


def item(priority: Column, note: Column) -> list[Column]:
    """priority within its bounds and note cut to its length."""
    return [F.greatest(F.lit(0), F.least(F.lit(MOST_PRIORITY), priority)).alias("priority"), F.substring(F.coalesce(note, F.lit("")), 1, NOTE_LENGTH).alias("note")]


def in_order(items: DataFrame, df: DataFrame, status: str = "active") -> DataFrame:
    """The queue with its documents: by priority, place, creation and id; the first row is the next one."""
    rows = items.where(F.col("status") == status).join(df.where(~F.col("deleted")).select(F.col("id").alias("document_id"), "title"), "document_id")
    return rows.orderBy("priority", "sort_order", "created_minute", "id")


#: States of an item.
STATUSES = ("active", "paused", "done")


def patched(items: DataFrame, changes: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """(items after the changes that are valid, id and outcome of every change).

    changes: id, given array<string>, priority, note, status. Only given fields are set: priority within its bounds,
    note cut; null leaves them. Outcomes: not_found, no_fields, bad_status, updated; updated_minute becomes `at`.
    """
    new = changes.select("id", "given", *[F.col(c).alias(f"_{c}") for c in ("priority", "note", "status")])
    has = lambda c: F.array_contains("given", c)
    bad = has("status") & ~F.coalesce(F.col("_status").isin(*STATUSES), F.lit(False))
    outcome = F.when(F.size("given") == 0, "no_fields").when(bad, "bad_status").otherwise("updated")
    judged = new.join(items.select("id", F.lit(True).alias("_there")), "id", "left").withColumn("outcome", F.when(F.col("_there").isNull(), "not_found").otherwise(outcome))
    fit = judged.where("outcome = 'updated'").drop("_there", "outcome")
    priority, note = item(F.col("_priority"), F.col("_note"))
    rows = items.join(fit, "id", "left")
    value = lambda c, v: F.when(F.coalesce(has(c), F.lit(False)) & F.col(f"_{c}").isNotNull(), v).otherwise(F.col(c)).alias(c)
    own = {"priority": value("priority", priority), "note": value("note", note), "status": value("status", F.col("_status")), "updated_minute": F.when(F.col("given").isNotNull(), F.lit(at)).otherwise(F.col("updated_minute")).alias("updated_minute")}
    return rows.select(*[own.get(c, F.col(c)) for c in items.columns]), judged.select("id", "outcome")


def upcoming(items: DataFrame, df: DataFrame) -> DataFrame:
    """The next item of the queue, if there is one."""
    return in_order(items, df).limit(1)


def reordered(items: DataFrame, ids: list) -> DataFrame:
    """items with sort_order set to the place in `ids`; the others keep theirs."""
    given = items.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in ids])).alias("_place", "id"))
    return items.join(F.broadcast(given), "id", "left").withColumn("sort_order", F.coalesce("_place", "sort_order")).drop("_place")  # as many rows as ids


def adding(df: DataFrame, items: DataFrame) -> DataFrame:
    """id, outcome: created, exists, or not_applicable for deleted, unread and finished documents and other types."""
    there = items.select(F.col("document_id").alias("id"), F.lit(True).alias("_q")).distinct()
    p = F.coalesce("progress", F.lit(0.0))
    fit = ~F.col("deleted") & F.col("type").isin("book", "pdf") & (p > 0) & (p < 1)
    outcome = F.when(~fit, "not_applicable").when(F.col("_q").isNotNull(), "exists").otherwise("created")
    return df.select("id", "deleted", "type", "progress").join(there, "id", "left").select("id", outcome.alias("outcome"))


def new_cards(annotations: DataFrame, df: DataFrame, cards: DataFrame) -> DataFrame:
    """Annotations that need a card: no bookmarks, none of deleted documents, none that has one."""
    open_ = annotations.where(F.col("type") != "bookmark").join(df.where(~F.col("deleted")).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return open_.join(cards.select("id"), "id", "left_anti")


def staggered(df: DataFrame, at: str = "created_minute", days: int = STAGGER_DAYS) -> DataFrame:
    """df plus nth (from 1, by `at` and id over all rows) and day = nth modulo `days`.

    Rows are numbered within a day of `at`, and days by the counts before them, so no task numbers the whole table.
    """
    day = F.floor(F.col(at) / 1440)
    before = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # over one row a day
    offset = df.groupBy(day.alias("_d")).agg(F.count("*").alias("_c")).select("_d", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_d").orderBy(at, "id"))
    out = df.withColumn("_d", day).withColumn("_n", own).join(offset, "_d")
    return out.withColumn("nth", F.col("_n") + F.col("_o")).withColumn("day", F.col("nth") % days).drop("_d", "_n", "_o")


def counters(cards: DataFrame, annotations: DataFrame, now: int, offset_minutes: int) -> DataFrame:
    """due_now, due_today, upcoming_7d, reviewed_today, new_today at minute `now`; days begin at midnight of the offset."""
    start = (now + offset_minutes) // 1440 * 1440 - offset_minutes
    today = lambda c: (F.col(c) >= start) & (F.col(c) < start + 1440)
    active, due = F.col("status") == "active", F.col("due_minute")
    own = cards.agg(
        F.count_if(active & (due <= now)).alias("due_now"), F.count_if(active & (due > now) & (due < start + 1440)).alias("due_today"),
        F.count_if(active & (due > now) & (due <= now + 7 * 1440)).alias("upcoming_7d"), F.count_if(today("rated_minute")).alias("reviewed_today"),
    )
    new = annotations.agg(F.count_if(F.col("type").isin("highlight", "note") & today("created_minute")).alias("new_today"))
    return own.crossJoin(new)  # one row each


def since(annotations: DataFrame, minute: int, types: tuple[str, ...] = (), limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of annotations from a time on, newest first."""
    rows = annotations.where(F.col("created_minute") >= minute)
    rows = rows.where(F.col("type").isin(*types)) if types else rows
    return rows.orderBy(F.desc("created_minute"), F.desc("id")).offset(offset).limit(limit)
