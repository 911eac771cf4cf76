"""The books of a client without a server: filter, sorts and statistics over books and reading records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SEARCHED = ("title", "author", "publisher", "description")


def status(progress: str = "progress") -> Column:
    """unread, reading or done, of a progress in per cent; null is unread."""
    p = F.coalesce(progress, F.lit(0.0))
    return F.when(p >= 100, "done").when(p > 0, "reading").otherwise("unread")


def matches(df: DataFrame, search: str = "", category: str = "", author: str = "", format: str = "", language: str = "", tag: str = "", shelf: str = "all") -> DataFrame:
    """Books that meet all filters given; an empty one is none. `recent` and `all` are shelves of all books.

    The search looks in title, author, publisher and description as one text, case-insensitively; the author is
    contained as written, the format equal whatever its case, languages equal when normalised, the tag one of `tags`.
    """
    tests = []
    if term := search.strip():
        tests.append(T.contains(F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in SEARCHED]), " "), term))
    if category:
        tests.append(F.col("category") == category)
    if author:
        tests.append(F.contains(F.coalesce("author", F.lit("")), F.lit(author)))
    if format:
        tests.append(F.lower(F.coalesce("format", F.lit(""))) == format.lower())
    if language:
        tests.append(T.language(F.col("language")) == T.language(F.lit(language)))
    if tag:
        tests.append(F.coalesce(F.array_contains("tags", tag), F.lit(False)))
    if shelf not in ("", "all", "recent"):
        tests.append(status() == shelf)
    return reduce(DataFrame.where, tests, df)


def sort(df: DataFrame, name: str = "created_desc", limit: int = 50, offset: int = 0, collation: str = "zh") -> DataFrame:
    """One page in a named order, ties by id; names that aren't known sort by creation, newest first.

    Titles and authors compare under `collation`; books that were never read come last, and no value is 0.
    """
    title = F.collate(F.coalesce("title", F.lit("")), collation)
    worth = lambda c: F.coalesce(c, F.lit(0))
    orders = {
        "created_asc": [worth("added_at")],
        "title_asc": [title],
        "author_asc": [F.collate(F.coalesce("author", F.lit("")), collation), title],
        "last_read_desc": [F.desc_nulls_last("last_read_at")],
        "progress_desc": [worth("progress").desc()],
        "file_size_desc": [worth("file_size").desc()],
    }
    return df.orderBy(*orders.get(name, [worth("added_at").desc()]), "id").offset(offset).limit(limit)


def stats(books: DataFrame, records: DataFrame, offset_minutes: int = 0) -> DataFrame:
    """dimension, value, n double: books, started, completed, minutes; books by format; minutes by local day.

    Records have started_at and ended_at (timestamps); whole minutes of all records are cut, not rounded. One scan of
    the books, one of the records.
    """
    p = F.coalesce("progress", F.lit(0.0))
    kinds = F.array(
        F.struct(F.lit("books").alias("dimension"), F.lit("").alias("value")),
        F.when(p > 0, F.struct(F.lit("started").alias("dimension"), F.lit("").alias("value"))),
        F.when(p >= 100, F.struct(F.lit("completed").alias("dimension"), F.lit("").alias("value"))),
        F.struct(F.lit("format").alias("dimension"), F.coalesce("format", F.lit("")).alias("value")),
    )
    counted = books.select(F.explode(F.array_compact(kinds)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").cast("double").alias("n"))
    micros = F.unix_micros("ended_at") - F.unix_micros("started_at")
    by_day = records.groupBy(T.day_at(F.col("started_at"), offset_minutes).cast("string").alias("value")).agg(F.sum(micros).alias("m"))
    days = by_day.select(F.lit("day").alias("dimension"), "value", (F.col("m") / 60e6).alias("n"))
    whole = by_day.agg(F.coalesce(F.floor(F.sum("m") / 60e6), F.lit(0)).cast("double").alias("n")).select(F.lit("minutes").alias("dimension"), F.lit("").alias("value"), "n")
    return counted.unionByName(days).unionByName(whole)
