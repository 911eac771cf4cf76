"""Links between documents: backlinks, mentions without a link or a target, renames, suggestions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def backlinks(links: DataFrame, df: DataFrame, target) -> DataFrame:
    """id, title, kind: live documents that link to `target`, newest first."""
    rows = links.where(F.col("target") == target).select(F.col("source").alias("id"), "kind").join(df.where(~F.col("deleted")), "id")
    return rows.orderBy(F.desc("updated_minute"), "id").select("id", "title", "kind")


def unlinked(df: DataFrame, links: DataFrame, target, title: str, limit: int = 50) -> DataFrame:
    """id, title: documents that hold the title of `target` without a link to it.

    The limit takes the newest holders first and linked ones are left out of those, so fewer may come back.
    """
    if len(title) < 2:
        return df.select("id", "title").limit(0)
    first = df.where(~F.col("deleted") & (F.col("id") != target) & F.col("content").contains(title)).orderBy(F.desc("updated_minute"), "id").limit(limit)
    return first.select("id", "title").join(links.where(F.col("target") == target).select(F.col("source").alias("id")), "id", "left_anti")


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """id, content of the documents whose [[old]] mentions, in any case, become [[new]]."""
    hit = F.lower("content").contains(f"[[{old.lower()}]]")
    pattern, plain = "(?i)" + re.sub(r"([^\w\s])", r"\\\1", f"[[{old}]]"), new.replace("\\", "\\\\").replace("$", "\\$")
    return df.where(hit).select("id", F.regexp_replace("content", F.lit(pattern), F.lit(f"[[{plain}]]")).alias("content"))


def placeholders(df: DataFrame, most: int = 50) -> DataFrame:
    """title, n: mentioned titles that no live document has, by the number of documents that mention them."""
    live = df.where(~F.col("deleted"))
    found = live.where(F.col("content").contains("[[")).select(F.explode(F.array_distinct(T.mentions(F.col("content")))).alias("title"))
    counted = found.groupBy("title").agg(F.count("*").alias("n")).join(live.select("title").distinct(), "title", "left_anti")
    return counted.orderBy(F.desc("n"), "title").limit(most)


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """links with the new ones (source, target, kind); links to oneself are refused, known ones stay as they are."""
    return links.select("source", "target", "kind").union(new.where("source <> target").select("source", "target", "kind")).distinct()


def graph(df: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, title, type of live documents; edges: source, target, kind)."""
    return df.where(~F.col("deleted")).select("id", "title", "type"), links.select("source", "target", "kind")


def suggestions(df: DataFrame, title: str, own, most: int = 5) -> DataFrame:
    """id, score: 0.9 where one title holds the other, else 0.4; the best ones, ties by id."""
    low = F.lower("title")
    score = F.when(low.contains(title.lower()) | F.contains(F.lit(title.lower()), low), 0.9).otherwise(0.4)
    return df.where(~F.col("deleted") & (F.col("id") != own)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(most)
