"""Keywords, mentions, links and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import STOPWORDS


def keywords(df: DataFrame, most: int = 5, key: str = "id") -> DataFrame:
    """key, word, n, nth: the commonest lower-cased words of two letters or more, ties by word; no stop words.

    Words are counted as (key, word) pairs with partial aggregation, and the rank is cut before its shuffle.
    """
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"[a-z]{2,}"), 0)).alias("word")
    counted = df.select(key, words).where(~F.col("word").isin(*sorted(STOPWORDS))).groupBy(key, "word").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    return counted.withColumn("nth", nth).where(F.col("nth") <= most)


def mention_edges(df: DataFrame) -> DataFrame:
    """source, target: [[title]] mentions joined with the documents of that title, itself excluded."""
    found = df.where(F.col("content").contains("[[")).select(F.col("id").alias("source"), F.explode(T.mentions(F.col("content"))).alias("title"))
    return found.join(df.select(F.col("id").alias("target"), "title"), "title").where("source <> target").select("source", "target").distinct()


def contained(df: DataFrame, titles: DataFrame, gram: int = 12, few: int = 1000) -> DataFrame:
    """source, target: documents whose content holds the title (title_id, title), found by a shared gram, then checked.

    A title is looked up by its first `gram` characters: an equi join on grams instead of a nested loop. Titles shorter
    than that are looked up by all they have, in a pass of their own for each such length.
    """
    sized = titles.where(F.length("title") > 1).withColumn("_g", F.least(F.length("title"), F.lit(gram)))
    first = sized.select("title_id", "title").limit(few + 1).collect()
    if len(first) <= few:
        held = F.array(*[F.struct(F.lit(r.title_id).alias("id"), F.lit(r.title).alias("t")) for r in first])
        hits = F.filter(held, lambda x: F.col("content").contains(x["t"]))
        return df.select(F.col("id").alias("source"), F.explode(hits).alias("x")).select("source", F.col("x.id").alias("target")).distinct() if first else df.select(F.col("id").alias("source"), F.col("id").alias("target")).limit(0)
    lengths = sorted(r["_g"] for r in sized.select("_g").distinct().collect())  # at most `gram` values
    out = None
    for n in lengths:
        keys = sized.where(F.col("_g") == n).select(F.col("title_id").alias("target"), "title", F.substring("title", 1, n).alias("gram"))
        starts = F.transform(F.sequence(F.lit(1), F.length("content") - (n - 1)), lambda i: F.substring("content", i, F.lit(n)))  # noqa: B023
        grams = df.where(F.length("content") >= n).select(F.col("id").alias("source"), F.explode(F.array_distinct(starts)).alias("gram"))
        pairs = grams.join(keys, "gram").select("source", "target", "title")
        out = pairs if out is None else out.union(pairs)
    if out is None:
        return df.select(F.col("id").alias("source"), F.col("id").alias("target")).limit(0)
    checked = out.join(df.select(F.col("id").alias("source"), "content"), "source").where(F.col("content").contains(F.col("title")))
    return checked.select("source", "target").distinct()


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: in and out together."""
    ends = edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """node, hop: nodes within `hops` undirected steps of start (node), with the least number of steps."""
    ways = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    seen = front = start.select("node", F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        new = front.join(ways, front["node"] == ways["a"]).select(F.col("b").alias("node")).distinct()
        front = new.join(seen.select("node"), "node", "left_anti").select("node", F.lit(h).alias("hop"))
        seen = seen.union(front)
    return seen


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no end of any edge."""
    ends = edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_anti")


def ancestors(parents: DataFrame, depth: int = 16) -> DataFrame:
    """node, ancestor, distance of a forest (node, parent), up to `depth` levels; a cycle shows as node = ancestor."""
    up = parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"))
    out = level = up.withColumn("distance", F.lit(1))
    for d in range(2, depth + 1):
        step = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        level = level.where("node <> ancestor").join(step, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(d).alias("distance"))
        out = out.union(level)
    return out
