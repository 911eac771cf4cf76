"""Read-only reports over a shelf: what lacks covers or text, and the checks of a whole database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _counted(df: DataFrame, dimensions: dict[str, Column], counts: dict[str, Column]) -> DataFrame:
    """dimension, value and the counts, in one scan: a row counts once in every dimension, partial counts go ahead."""
    kinds = [F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in dimensions.items()]
    rows = df.select(F.explode(F.array(*kinds)).alias("_x"), *[c.alias(n) for n, c in counts.items()])
    return rows.groupBy("_x.dimension", "_x.value").agg(*[F.count_if(n).alias(n) for n in counts])


def without_cover(df: DataFrame) -> DataFrame:
    """dimension (all, format, type), value, rows, alive, isbn, author: documents without a cover path.

    Columns id, format, type, cover_path, author, isbn, deleted. isbn and author count the living with such a value.
    """
    alive = ~F.coalesce("deleted", F.lit(False))
    rows = df.where(F.coalesce("cover_path", F.lit("")) == "")
    named = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("<NULL>"))
    counts = {"rows": F.lit(True), "alive": alive, "isbn": alive & ~_blank("isbn"), "author": alive & ~_blank("author")}
    return _counted(rows, {"all": F.lit(""), "format": named("format"), "type": named("type")}, counts)


def without_content(df: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    """dimension (all, format), value, rows, alive, target: documents of blank text; targets could be extracted again.

    A target lives, has one of the formats and a file path.
    """
    alive = ~F.coalesce("deleted", F.lit(False))
    kind = F.lower(F.coalesce("format", F.lit("")))
    target = alive & kind.isin(*formats) & (F.coalesce("file_path", F.lit("")) != "")
    named = F.when(F.trim(kind) == "", "<NULL>").otherwise(F.trim(kind))
    return _counted(df.where(_blank("content")), {"all": F.lit(""), "format": named}, {"rows": F.lit(True), "alive": alive, "target": target})


def database(df: DataFrame, listing: DataFrame, rooms: DataFrame, books: tuple[str, ...] = ("book", "pdf")) -> DataFrame:
    """check, value, n, problem: totals, types, missing files, orphan files, empty texts, equal digests, orphan rooms.

    df: id, type, format, content, file_path, sha256, deleted; listing: path of every file; rooms: name, `doc-` and the
    id of a document. Empty texts are a problem in books only; n of equal digests is a group's size.
    """
    alive = df.where(~F.coalesce("deleted", F.lit(False)))
    total = df.agg(F.count("*").alias("total"), F.count_if("deleted").alias("deleted"))
    totals = total.select(F.explode(F.array(F.struct(F.lit("total").alias("check"), F.col("total").alias("n")), F.struct(F.lit("deleted").alias("check"), F.col("deleted").alias("n")))).alias("x"))
    totals = totals.select("x.check", F.lit("").alias("value"), "x.n", F.lit(False).alias("problem"))
    types = df.groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("type").alias("check"), "value", "n", F.lit(False).alias("problem"))
    filed = alive.where("file_path <> ''").select("id", F.col("file_path").alias("path"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    missing = filed.join(listing.select("path").distinct(), "path", "left_anti").select(F.lit("missing").alias("check"), F.col("path").alias("value"), F.lit(1).alias("n"), F.lit(True).alias("problem"))
    orphans = listing.select("path", base("path").alias("_b")).join(filed.select(base("path").alias("_b")), "_b", "left_anti")
    orphans = orphans.select(F.lit("orphan_file").alias("check"), F.col("path").alias("value"), F.lit(1).alias("n"), F.lit(True).alias("problem"))
    empty = alive.where(F.length(F.coalesce("content", F.lit(""))) == 0).groupBy("type", "format").agg(F.count("*").alias("n"))
    empty = empty.select(F.lit("empty").alias("check"), F.concat_ws("/", "type", "format").alias("value"), "n", F.coalesce(F.col("type").isin(*books), F.lit(False)).alias("problem"))
    same = alive.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")
    same = same.select(F.lit("same_digest").alias("check"), F.col("sha256").alias("value"), "n", F.lit(True).alias("problem"))
    lost = rooms.select("name").distinct().join(df.select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("name")), "name", "left_anti")
    lost = lost.select(F.lit("orphan_room").alias("check"), F.col("name").alias("value"), F.lit(1).alias("n"), F.lit(True).alias("problem"))
    out = totals
    for part in (types, missing, orphans, empty, same, lost):
        out = out.unionByName(part)
    return out
